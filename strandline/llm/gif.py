"""GIF columns: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms.

``decode`` renders a GIF into timed RGBA frames; ``encode`` writes 8-bit samples as a greyscale GIF with
greedy LZW. ``frames_table`` decodes a column of GIFs into one row for each frame, and ``store_texts``
stores texts losslessly as GIF samples and reads them back.

Edge cases: null or empty media give no frames; a truncated or damaged stream raises ValueError in
``decode`` and gives one row with `error` set in ``frames_table``, as does a canvas beyond CANVAS_BYTES; null texts are empty ones; a text longer
than one frame's rows takes several frames; rows that repeat are handled one by one; an empty table gives
no rows; of the input only the named columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

#: Samples in a row, and rows in a frame at most, of the GIFs that texts are stored in.
WIDTH, FRAME_ROWS = 192, 8192
DELAY_CS = 4
BINS = 8
#: Bytes of RGBA that a canvas may claim; one that claims more is an error, not a task without memory.
CANVAS_BYTES = 1 << 30


# ---- LZW


def lzw_encode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Greedy codes for 8-bit samples, and each code's width in bits."""
    clear, stop = 256, 257
    codes, known, following = [clear], {}, 258
    put, get = codes.append, known.get
    rest = iter(data)
    held = next(rest, -1)
    for b in rest:
        key = held << 8 | b
        found = get(key)
        if found is not None:
            held = found
            continue
        put(held)
        known[key] = following
        following += 1
        held = b
        if following == 4096:
            # Clear while codes have 12 bits.
            put(held)
            put(clear)
            known.clear()
            following = 258
            held = next(rest, -1)
    if held >= 0:
        put(held)
    put(stop)
    out = np.array(codes, np.int64)
    return out, widths(out, 8)


def widths(codes: np.ndarray, least: int) -> np.ndarray:
    """Bits of each code: they follow from the number of codes since the last clear code."""
    clear = 1 << least
    place = np.arange(len(codes))
    last = np.maximum.accumulate(np.where(codes == clear, place, -1))
    last = np.concatenate([[-1], last[:-1]])  # before this code; the clear code itself is written in the width before it
    since = place - last - 1
    return width_after(since, least)


def width_after(since: np.ndarray, least: int) -> np.ndarray:
    """Width of the code that `since` codes stand before, since the last clear code: these made since - 1 entries."""
    entries = (1 << least) + 2 + np.maximum(since - 1, 0)
    return np.minimum(12, np.maximum(least + 1, np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1))


def pack_bits(codes: np.ndarray, bits: np.ndarray) -> bytes:
    """Codes as a little-endian bit stream."""
    ends = np.cumsum(bits)
    at = ends - bits
    n = int(ends[-1] + 7) // 8 + 4
    shifted, first = codes << (at & 7), at >> 3
    # Codes have no bit in common, so sums are unions; a code of 12 bits from bit 7 on touches three bytes.
    out = sum(np.bincount(first + k, weights=(shifted >> (8 * k)) & 255, minlength=n) for k in range(3))
    return out[: int(ends[-1] + 7) // 8].astype(np.uint8).tobytes()


#: Codes cut out of the bits at once.
RUN_CODES = 8192
_STEP: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def lzw_decode(stream: bytes, least: int, size: int) -> bytes:
    """`size` samples from an LZW stream. Codes are cut out of the bits run by run, as their widths follow from their
    numbers since the last clear code; then each code adds its string. A full table stays until a clear code, whatever
    number of codes comes before that."""
    if not 1 <= least <= 8:
        raise ValueError("LZW codes of an unknown width")
    clear, stop = 1 << least, (1 << least) + 1
    if least not in _STEP:
        bits = width_after(np.arange(RUN_CODES), least)
        _STEP[least] = np.concatenate([[0], np.cumsum(bits)]), bits
    offsets, bits = _STEP[least]
    full = np.arange(RUN_CODES + 1) * 12, np.full(RUN_CODES, 12)  # every later run has codes of 12 bits
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total = len(stream) * 8
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, made, at = [], 0, 0
    table_, before, steps = roots.copy(), None, (offsets, bits)
    while made < size:
        ends, wide = steps
        spots = ends[:-1] + at
        n = int(np.searchsorted(spots, total))
        if n == 0:
            raise ValueError("LZW stream ends early")
        spots = spots[:n]
        codes = (words[spots >> 3] >> (spots & 7).astype(np.uint32)) & ((1 << wide[:n]) - 1).astype(np.uint32)
        halt = np.flatnonzero((codes == clear) | (codes == stop))
        run = codes[: halt[0]].tolist() if len(halt) else codes.tolist()
        strings = []
        add, grow, room = strings.append, table_.append, 4096 - len(table_)
        for code in run:
            if before is None:
                if code >= clear:
                    raise ValueError("LZW stream begins with an unknown code")
                before = roots[code]
                add(before)
                continue
            if code < len(table_):
                own = table_[code]
                if room > 0:
                    grow(before + own[:1])
                    room -= 1
            elif code == len(table_) and room > 0:
                own = before + before[:1]
                grow(own)
                room -= 1
            else:
                if made + sum(map(len, strings)) >= size:
                    break  # padding after the last sample of a stream without a stop code
                raise ValueError("unknown LZW code")
            add(own)
            before = own
        part = b"".join(strings)
        out.append(part)
        made += len(part)
        if len(halt):
            at = int(spots[halt[0]] + wide[halt[0]])
            if codes[halt[0]] == stop:
                break
            table_, before, steps = roots.copy(), None, (offsets, bits)
        else:
            at += int(ends[-1])
            steps = full
    if made < size:
        raise ValueError("LZW stream ends early")
    return b"".join(out)[:size]


# ---- container


@dataclass
class Frame:
    start_cs: int
    delay_cs: int
    rgba: np.ndarray  # height x width x 4


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    found = []
    while n := data[at]:
        found.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(found), at + 1


def decode(data: bytes) -> list[Frame]:
    """Composed frames. Disposal 2 clears the frame's rectangle, 3 restores what was below it; a frame's
    transparent index leaves the canvas as it is; local palettes go before the global one; interlaced rows are put in order."""
    return list(frames_of(data))


def frames_of(data: bytes, most_bytes: int = CANVAS_BYTES) -> Iterator[Frame]:
    """As ``decode``, a frame at a time."""
    try:
        yield from _decode(data, most_bytes)
    except (IndexError, KeyError) as e:
        raise ValueError("damaged GIF") from e


def _decode(data: bytes, most_bytes: int) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    w, h = (int.from_bytes(data[k : k + 2], "little") for k in (6, 8))
    flags, at, whole = data[10], 13, None
    if flags & 128:
        n = 3 * (2 << (flags & 7))
        whole, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    if w * h * 4 > most_bytes:
        raise ValueError(f"a canvas of {w} x {h} is beyond {most_bytes} bytes")
    canvas = np.zeros((h, w, 4), np.uint8)
    delay, disposal, clear_index, start = 0, 0, None, 0
    while True:
        mark = data[at]
        if mark == 0x3B:
            return
        if mark == 0x21:
            label = data[at + 1]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                clear_index = body[3] if body[0] & 1 else None
        elif mark == 0x2C:
            x, y, fw, fh = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
            flags, at, palette = data[at + 9], at + 10, whole
            if flags & 128:
                n = 3 * (2 << (flags & 7))
                palette, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
            if palette is None:
                raise ValueError("no palette")
            least = data[at]
            stream, at = _sub_blocks(data, at + 1)
            if fw * fh > 4096 * (len(stream) + 1):  # no code's string is longer
                raise ValueError("LZW stream ends early")
            index = np.frombuffer(lzw_decode(stream, least, fw * fh), np.uint8).reshape(fh, fw)
            if flags & 64:
                order = np.concatenate([np.arange(a, fh, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                rows = np.empty_like(index)
                rows[order] = index
                index = rows
            if index.size and index.max() >= len(palette):
                raise ValueError("sample beyond the palette")
            below = canvas.copy() if disposal == 3 else None
            part = canvas[y : y + fh, x : x + fw]
            index = index[: part.shape[0], : part.shape[1]]
            rgba = np.concatenate([palette[index], np.full((*index.shape, 1), 255, np.uint8)], 2)
            if clear_index is None:
                part[:] = rgba
            else:
                shown = index != clear_index
                part[shown] = rgba[shown]
            yield Frame(start, delay, canvas.copy())
            start += delay
            if disposal == 2:
                part[:] = 0
            elif disposal == 3:
                canvas = below
            delay, disposal, clear_index = 0, 0, None
        else:
            raise ValueError("unknown block")


_GREY = bytes(x for i in range(256) for x in (i, i, i))


def encode(samples: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """8-bit samples as a greyscale GIF; frames that follow the first are clear below their last row."""
    rows = len(samples) // width
    if rows * width != len(samples) or not rows:
        raise ValueError("the samples do not fill whole rows")
    height = min(rows, frame_rows)
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf7\0\0", _GREY]
    for at in range(0, rows, frame_rows):
        part = samples[at * width : (at + frame_rows) * width]
        stream = pack_bits(*lzw_encode(part))
        out += [b"\x21\xf9\4", bytes([2 << 2]), delay_cs.to_bytes(2, "little"), b"\0\0", b"\x2c\0\0\0\0", width.to_bytes(2, "little"), (len(part) // width).to_bytes(2, "little"), b"\0\x08"]
        for k in range(0, len(stream), 255):
            own = stream[k : k + 255]
            out += [bytes([len(own)]), own]
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


def samples(data: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """What ``encode`` stored: the opaque pixels' red channel, frame after frame; and each frame's start and delay. One canvas is held at a time."""
    out, times = [], []
    for f in frames_of(data):
        out.append(f.rgba[..., 0][f.rgba[..., 3] > 0].tobytes())
        times.append((f.start_cs, f.delay_cs))
    return b"".join(out), times


def histogram(rgba: np.ndarray, bins: int = BINS) -> list[int]:
    """Counts of the opaque pixels in `bins` equal ranges of red, then green, then blue."""
    seen = rgba[rgba[..., 3] > 0]
    step = 256 // bins
    return [int(n) for c in range(3) for n in np.bincount(seen[:, c] // step, minlength=bins)[:bins]]


# ---- Spark

FRAMES = "id long, frame int, start_cs int, delay_cs int, width int, height int, pixels binary, red array<long>, green array<long>, blue array<long>, error string"


def frames_table(media: DataFrame, id_col: str = "id", media_col: str = "media", bins: int = BINS) -> DataFrame:
    """A row for each composed frame of each GIF, with RGBA pixels and a histogram of `bins` counts for each channel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, error = [], None
                try:
                    for k, f in enumerate(frames_of(data) if data else []):
                        hist = histogram(f.rgba, bins)
                        rows.append((own, k, f.start_cs, f.delay_cs, f.rgba.shape[1], f.rgba.shape[0], f.rgba.tobytes(), hist[:bins], hist[bins : 2 * bins], hist[2 * bins :], None))
                except ValueError as e:
                    error = str(e)
                if error is not None:
                    rows = [(own, *[None] * 9, error)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    names = [x.split()[0] for x in FRAMES.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in FRAMES.split(", ")]
    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(tidy(run), FRAMES)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and these padded by spaces to a positive multiple of the width."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * ((-len(raw)) % WIDTH or (0 if raw else WIDTH))


STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: Media held in one batch that goes on to the next operator.
BATCH_BYTES = 4 << 20


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a GIF: doc_id, n_bytes (unpadded), media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for own, text in zip(batch.column(0), batch.column(1), strict=True):
                n, payload = payload_of(text.as_py())
                media = encode(payload)
                rows.append((own.as_py(), n, media))
                held += len(media)
                if held > BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), STORED)


def read_texts(stored: DataFrame) -> DataFrame:
    """Reads what ``store_texts`` made: digests of the payload and of the media, and a feature of the frames:
    frames, total time in centiseconds, and the summed histogram of the grey values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, n, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                media = media.as_py()
                payload, frames = samples(media)
                hist = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=BINS)  # of the grey pixels' red channel
                feature = f"{len(frames)}:{sum(frames[-1])}:" + ",".join(map(str, hist.tolist()))
                rows.append((own, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.int64() if x.split()[1] == "long" else pa.string() for x in READ.split(", ")]
    return stored.mapInArrow(tidy(run), READ)


def op2_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_texts(store_texts(table(spark, sf_dir, "documents")))
