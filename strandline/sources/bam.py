"""BAM files by a reader of BGZF blocks in Python: tasks for ranges of a file, as its .bai index gives them."""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .blocks import Blocks, opened, whole

SCHEMA = "file string, qname string, flags int, contig string, start long, mapq int, cigar array<struct<op: string, len: int>>, seq string, quals array<int>, nh int, hi int"
_OPS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_PAIRS = [a + b for a in _BASES for b in _BASES]
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_CODES = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
ROWS = 4096
UNMAPPED = 4
#: Fixed values of the index format: the first bin and the width (as a shift) of each level, the bin of statistics, the linear windows.
LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
STATISTICS, WINDOW, LONGEST = 37450, 14, 1 << 29


def _number(s: Blocks) -> int:
    return struct.unpack("<i", s.read(4))[0]


def _tags(raw: bytes) -> dict[str, int]:
    out, at = {}, 0
    while at + 3 <= len(raw):
        name, kind, at = raw[at : at + 2].decode(), chr(raw[at + 2]), at + 3
        if kind in _CODES:
            out[name] = struct.unpack_from(_CODES[kind], raw, at)[0]
        if kind in _SIZES:
            at += _SIZES[kind]
        elif kind in "ZH":
            at = raw.index(b"\0", at) + 1
        elif kind == "B":
            at += 5 + _SIZES[chr(raw[at])] * struct.unpack_from("<i", raw, at + 1)[0]
        else:
            raise ValueError(f"BAM: unknown tag type {kind}")
    return out


def header(s: Blocks) -> list[str]:
    """The contigs' names; the stream is then at the first record."""
    if s.read(4) != b"BAM\1":
        raise ValueError("no BAM file")
    s.read(_number(s))
    names = []
    for _ in range(_number(s)):
        names.append(s.read(_number(s))[:-1].decode())
        s.read(4)
    return names


class Regions:
    """Sets of positions by contig; overlapping and touching regions are one."""

    def __init__(self, regions: Iterable[tuple[str, int, int]]):
        self.of: dict[str, list[list[int]]] = {}
        for contig, start, end in sorted(regions):
            if not 0 <= start < end:
                raise ValueError(f"no region {contig}:{start}-{end}")
            own = self.of.setdefault(contig, [])
            if own and start <= own[-1][1]:
                own[-1][1] = max(own[-1][1], end)
            else:
                own.append([start, end])
        self.ends = {c: [e for _, e in own] for c, own in self.of.items()}

    def meets(self, contig: str, start: int, stop: int) -> bool:
        i = bisect_right(self.ends.get(contig, ()), start)
        return start < stop and i < len(self.ends.get(contig, ())) and self.of[contig][i][0] < stop


def read_index(raw: bytes) -> list[tuple[dict[int, np.ndarray], np.ndarray]]:
    """(begin and end of the chunks of each bin, linear offsets) of each contig."""
    if raw[:4] != b"BAI\1":
        raise ValueError("no BAM index")
    out, at = [], 8
    for _ in range(struct.unpack_from("<i", raw, 4)[0]):
        bins, n_bins, at = {}, struct.unpack_from("<i", raw, at)[0], at + 4
        for _ in range(n_bins):
            key, n = struct.unpack_from("<Ii", raw, at)
            bins[key] = np.frombuffer(raw, "<u8", 2 * n, at + 8).astype(np.int64).reshape(-1, 2)
            at += 8 + 16 * n
        bins.pop(STATISTICS, None)
        n = struct.unpack_from("<i", raw, at)[0]
        out.append((bins, np.frombuffer(raw, "<u8", n, at + 4).astype(np.int64)))
        at += 4 + 8 * n
    return out


def chunks_of(bins: dict[int, np.ndarray], linear: np.ndarray, start: int, end: int) -> list[tuple[int, int]]:
    """Ranges of virtual offsets that hold all reads that meet a region."""
    start, last = min(start, LONGEST - 1), min(end, LONGEST) - 1
    least = int(linear[min(start >> WINDOW, len(linear) - 1)]) if len(linear) else 0
    met = [c for key, c in bins.items() if any(first + (start >> s) <= key <= first + (last >> s) for first, s in LEVELS)]
    return [(max(a, least), b) for c in met for a, b in c.tolist() if b > least]


def ranges_of(index: list, names: list[str], regions: Regions | None, size: int) -> list[tuple[int | None, int | None]]:
    """Disjoint ranges of virtual offsets of at most about `size` bytes of the file: all of it (None: the first record, the end of
    the file), or what the regions need. They are cut where the index knows that a record begins."""
    known = sorted({int(p) for bins, linear in index for p in [*linear, *(a for c in bins.values() for a in c[:, 0])] if p})
    cuts = []
    for p in known:
        if not cuts or (p >> 16) - (cuts[-1] >> 16) >= size:
            cuts.append(p)
    if regions is None:
        return list(zip([None, *cuts], [*cuts, None], strict=True))
    found = sorted(c for contig, own in regions.of.items() for start, end in own for c in chunks_of(*index[names.index(contig)], start, end))
    merged: list[list[int]] = []
    for a, b in found:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out = []
    for a, b in merged:
        inner = cuts[bisect_right(cuts, a) : np.searchsorted(cuts, b)]
        out += zip([a, *inner], [*inner, b], strict=True)
    return out


def records(file, begin: int | None = None, end: int | None = None, regions: Regions | None = None, inflags: int = 0, exflags: int = 0, min_mapq: int = 0) -> Iterator[tuple]:
    """Rows of one open BAM file, or of a range of it. A missing mapping quality (255) is null."""
    s = Blocks(file)
    names = header(s)
    if begin is not None:
        s = Blocks(file, begin)
    while (end is None or s.place() < end) and (size := s.read(4)):
        raw = s.read(struct.unpack("<i", size)[0])
        ref, pos, n_name, mapq, _, n_cigar, flags, n_seq = struct.unpack_from("<iiBBHHHi", raw)
        if flags & inflags != inflags or flags & exflags or mapq < min_mapq:
            continue
        at = 32 + n_name
        cigar = [(_OPS[c & 15], c >> 4) for c in struct.unpack_from(f"<{n_cigar}I", raw, at)]
        contig = names[ref] if ref >= 0 else None
        if regions is not None and (flags & UNMAPPED or not regions.meets(contig, pos, pos + sum(n for op, n in cigar if op in "M=XDN"))):
            continue
        at += 4 * n_cigar
        packed = raw[at : at + (n_seq + 1) // 2]
        seq = "".join([_PAIRS[b] for b in packed])[:n_seq]
        at += len(packed)
        quals = list(raw[at : at + n_seq])
        tags = _tags(raw[at + n_seq :])
        yield raw[32 : 32 + n_name - 1].decode(), flags, contig, pos, None if mapq == 255 else mapq, [{"op": op, "len": n} for op, n in cigar], seq, quals, tags.get("NH"), tags.get("HI")


def read_bam(spark: SparkSession, *paths: str, regions: Iterable[tuple[str, int, int]] | None = None, inflags: int = 0, exflags: int = 0, min_mapq: int = 0, range_bytes: int = 32 << 20) -> DataFrame:
    """The reads of all files with all of inflags, none of exflags and at least min_mapq (a missing quality counts as 255), each once.

    regions: (contig, start, end); only mapped reads whose CIGAR meets one. A contig that a file's header lacks is an error.
    The index, `x.bam.bai` or `x.bai`, makes tasks of about range_bytes of the file, and of a region scan only those that
    its bins and linear offsets name. A file without an index is streamed by one task, with the same result.
    """
    wanted = None if regions is None else Regions(regions)

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["file"]:
                store, path = opened(name)
                with store.open_input_file(path) as file:
                    names = header(Blocks(file))
                if wanted is not None and (lost := sorted(set(wanted.of) - set(names))):
                    raise ValueError(f"{name} has no contig {lost[0]}")
                raw = whole(f"{name}.bai") or whole(f"{name.removesuffix('.bam')}.bai")
                found = [(None, None)] if raw is None else ranges_of(read_index(raw), names, wanted, range_bytes)
                yield pd.DataFrame([(name, *r) for r in found], columns=["file", "begin", "end"]).astype({"begin": "Int64", "end": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.replace("op: string, len: int", "").split(", ")]
        frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("mapq", "nh", "hi")})
        for batch in batches:
            for name, begin, end in zip(batch["file"], batch["begin"], batch["end"], strict=True):
                store, path = opened(name)
                with store.open_input_file(path) as file:
                    rows = []
                    for r in records(file, *(None if pd.isna(x) else int(x) for x in (begin, end)), wanted, inflags, exflags, min_mapq):
                        rows.append((name, *r))
                        if len(rows) >= ROWS:
                            yield frame(rows)
                            rows = []
                    if rows:
                        yield frame(rows)

    # Rows that name a range are few bytes: an explicit number keeps them from being put together in one task.
    # Offsets are strings in between, as pandas makes floats of long columns with nulls.
    tasks = max(len(paths), int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, len(paths)))
    return files.mapInPandas(plan, "file string, begin long, end long").selectExpr("file", "string(begin) begin", "string(end) end").repartition(tasks).mapInPandas(run, SCHEMA)
