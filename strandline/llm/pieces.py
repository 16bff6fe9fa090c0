"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

For each prefix of a text the table holds the one last token of that prefix's encoding: of the vocabulary
matches that end there (found by an automaton over the pieces), it is the one that is compatible with the
last token of the prefix before it. Two tokens are compatible if encoding their concatenation gives the same
two tokens back, i.e. if no merge crosses their bound. The ids are then read off backwards.

No piece crosses certain bounds: before a space mark that follows another character, and around characters
that only occur as pieces of their own or not at all. Texts are cut there, and parts are kept in a bounded
cache for each worker. Unknown characters become their UTF-8 bytes' pieces.

Edge cases: null and empty texts give begin and end ids only, and decode to an empty text; long texts without
spaces take linear time; rows that repeat are encoded one by one; an empty table gives no rows; of the input
only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

SPACE = "▁"
#: Parts kept in a worker's cache, in two halves: when the newer one is full, the older one is dropped.
CACHE = 400_000
#: Pairs of tokens whose compatibility is kept.
PAIRS = 300_000
#: Ids and texts in one batch of results.
BATCH_BYTES = 8 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        shift += 7
        if b < 128:
            return out, at


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        elif key & 7 == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if key & 7 == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """A BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import ahocorasick

        self.text: list[str] = []
        self.kind: list[int] = []
        scores: list[float] = []
        self.bos, self.eos, self.unk, self.prefix, self.squeeze = 1, 2, 0, True, True
        with open(path, "rb") as f:
            data = f.read()
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.text.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece[2], "<f4")[0]))
                self.kind.append(piece.get(3, 1))
            elif number == 2:
                spec = dict(_fields(value))
                if spec.get(3, 1) != 2:
                    raise ValueError("not a BPE model")
                self.unk, self.bos, self.eos = spec.get(40, 0), spec.get(41, 1), spec.get(42, 2)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(1) != b"identity":
                    raise ValueError("only identity normalisation")
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if self.squeeze:
            raise ValueError("models that remove extra spaces are not handled")
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == 6}
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.text, self.kind, strict=True)) if k == 1}
        self.rank = {t: -scores[i] for t, i in self.ids.items()}
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("a piece has a space mark inside")
        self.longest = max(map(len, self.ids))
        joined = sorted({c for t in self.ids if len(t) > 1 for c in t} - {SPACE})
        inner = "".join(map(re.escape, joined))
        self.cut = re.compile(f"{SPACE}+[{inner}]*|[{inner}]+|[^{SPACE}{inner}]")
        self.reached = {t: self._merged(t) == [t] for t in self.ids}
        self.matcher = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if self.reached[t]:
                self.matcher.add_word(t, (len(t), i))
        self.matcher.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        other = {2: " \u2047 ".encode(), 3: b""}
        self.out = [bytes([int(t[3:5], 16)]) if k == 6 else other[k] if k in other else t.replace(SPACE, " ").encode() for t, k in zip(self.text, self.kind, strict=True)]

    def _merged(self, text: str) -> list[str]:
        """The merges as defined, for short texts: the best pair first, of equal ones the leftmost."""
        parts, rank = list(text), self.rank
        ranks = [rank.get(a + b, np.inf) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == np.inf:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank.get(parts[k - 1] + parts[k], np.inf)
            if k < len(ranks):
                ranks[k] = rank.get(parts[k] + parts[k + 1], np.inf)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            a, b = self.text[left], self.text[right]
            found = self.pairs[key] = self._merged(a + b) == [a, b]
        return found

    def part(self, text: str) -> list[int]:
        """Ids of a part of a text, over the prefix table: the last token and its length for each prefix; a length of 0
        is a character that no piece ends at, which becomes its bytes."""
        n = len(text)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        pairs, compatible = self.pairs.get, self.compatible
        for at, (length, token) in self.matcher.iter(text):
            end = at + 1
            if size[end]:
                continue
            left = last[end - length]
            if left >= 0:
                fits = pairs(left << 20 | token)
                if not (compatible(left, token) if fits is None else fits):
                    continue
            last[end], size[end] = token, length
        ids: list[int] = []
        at = n
        while at:
            if last[at] < 0:
                ids += self._bytes(text[at - 1])[::-1]
            else:
                ids.append(last[at])
            at -= size[at] or 1
        return ids[::-1]

    def _bytes(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unk]

    def raw(self, ids: list[int]) -> bytes:
        """The pieces' bytes, joined."""
        return b"".join(map(self.out.__getitem__, ids))

    def known(self, text: str) -> bytes:
        """Ids of a part as little-endian unsigned 32-bit integers, kept in the cache."""
        found = self.older.get(text) or np.array(self.part(text), "<u4").tobytes()
        if len(text) <= 64:
            if len(self.cache) >= CACHE // 2:
                self.older, self.cache = self.cache, {}
            self.cache[text] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids' bytes, without begin and end ids."""
        if not text:
            return b""
        text = ((SPACE if self.prefix else "") + text).replace(" ", SPACE)
        known = self.known
        return b"".join([self.cache.get(p) or known(p) for p in self.cut.findall(text)])

    def decoded(self, ids: bytes) -> bytes:
        """What the ids decode to, in UTF-8."""
        raw = self.raw(np.frombuffer(ids, "<u4").tolist())
        return raw[1:] if self.prefix and raw[:1] == b" " else raw

    def decode(self, ids: list[int]) -> str:
        """Pieces joined; begin and end ids give nothing; a space that the first piece begins with goes; bytes that are no UTF-8 become U+FFFD."""
        raw = self.raw(ids)
        return _utf8(raw[1:] if self.prefix and raw[:1] == b" " else raw)


def _utf8(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


_LOADED: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _LOADED:
        _LOADED[path] = Model(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


ENCODED = "doc_id long, ids array<int>, decoded string"
CHECKED = "doc_id long, n_tokens long, ids array<int>, lossless boolean"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, check: bool = False) -> DataFrame:
    """Ids with begin and end ids, and the text decoded from them; or digests of both; or ids, and whether they decode to the text."""
    path = path or default_path()
    out_ddl = DIGESTS if digests else CHECKED if check else ENCODED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        bos, eos = (np.array([x], "<u4").tobytes() for x in (own.bos, own.eos))
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids = bos + own.encode(text) + eos
                raw = own.decoded(ids)
                if digests:
                    rows.append((doc_id.as_py(), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()))
                elif check:
                    rows.append((doc_id.as_py(), len(ids) // 4, np.frombuffer(ids, "<i4"), raw == text.encode()))
                else:
                    rows.append((doc_id.as_py(), np.frombuffer(ids, "<i4"), raw.decode()))
                held += 0 if digests else len(ids) + len(raw)
                if held > BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    fields = [x.split() for x in out_ddl.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}

    def _batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), out_ddl)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), digests=True)
