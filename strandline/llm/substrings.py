"""Substring dedup: seed and extend over winnowed anchors.

A window is `length` consecutive words. Its anchor is the least hash of its SEED-word grams, the first of equal ones
(winnowing: equal windows have equal anchors at equal places, and neighbouring windows mostly share theirs, so anchors
are few). The steps:

1. Documents are dealt to groups by a hash of their id; this is the only time that texts are shuffled.
2. Seed: each group sends each of its anchors once, packed as sorted 64-bit hashes, to the anchor's bucket, where
   groups meet. Anchors of at least two documents go back to the groups that sent them.
3. Extend: occurrences of a shared anchor meet in its bucket, each with the words (64-bit hashes of them) that stand
   before and after it as far as its windows reach. They are matched word by word to both sides: a match that reaches
   `length` words with the anchor is a repeat, and the occurrence learns which of its windows have one in a smaller
   document, and the least such document. Occurrences that are alike in all these words go as one, with the least document.
4. Windows that overlap or touch are put together: the maximal repeats over the length threshold. Their words are removed.

A passage that any number of documents share is one entry for each group, so a hot passage, or a group of
copies, is reduced before it is shuffled, and no pairs of documents are made. Matches are first found by a hash over
all their words and then compared: the anchor by its 63-bit hash, the words around it one by one.

Edge cases: a null or empty text has no words; a text shorter than `length` words keeps all; windows that repeat
inside one document, or in rows of the same doc_id, do not count; a null doc_id counts as the largest; words
are kept byte by byte and joined by one space; an empty table gives no rows; all columns of the input are
carried along, whatever their names, but for the text, which is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, grams, groups_for, hash_spans, mix, parts, spans, table, tidy_group, tidy_groups

LENGTH = 13
SEED = 6
#: Bytes of text in a group, in the mean.
GROUP_BYTES = 8 << 20
_LAST = np.iinfo(np.int64).max
_ODD = np.uint64(0x9E3779B97F4A7C15)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the high bits, so that the buckets of sorted hashes are slices."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def slices(hashes: np.ndarray, buckets: int):
    """(bucket, slice) of sorted hashes, without empty ones."""
    own = bucket_of(hashes, buckets)
    at = runs(own)
    return [(int(own[a]), slice(int(a), int(b))) for a, b in zip(at, [*at[1:], len(own)], strict=True)]


def runs(sorted_: np.ndarray) -> np.ndarray:
    """First places of equal values."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def least(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys with their least and largest values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    at = runs(keys)
    if not len(at):
        return keys, values, values
    return keys[at], np.minimum.reduceat(values, at), np.maximum.reduceat(values, at)


class Windows:
    """Words and anchors of a group's texts, slice by slice."""

    def __init__(self, rows: pa.Table, length: int):
        ids = rows.column("_id").combine_chunks() if rows.num_rows else pa.array([], pa.int64())
        self.ids = ids.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
        self.rows, self.length = rows, length

    def __iter__(self):
        for first, n, data, offsets in chunks(self.rows.column("_text")):
            start, end, row = spans(data, offsets)
            words = hash_spans(data, start, end)
            yield first, n, data, (start, end, row), Occurrences(words, row, self.length, self.ids, first), offsets.tolist()


class Occurrences:
    """Anchors of the windows of some texts: hash, place of the anchor's first word, and how many words before it its windows begin: from `low` to `high`."""

    def __init__(self, words: np.ndarray, row: np.ndarray, length: int, ids: np.ndarray, first: int):
        self.words, self.reach = words, length - SEED
        n = max(0, len(words) - length + 1)
        valid = np.flatnonzero(row[:n] == row[length - 1 :]) if n else np.zeros(0, np.int64)
        seeds = grams(words, SEED)
        least, place = seeds[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, self.reach + 1):
            other = seeds[j : j + n]
            less = other < least
            least[less], place[less] = other[less], j
        at = valid + place[valid]  # never falls: the first least of a window is no earlier than that of the window before
        begin = runs(at)
        last = np.concatenate([begin[1:], [len(at)]]).astype(np.int64) - 1
        self.place = at[begin]
        self.anchor = seeds[self.place] & ~np.uint64(1) if len(begin) else np.zeros(0, np.uint64)
        self.high, self.low = self.place - valid[begin], self.place - valid[last[: len(begin)]]
        self.ids = ids[first + row[self.place]] if len(begin) else np.zeros(0, np.int64)

    def contexts(self, which: np.ndarray) -> np.ndarray:
        """Words around the occurrences, outwards: `reach` before and `reach` after the anchor; 0 where no window goes."""
        out, at = np.zeros((len(which), 2 * self.reach), np.uint64), self.place[which]
        for j in range(self.reach):
            own = np.flatnonzero(self.high[which] > j)
            out[own, j] = self.words[at[own] - 1 - j]
            own = np.flatnonzero(self.reach - self.low[which] > j)
            out[own, self.reach + j] = self.words[at[own] + SEED + j]
        return out

    def keys(self, which: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """A hash of all that tells an occurrence apart."""
        out = mix(self.anchor[which] + (self.low[which] * 64 + self.high[which]).astype(np.uint64))
        for j in range(contexts.shape[1]):
            out = mix(out * _ODD + contexts[:, j])
        return out


def extended(anchor: np.ndarray, contexts: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence: a bit for each number of words before the anchor from which on a window stands in a smaller document too,
    and the least such document. Matches grow a word at a time, to the left and to the right."""
    reach = contexts.shape[1] // 2
    left, right = [anchor], [anchor]
    for j in range(reach):
        left.append(mix(left[-1] * _ODD + contexts[:, j]))
        right.append(mix(right[-1] * _ODD + contexts[:, reach + j] + np.uint64(1)))
    bits, source = np.zeros(len(anchor), np.int64), np.full(len(anchor), _LAST)
    for before in range(reach + 1):
        own = np.flatnonzero((low <= before) & (before <= high))
        if not len(own):
            continue
        whole = mix(left[before][own] * _ODD ^ right[reach - before][own])
        order = np.argsort(whole, kind="stable")
        own, whole = own[order], whole[order]
        at = runs(whole)
        group = np.cumsum(np.concatenate([[0], (whole[1:] != whole[:-1]).astype(np.int64)]))
        # Word for word, against the first of those that are alike by hash.
        head = own[at][group]
        alike = anchor[own] == anchor[head]
        for j in [*range(before), *range(reach, 2 * reach - before)]:
            alike &= contexts[own, j] == contexts[head, j]
        if not alike.all():
            columns = [contexts[own, j] for j in [*range(before), *range(reach, 2 * reach - before)]] + [anchor[own]]
            order = np.lexsort(columns)
            own = own[order]
            group = np.cumsum(np.concatenate([[0], np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0).astype(np.int64)]))
            at = runs(group)
        least = np.minimum.reduceat(ids[own], at)[group]
        less = least < ids[own]
        bits[own[less]] |= 1 << before
        source[own[less]] = np.minimum(source[own[less]], least[less])
    return bits, source


def _packed(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)


def _table(schema: pa.Schema, columns: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns or [[]] * len(schema), schema, strict=True)], schema=schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", layout: bool = False) -> DataFrame:
    """docs with the kept words as text, joined by one space (layout=True: with the white space that follows each in the text, which is left
    as it is where nothing is removed), and `n_words`, `n_removed`, `repeats` (array of [first, last) words: the maximal repeats) and `sources` (of each
    repeat the least document that has a window of it) in a struct `_dedup`."""
    if length < SEED:
        raise ValueError(f"at least {SEED} words")
    groups = buckets = groups_for(docs, text_col, GROUP_BYTES, parts(docs.sparkSession))  # a worker holds one group, or one bucket
    carried = [f.name for f in docs.schema if f.name != text_col]
    own = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carried)]
    group = F.pmod(F.xxhash64(F.col(id_col)), F.lit(groups)).cast("int")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), group.alias("pid"), *own).repartition(groups, "pid")

    if length - SEED > 56:
        raise ValueError(f"at most {SEED + 56} words")
    sent = pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("keys", pa.binary())])
    told = pa.schema([*sent, *((n, pa.binary()) for n in ("anchors", "bounds", "ids", "contexts"))])
    sent_ddl, told_ddl = "bucket int, pid int, keys binary", "bucket int, pid int, keys binary, anchors binary, bounds binary, ids binary, contexts binary"
    shared_ddl, back_ddl = "pid int, keys binary", "pid int, keys binary, anchors binary, bits binary, sources binary"
    shared_, back = pa.schema([sent.field(1), sent.field(2)]), pa.schema([sent.field(1), sent.field(2), *((n, pa.binary()) for n in ("anchors", "bits", "sources"))])
    reach = length - SEED

    def seed(rows: pa.Table) -> pa.Table:
        found = [least(o.anchor, o.ids) for *_, o, _ in Windows(rows, length)]
        keys, lo, hi = (_packed([f[i] for f in found]) for i in range(3))
        order = np.argsort(keys, kind="stable")
        keys, lo, hi = keys[order], lo[order], hi[order]
        at = runs(keys)
        if not len(at):
            return _table(sent, [[]] * 3)
        many = np.minimum.reduceat(lo, at) < np.maximum.reduceat(hi, at)
        keys = keys[at] | many.astype(np.uint64)  # the lowest bit: several documents of this group
        pid = rows.column("pid")[0].as_py()
        out = [(b, pid, keys[s].tobytes()) for b, s in slices(keys, buckets)]
        return _table(sent, list(zip(*out, strict=True)))

    def meet(rows: pa.Table) -> pa.Table:
        pids = rows.column("pid").to_pylist()
        blocks = [np.frombuffer(x, np.uint64) for x in rows.column("keys").to_pylist()]
        every = np.sort(np.concatenate(blocks))
        bare = every & ~np.uint64(1)
        at = runs(bare)
        times = np.diff(np.concatenate([at, [len(bare)]]))
        shared = bare[at][(times > 1) | (np.maximum.reduceat(every, at) & np.uint64(1)).astype(bool)]
        out = []
        for pid, block in zip(pids, blocks, strict=True):
            block = block & ~np.uint64(1)
            if len(hit := block[_among(block, shared)]):
                out.append((pid, hit.tobytes()))
        return _table(shared_, list(zip(*out, strict=True)))

    def surroundings(rows: pa.Table, shared: pa.Table) -> pa.Table:
        if not rows.num_rows or not shared.num_rows:
            return _table(told, [[]] * 7)
        anchors = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in shared.column("keys").to_pylist()]))
        found = []
        for *_, o, _ in Windows(rows, length):
            which = np.flatnonzero(_among(o.anchor, anchors))
            around = o.contexts(which)
            found.append((o.keys(which, around), o.anchor[which], (o.low[which] * 64 + o.high[which]).astype(np.uint16), o.ids[which], around))
        keys, anchor, bounds, ids, around = (np.concatenate([f[i] for f in found]) for i in range(5))
        order = np.lexsort((ids, keys))
        order = order[runs(keys[order])]  # those that are alike: the least document
        order = order[np.argsort(anchor[order], kind="stable")]
        pid = rows.column("pid")[0].as_py()
        anchor = anchor[order]
        out = [(b, pid, keys[order[s]].tobytes(), anchor[s].tobytes(), bounds[order[s]].tobytes(), ids[order[s]].tobytes(), around[order[s]].tobytes()) for b, s in slices(anchor, buckets)]
        return _table(told, list(zip(*out, strict=True)))

    def extend(rows: pa.Table) -> pa.Table:
        blocks = {n: [np.frombuffer(x, t) for x in rows.column(n).to_pylist()] for n, t in (("keys", np.uint64), ("anchors", np.uint64), ("bounds", np.uint16), ("ids", np.int64), ("contexts", np.uint64))}
        keys, anchors, bounds, ids, around = (np.concatenate(blocks[n]) for n in ("keys", "anchors", "bounds", "ids", "contexts"))
        bits, sources = extended(anchors, around.reshape(-1, 2 * reach), bounds // 64, bounds % 64, ids)
        ends, out = np.cumsum([len(k) for k in blocks["keys"]]), []
        for pid, a, b in zip(rows.column("pid").to_pylist(), [0, *ends[:-1]], ends, strict=True):
            hit = a + np.flatnonzero(bits[a:b])
            if len(hit):
                out.append((pid, keys[hit].tobytes(), anchors[hit].tobytes(), bits[hit].tobytes(), sources[hit].tobytes()))
        return _table(back, list(zip(*out, strict=True)))

    fields = [docs.schema[c] for c in carried]
    struct = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("repeats", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("sources", T.ArrayType(T.LongType()))])
    schema = T.StructType([T.StructField(f"_c{i}", f.dataType) for i, f in enumerate(fields)] + [T.StructField("_text", T.StringType()), T.StructField("_dedup", struct)])
    dedup_type = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("repeats", pa.list_(pa.list_(pa.int32()))), ("sources", pa.list_(pa.int64()))])

    def keep(rows: pa.Table, less: pa.Table) -> pa.Table:
        """The kept words. An occurrence's windows are repeated if its bucket said so, or if one that is alike is in a smaller document of this group."""
        col = lambda n, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in less.column(n).to_pylist())])
        keys, bits, sources = col("keys", np.uint64), col("bits", np.int64), col("sources", np.int64)
        order = np.argsort(keys, kind="stable")
        keys, bits, sources = keys[order], bits[order], sources[order]
        anchors, lo, hi = least(*(_packed([f[i] for f in [(o.anchor, o.ids) for *_, o, _ in Windows(rows, length)]]) for i in range(2)))
        anchors = np.unique(np.concatenate([anchors[lo < hi], col("anchors", np.uint64)]))
        here = []
        for *_, o, _ in Windows(rows, length):
            which = np.flatnonzero(_among(o.anchor, anchors))
            here.append((which, o.keys(which, o.contexts(which)), o.ids[which]))
        own_keys, own_least, _ = least(*(_packed([h[i] for h in here]) for i in (1, 2)))
        texts_, facts = [], []
        for (_, n, data, (start, end, row), o, rows_at), (which, key, ids) in zip(Windows(rows, length), here, strict=True):
            cover, origin = np.zeros(len(row) + 1, np.int32), np.full(len(row) + 1, _LAST)
            told_bits, told_source = np.zeros(len(which), np.int64), np.full(len(which), _LAST)
            if len(keys) and len(which):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                met = keys[at] == key
                told_bits[met], told_source[met] = bits[at[met]], sources[at[met]]
            if len(which):
                first_here = own_least[np.searchsorted(own_keys, key)]
                mine = first_here < ids
                told_bits[mine] = -1  # all of its windows
                told_source[mine] = np.minimum(told_source[mine], first_here[mine])
            for before in range(reach + 1):
                hit = np.flatnonzero((told_bits >> before & 1).astype(bool) & (o.low[which] <= before) & (before <= o.high[which]))
                bad = o.place[which[hit]] - before
                cover[bad] += 1
                np.subtract.at(cover, bad + length, 1)
                origin[bad] = np.minimum(origin[bad], told_source[hit])
            gone = np.cumsum(cover[:-1]) > 0
            raw, bounds = data.tobytes(), np.searchsorted(row, np.arange(n + 1))
            for i in range(n):
                a, b = bounds[i], bounds[i + 1]
                dropped = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], dropped.view(np.int8), [0]])))
                if layout:
                    lo_, hi_ = rows_at[i], rows_at[i + 1]
                    firsts = [*start[a:b].tolist(), hi_]
                    cuts = [lo_, *(firsts[e] for e in edges.tolist()), hi_]
                    words = [b"".join(raw[s:e] for s, e in zip(cuts[::2], cuts[1::2], strict=True))]
                elif len(edges):
                    kept = np.flatnonzero(~dropped) + a
                    words = [raw[s:e] for s, e in zip(start[kept].tolist(), end[kept].tolist(), strict=True)]
                else:
                    words = raw[start[a] : end[b - 1]].split() if a < b else []
                texts_.append(b" ".join(words))
                facts.append({"n_words": b - a, "n_removed": int(dropped.sum()), "repeats": edges.reshape(-1, 2).tolist(), "sources": [int(origin[a + x : a + y].min()) for x, y in edges.reshape(-1, 2).tolist()]})
        columns = [rows.column(f"_c{i}") for i in range(len(fields))]
        return pa.table([*columns, pa.array(texts_, pa.binary()).cast(pa.string()), pa.array(facts, dedup_type)], names=[*(f"_c{i}" for i in range(len(fields))), "_text", "_dedup"])

    by = lambda df: df.groupBy("pid")
    anchors = by(texts).applyInArrow(tidy_group(seed), sent_ddl).groupBy("bucket").applyInArrow(tidy_group(meet), shared_ddl)
    windows = by(texts).cogroup(by(anchors)).applyInArrow(tidy_groups(surroundings), told_ddl).groupBy("bucket").applyInArrow(tidy_group(extend), back_ddl)
    out = by(texts).cogroup(by(windows)).applyInArrow(tidy_groups(keep), schema)
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(carried)), F.col("_text").alias(text_col), "_dedup")


def _among(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(sorted_):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return sorted_[at] == values


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "_dedup.n_words", "_dedup.n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, p, array_to_string(words[p : p + 12], ' ') AS win
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM w)),
f AS (SELECT win, min(doc_id) AS first_id FROM g GROUP BY win HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM g JOIN f USING (win) WHERE doc_id > first_id),
k AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(words, ' ') ELSE coalesce(array_to_string(
           list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
