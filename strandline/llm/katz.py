"""Language-model scores: a Katz backoff bigram model with Good-Turing discounts and exactly normalised backoff weights.

Tokens are the lower-cased (A-Z) words of a text and one end token; the first has the begin mark as its history.
    P(w | v) = d(c) c(v w) / c(v)          if c = c(v w) > 0
             = alpha(v) P(w)               else, if c(v) > 0
             = P(w)                        else
    P(w)     = d1(c(w)) c(w) / N, and what that leaves is the probability of the class of unknown words.
d(r) is Katz's discount for r <= 5, 1 above; where counts of counts give no discount in (0, 1], 1 - 1/(2r). A
history whose followers are all undiscounted counts one more, so that it leaves mass. alpha(v) is the mass that
the seen followers of v leave, over the unigram mass of all others: the sum over all words is exactly 1.

Documents are dealt once to groups by a hash of their ids. A group sends each of its words, and then each of its
bigrams, once with its count to the key's bucket, as packed sorted arrays; a bucket adds up the counts, which are
the model's tables, partitioned by bucket and written to the shared folder, and answers each group in the order
in which it asked. So a word or bigram of any frequency is one entry for each group. Bigrams meet by their
history, so that its followers' mass adds up in one bucket; histories with more than a thousandth of all tokens,
of which there are fewer than a thousand, are spread by their followers, and only their sums come to the driver.

Words are told apart by 64-bit hashes when they are counted; a bucket then numbers its words, and bigrams are made
of these numbers. Histories that are not known need no answer, and unknown followers of one are a single entry.

Edge cases: null or empty text is its end token; a null doc_id is held out if crc32 of the empty text says so; a
text of any length is one history; rows of one doc_id are scored one by one; with nothing to learn from all words
are unknown with probability 1; an empty table gives no rows; of the input only the named columns are read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, groups_for, hash_spans, lower_ascii, mix, parts, shared_dir, shuffles_released, spans, table, tidy_group, tidy_groups
from .grouped import dealt, opened
from .substrings import _table, runs, slices

END, BEGIN = np.uint64(0x1F0E11D5A7C3B201), np.uint64(0x2B3C99D7E5F41A07)
TOP = 5
#: Bytes of text in a group, in the mean.
GROUP_BYTES = 8 << 20
HOT_SHARE = 1000
#: Numbers of words: their place in the bucket, and the bucket in the low bits; two numbers stand for the begin mark and for unknown words.
BUCKET_BITS = 20
BEGIN_ID, UNKNOWN_ID = np.uint64((1 << 48) - 1), np.uint64((1 << 48) - 2)


def discounts(counts_of_counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """d(0 .. top) from n_1 .. n_(top+1); d(0) is not used."""
    n = np.asarray(counts_of_counts, float)
    d = np.ones(top + 1)
    common = (top + 1) * n[top] / n[0] if n[0] > 0 else 1.0
    for r in range(1, top + 1):
        plain = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] > 0 else 1.0
        value = (plain - common) / (1 - common) if common < 1 else 1.0
        d[r] = value if 0 < value < 1 else 1 - 1 / (2 * r)
    return d


class Unigrams:
    """P(w) from counts; of fixed size."""

    def __init__(self, total: int, distinct: int, counts_of_counts):
        n = np.array([*counts_of_counts], float)
        self.total, self.distinct, self.d = int(total), int(distinct), discounts(n)
        r = np.arange(1, TOP + 1)
        left = float((n[:TOP] * r * (1 - self.d[1:])).sum())
        self.whole = self.total if left > 0 else self.total + 1
        self.unknown = (left if left > 0 else 1.0) / self.whole

    def probability(self, count: np.ndarray) -> np.ndarray:
        seen = self.d[np.minimum(count, TOP)] * count if TOP else count
        seen = np.where(count > TOP, count, seen)
        return np.where(count > 0, seen / self.whole, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


# ---- packed columns


def planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of unsigned integers, byte plane by byte plane, compressed: a plane takes about its entropy."""
    raw = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)
    data = np.ascontiguousarray(raw[:, :width].T).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unplanes(data: bytes, width: int) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.decompress(data[8:], size, codec="zstd"), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").ravel()


def tokens(rows: pa.Table):
    """(token, history, row) of a group's texts, with the end tokens."""
    found = []
    for first, n, data, offsets in chunks(rows.column("_text")):
        low = lower_ascii(data)
        start, end, row = spans(low, offsets)
        counts = np.bincount(row, minlength=n)
        tok = np.full(len(row) + n, END, np.uint64)
        tok[np.arange(len(row)) + row] = hash_spans(low, start, end)
        before = np.empty_like(tok)
        before[1:] = tok[:-1]
        last = np.cumsum(counts) + np.arange(n)
        before[last - counts] = BEGIN
        found.append((tok, before, np.repeat(np.arange(n), counts + 1) + first))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


class Group:
    """The distinct words and bigrams of a group, in the order in which they are asked for."""

    def __init__(self, rows: pa.Table):
        self.tok, self.before, self.row = tokens(rows)
        self.learn = ~rows.column("_held").to_numpy(zero_copy_only=False).astype(bool)[self.row]
        self.words, self.word = np.unique(self.tok, return_inverse=True)
        self.counts = np.bincount(self.word[self.learn], minlength=len(self.words))

    def answer_words(self, rows: list[tuple[int, bytes, bytes]]) -> None:
        """(bucket, counts, places) of this group's words, which are in the buckets' order."""
        rows = sorted(rows)
        self.all = np.concatenate([unplanes(counts, 5) for _, counts, _ in rows]).astype(np.int64)
        self.ids = np.concatenate([unplanes(places, 5) << np.uint64(BUCKET_BITS) | np.uint64(b) for b, _, places in rows])
        self.ids[self.all == 0] = UNKNOWN_ID

    def bigrams(self, buckets: int, texts: int, hot: int) -> None:
        """Sorts the bigrams of known histories by bucket, history and follower; needs the words' answers."""
        begins = self.before == BEGIN
        at = np.empty_like(self.word)
        at[1:] = self.word[:-1]
        at[begins] = 0
        self.history_count = np.where(begins, texts, self.all[at])
        asked = np.flatnonzero(self.history_count > 0)
        v = np.where(begins, BEGIN_ID, self.ids[at])[asked]
        w = self.ids[self.word[asked]]
        count = self.history_count[asked]
        del at, begins
        salts = np.where(count > hot, -(-count // hot), 1).astype(np.uint64)
        place = mix(v + mix(w) % salts * np.uint64(0x9E3779B97F4A7C15))
        bucket = ((place >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        del salts, place
        order = np.lexsort((w, v, bucket))
        b, v, w = bucket[order], v[order], w[order]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])
        first = np.flatnonzero(new)
        self.pair = np.full(len(self.tok), -1, np.int64)  # -1: the history is not known
        self.pair[asked[order]] = np.cumsum(new) - 1
        self.b, self.v, self.w = b[first], v[first], w[first]
        learnt = self.pair[self.learn]
        self.pair_counts = np.bincount(learnt[learnt >= 0], minlength=len(first))
        first = asked[order[first]]
        self.follower_count = self.all[self.word[first]]
        self.is_hot = self.history_count[first] > hot

    def blocks(self, buckets: int):
        bounds = np.searchsorted(self.b, np.arange(buckets + 1))
        return [(k, slice(bounds[k], bounds[k + 1])) for k in range(buckets) if bounds[k] < bounds[k + 1]]


def score(docs: DataFrame, held: str = "pmod(crc32(coalesce(cast(_id as string), '')), 10) = 0", id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Learns from the rows for which `held` (SQL over _id and _text) is not true, and scores all: doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score. The tables are written below `folder`."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/katz-{uuid.uuid4().hex}"
    # A worker holds one group's tokens, or one bucket's bigrams: their number follows from the texts' size.
    groups = buckets = min(1 << BUCKET_BITS, groups_for(docs, text_col, GROUP_BYTES, 2 * parts(spark)))
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    group = F.pmod(F.xxhash64("_id"), F.lit(groups)).cast("int")
    texts = source.select("_id", "_text", F.coalesce(F.expr(held), F.lit(False)).alias("_held"), group.alias("pid"))
    # Used three times: as compressed blocks in the shared folder, already dealt, texts are moved only once.
    texts = cut(dealt(texts, groups))

    def send_words(rows: pa.Table) -> pa.Table:
        own = Group(opened(rows))
        pid = rows.column("pid")[0].as_py()
        out = [(b, pid, own.words[s].tobytes(), planes(own.counts[s], 5)) for b, s in slices(own.words, buckets)]
        return _table(SENT_WORDS, list(zip(*out, strict=True)))

    SENT_WORDS = pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def add_words(rows: pa.Table) -> pa.Table:
        pids, bucket = rows.column("pid").to_pylist(), rows.column("bucket")[0].as_py()
        keys = [np.frombuffer(x, np.uint64) for x in rows.column("keys").to_pylist()]
        counts = [unplanes(x, 5).astype(np.int64) for x in rows.column("counts").to_pylist()]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
        known = total > 0
        facts = [int(total.sum()), int(known.sum()), *np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)[1 : TOP + 2].tolist()]
        out = [(bucket, None, every[known].tobytes(), planes(total[known], 5), facts)]
        number = np.cumsum(known) - 1
        for pid, k in zip(pids, keys, strict=True):
            at = np.searchsorted(every, k)
            out.append((bucket, pid, planes(np.where(known, number, 0)[at], 5), planes(total[at], 5), None))
        return _table(WORDS, list(zip(*out, strict=True)))

    WORDS = pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("facts", pa.list_(pa.int64()))])
    words = texts.groupBy("pid").applyInArrow(tidy_group(send_words), "bucket int, pid int, keys binary, counts binary")
    words = words.groupBy("bucket").applyInArrow(tidy_group(add_words), "bucket int, pid int, keys binary, counts binary, facts array<long>")
    _write(words, f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    # Sums over buckets: eight numbers come to the driver.
    facts = words.where("pid is null").select(*(F.sum(F.col("facts")[i]) for i in range(TOP + 3))).first()
    if facts[0] is None and not source.limit(1).count():
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    unigrams = Unigrams(facts[0] or 0, facts[1] or 0, [x or 0 for x in facts[2:]])
    trained = source.where(~F.coalesce(F.expr(held), F.lit(False))).count()
    hot = max(1, unigrams.total // HOT_SHARE)
    word_answers = words.where("pid is not null").select("pid", F.lit(0).alias("kind"), "bucket", F.col("counts").alias("a"), F.col("keys").alias("b"), F.lit(None).cast("binary").alias("c"))

    def send_bigrams(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table(SENT, [[]] * 8)
        own = Group(opened(rows))
        own.answer_words(list(zip(*(answers.column(c).to_pylist() for c in "bucket a b".split()), strict=True)))
        own.bigrams(buckets, trained, hot)
        pid, out = rows.column("pid")[0].as_py(), []
        for k, s in own.blocks(buckets):
            v = own.v[s]
            at = runs(v)
            out.append((k, pid, planes(v[at], 6), planes(np.diff(np.concatenate([at, [len(v)]])), 4), planes(own.is_hot[s][at], 1), planes(own.w[s], 6), planes(own.pair_counts[s], 5), planes(own.follower_count[s], 5)))
        return _table(SENT, list(zip(*out, strict=True)))

    names = ("histories", "lengths", "hot", "followers", "counts", "totals")
    SENT = pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), *((n, pa.binary()) for n in names)])

    def add_bigrams(rows: pa.Table) -> pa.Table:
        pids, bucket = rows.column("pid").to_pylist(), rows.column("bucket")[0].as_py()
        packed = {n: rows.column(n).to_pylist() for n in names}
        heads = [unplanes(h, 6) for h in packed["histories"]]
        hots = [unplanes(x, 1) for x in packed["hot"]]
        sizes = [unplanes(x, 4).astype(np.int64) for x in packed["lengths"]]
        bounds = np.cumsum([0, *(int(x.sum()) for x in sizes)])
        v = np.concatenate([np.repeat(h, n) for h, n in zip(heads, sizes, strict=True)])
        w = np.concatenate([unplanes(x, 6) for x in packed["followers"]])
        order = np.lexsort((w, v))
        v, w = v[order], w[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
        place = np.empty(len(v), np.int32)
        place[order] = np.cumsum(new, dtype=np.int32) - 1
        first = np.flatnonzero(new)
        v, w = v[first], w[first]
        first = order[first]
        del order, new
        follower = np.concatenate([unplanes(x, 5).astype(np.int64) for x in packed["totals"]])[first]
        total = np.bincount(place, weights=np.concatenate([unplanes(x, 5).astype(np.float64) for x in packed["counts"]]), minlength=len(first)).astype(np.int64)
        del first, packed
        known = total > 0
        # What each history's seen followers take: how many have count 1 .. TOP, and their unigram mass.
        begin = runs(v)
        history = v[begin]
        taken = np.zeros((len(begin), TOP), np.int64)
        for r in range(1, TOP + 1):
            taken[:, r - 1] = np.add.reduceat((total == r).astype(np.int64), begin)
        mass = np.add.reduceat(np.where(known, unigrams.probability(follower), 0.0), begin)
        every = np.add.reduceat(total, begin)
        facts = np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)[1 : TOP + 2].tolist()
        tv = v[known]
        at = runs(tv)
        hot_set = np.unique(np.concatenate([h[x.astype(bool)] for h, x in zip(heads, hots, strict=True)]))
        hot_at = np.searchsorted(history, hot_set)
        spread = [{"history": int(history[i]), "taken": taken[i].tolist(), "mass": float(mass[i]), "every": int(every[i])} for i in hot_at]
        # The table: histories, their numbers of followers, followers and counts.
        follows = np.diff(np.concatenate([at, [len(tv)]]))
        out = [(bucket, None, planes(tv[at], 6), planes(follows, 5), planes(w[known], 6) + planes(total[known], 5), facts, spread)]
        plain = taken.sum(1) == 0
        for pid, h, n, a, b in zip(pids, heads, sizes, bounds[:-1], bounds[1:], strict=True):
            i, own = np.searchsorted(history, h), total[place[a:b]]
            # Only where this group has an unseen bigram is a history's backoff weight of use.
            lacks = np.logical_or.reduceat(own == 0, np.cumsum(n) - n)
            j = i[lacks]
            more = planes(taken[j].ravel(), 4), mass[j].tobytes()
            out.append((bucket, pid, planes(own, 5), planes(plain[i] + 2 * lacks, 1), len(more[0]).to_bytes(8, "little") + b"".join(more), None, None))
        return _table(BIGRAMS, list(zip(*out, strict=True)))

    spread_type = pa.list_(pa.struct([("history", pa.int64()), ("taken", pa.list_(pa.int64())), ("mass", pa.float64()), ("every", pa.int64())]))
    BIGRAMS = pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("facts", pa.list_(pa.int64())), ("spread", spread_type)])
    bigrams = texts.groupBy("pid").cogroup(word_answers.groupBy("pid")).applyInArrow(tidy_groups(send_bigrams), "bucket int, pid int, " + ", ".join(f"{n} binary" for n in names))
    bigrams = bigrams.groupBy("bucket").applyInArrow(tidy_group(add_bigrams), "bucket int, pid int, a binary, b binary, c binary, facts array<long>, spread array<struct<history: long, taken: array<long>, mass: double, every: long>>")
    _write(bigrams, f"{folder}/bigrams")
    bigrams = spark.read.parquet(f"{folder}/bigrams")
    counted = bigrams.where("pid is null")
    d = discounts(np.array([x or 0 for x in counted.select(*(F.sum(F.col("facts")[i]) for i in range(TOP + 1))).first()]))
    # Fewer than HOT_SHARE histories, and the begin mark.
    one = counted.select(F.explode("spread").alias("s")).groupBy("s.history").agg(F.sum("s.mass").alias("mass"), *(F.sum(F.col("s.taken")[i]).alias(f"n{i}") for i in range(TOP)))
    hot_rows = sorted((r["history"], r["mass"], [r[f"n{i}"] for i in range(TOP)]) for r in one.collect())
    hot_keys = np.array([r[0] for r in hot_rows], np.uint64)
    hot_mass, hot_taken = np.array([r[1] for r in hot_rows]), np.array([r[2] for r in hot_rows], np.int64).reshape(-1, TOP)
    answers = word_answers.union(bigrams.where("pid is not null").select("pid", F.lit(1), "bucket", "a", "b", "c"))

    def finish(rows: pa.Table, back: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _table(OUT, [[]] * 7)
        rows = opened(rows)
        own = Group(rows)
        got = sorted(zip(*(back.column(c).to_pylist() for c in ("kind", "bucket", "a", "b", "c")), strict=True), key=lambda r: r[:2])
        own.answer_words([(r[1], r[2], r[3]) for r in got if r[0] == 0])
        own.bigrams(buckets, trained, hot)
        pairs = [r for r in got if r[0] == 1]
        none = np.zeros(0, np.int64)
        total = np.concatenate([unplanes(r[2], 5) for r in pairs] or [none]).astype(np.int64)
        flags = np.concatenate([unplanes(r[3], 1) for r in pairs] or [none]).astype(np.int64)
        # One place for each (bucket, history) of this group.
        new = np.ones(len(own.b), bool)
        new[1:] = (own.b[1:] != own.b[:-1]) | (own.v[1:] != own.v[:-1])
        plain, lacks = (flags & 1).astype(bool), flags >= 2
        left, mass = np.zeros(len(flags)), np.zeros(len(flags))
        cut_mass = np.arange(1, TOP + 1) * (1 - d[1:])
        more = [_unmore(r[4]) for r in pairs]
        left[lacks] = np.concatenate([m[0] for m in more]) @ cut_mass if more else 0
        mass[lacks] = np.concatenate([m[1] for m in more]) if more else 0
        if len(hot_keys):
            v = own.v[new]
            i = np.minimum(np.searchsorted(hot_keys, v), len(hot_keys) - 1)
            is_hot = hot_keys[i] == v
            left[is_hot], mass[is_hot] = (hot_taken @ cut_mass)[i[is_hot]], hot_mass[i[is_hot]]
            plain[is_hot] = (hot_taken.sum(1) == 0)[i[is_hot]]
        asked = own.pair >= 0
        pair = own.pair[asked]
        head = ((np.cumsum(new) - 1)[pair]).astype(np.int64)
        word_count = own.all[own.word]
        p = unigrams.probability(word_count)
        count, whole = total[pair], own.history_count[asked] + plain[head]
        seen = np.where(count > TOP, 1.0, d[np.minimum(count, TOP)]) * count / whole
        alpha = np.where(plain, 1.0, left)[head] / whole / (1 - mass)[head]
        p[asked] = np.where(count > 0, seen, alpha * p[asked])
        n = rows.num_rows
        sums = lambda x: np.bincount(own.row, weights=x, minlength=n)
        return _table(OUT, [
            rows.column("_id").to_pylist(), rows.column("_held").to_pylist(), np.bincount(own.row, minlength=n), sums(word_count > 0).astype(np.int64),
            np.full(n, unigrams.total), sums(unigrams.base(word_count)), sums(np.log10(p))])

    OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return texts.groupBy("pid").cogroup(answers.groupBy("pid")).applyInArrow(tidy_groups(finish), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _unmore(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Counts of followers with 1 .. TOP occurrences, and their unigram mass, of each history."""
    size = int.from_bytes(data[:8], "little")
    return unplanes(data[8 : 8 + size], 4).reshape(-1, TOP).astype(np.int64), np.frombuffer(data[8 + size :], np.float64)


def _write(df: DataFrame, path: str) -> None:
    """A table in the shared folder, a file for each task; a row of it holds a bucket's packed entries or a group's answer."""
    with shuffles_released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
