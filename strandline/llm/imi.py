"""Nearest neighbours by inner product over an inverted multi-index.

The two halves of each vector are quantised separately, by centroids fitted on a bounded sample; a cell is a
pair of centroids, and every vector is indexed in its cell. A query goes through the cells in falling order of
summed half scores (its inner products with the two centroids) with a heap, until the cells that it has
passed hold `reach` of all vectors and at least `least` vectors; the entries of those cells are scored in
full, in double precision. Vectors without clusters need a large reach for a given recall, others a small one: where
no reach is given, it is measured on the sample, as the one with which PROBES of its vectors find `recall` of their
neighbours in the sample by brute force.

Equal vectors are one entry with its `k` + 1 smallest ids (no more can be among the k nearest but for the
query itself), and equal queries are searched once, so a vector that a third of all rows hold costs one entry. Cells are
packed into blocks of bounded size, large cells split over several, and queries into lots: a task scores one block against
one lot as a matrix product, in which cells that a query did not reach do not count, and keeps the k + 1 best of each
query. The table of cell sizes is bounded by the square of the centroids' number; it is all that is sent along beside the centroids.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither as queries
nor as candidates; vectors of several lengths are searched length by length; with fewer candidates than k all found are
returned; ties go to the smaller id; a repeated id with equal vector counts once; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, parts, table, tidy, tidy_groups

K = 20
CENTROIDS = 64
#: Vectors that the centroids are fitted on, at most.
SAMPLE = 8192
#: Recall that the reach is measured for, on so many queries, and number of distinct vectors that a query scores at least.
RECALL, PROBES, LEAST = 0.96, 256, 1500
#: Entries and queries of a block: every lot of queries has a copy of each block that it reaches.
BLOCK, QUERY_BLOCK = 4096, 16384
#: Queries whose cells one task visits, in the mean.
QUERIES_A_TASK = 512


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, key (the vector's doubles as bytes) of rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) + 0.0  # no negative zeros
            ends = np.cumsum(sizes)
            sums = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            some = np.concatenate([[0], np.cumsum(values != 0)])
            good = (sizes > 0) & (sums[ends] == sums[ends - sizes]) & (some[ends] > some[ends - sizes]) & ids.is_valid().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], ends]) * 8
            keys = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(bounds), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([ids, keys.cast(pa.binary())], names=["id", "key"]).filter(pa.array(good))

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vector")).mapInArrow(tidy(run), "id long, key binary")


def entries_of(rows: DataFrame, keep: int) -> DataFrame:
    """One row for each distinct vector: key and its `keep` smallest ids. The limit holds before rows are shuffled."""
    ranked = rows.dropDuplicates(["key", "id"]).withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    # A vector's rows are first cut to `keep` within each of 64 salts, so that no task gets all rows of a hot vector.
    first = ranked.withColumn("_n", F.row_number().over(W.partitionBy("key", "_salt").orderBy("id"))).where(F.col("_n") <= keep)
    small = first.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("ids"))
    return small


def fit(sample: np.ndarray, centroids: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means, begun at distinct sampled points; deterministic."""
    rng = np.random.default_rng(seed)
    points = np.unique(sample, axis=0)
    centers = points[rng.permutation(len(points))[:centroids]].copy()
    for _ in range(rounds):
        near = nearest(points, centers)
        counts = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        full = counts > 0
        centers[full] = sums[full] / counts[full, None]
    return centers


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers**2).sum(1)[None, :] - 2 * points @ centers.T, axis=1)


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells in falling order of first[i] + second[j], until they hold `enough` entries: the multi-sequence
    algorithm with a heap over the two sorted lists; a cell enters it when both cells before it have left."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    sa, sb = first[a], second[b]
    heap, seen, out, held = [(-(sa[0] + sb[0]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(second) + int(b[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (-(sa[p] + sb[q]), p, q))
    return out


def pack(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: neighbouring cells share a block of about `most` entries; a larger cell has several of its own."""
    base, splits, block, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for c, n in enumerate(sizes.tolist()):
        if n > most:
            block += held > 0
            base[c], splits[c] = block, -(-n // most)
            block, held = block + int(splits[c]), 0
            continue
        if held + n > most:
            block, held = block + 1, 0
        base[c] = block
        held += n
    return base, splits


def _matrix(keys, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.float64).reshape(-1, dim)


def probe(points: np.ndarray, c1: np.ndarray, c2: np.ndarray, sizes: np.ndarray, k: int, recall: float, probes: int = PROBES) -> float:
    """The share of all entries that has to be scored for `recall` of the sample's neighbours in the sample."""
    half, shares = c1.shape[1], []
    cells = nearest(points[:, :half], c1) * len(c2) + nearest(points[:, half:], c2)
    for i in np.unique(np.linspace(0, len(points) - 1, min(probes, len(points))).astype(int)):
        scores = points @ points[i]
        scores[i] = -np.inf
        near = np.argsort(-scores, kind="stable")[: min(k, len(points) - 1)]
        order = np.argsort(-((c1 @ points[i, :half])[:, None] + (c2 @ points[i, half:])[None, :]).ravel(), kind="stable")
        held = np.empty(len(order))
        held[order] = np.cumsum(sizes[order]) / max(1, sizes.sum())
        shares.append(held[cells[near]])
    found = np.concatenate(shares) if shares else np.zeros(0)
    return float(np.quantile(found, recall)) if len(found) else 1.0


def search(vectors: DataFrame, queries: DataFrame, k: int = K, centroids: int = CENTROIDS, sample: int = SAMPLE, reach: float | None = None, recall: float = RECALL, least: int = LEAST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest inner product found for each query, but itself."""
    spark = vectors.sparkSession
    entries = cut(entries_of(usable(vectors, id_col, vec_col), k + 1).withColumn("h", F.xxhash64("key")))
    asked = usable(queries, id_col, vec_col).dropDuplicates(["id", "key"])
    dims = [r[0] // 8 for r in entries.groupBy(F.octet_length("key").alias("n")).count().orderBy("n").collect()]  # mostly one
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim in dims:
        out = out.unionByName(_search(entries, asked, dim, k, centroids, sample, reach, recall, least))
    return out


def _search(entries: DataFrame, asked: DataFrame, dim: int, k: int, centroids: int, sample: int, reach: float | None, recall: float, least: int) -> DataFrame:
    spark, sized = entries.sparkSession, F.octet_length("key") == 8 * dim
    # The sample: the distinct vectors of smallest hash. A bounded number of rows comes to the driver.
    drawn = entries.where(sized).select("key", "h").orderBy("h", "key").limit(sample).collect()
    half = dim // 2
    points = _matrix([r.key for r in drawn], dim)
    c1, c2 = fit(points[:, :half], centroids), fit(points[:, half:], centroids, 8)
    n2 = len(c2)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                m = _matrix(rows["key"], dim)
                rows["cell"] = nearest(m[:, :half], c1) * n2 + nearest(m[:, half:], c2)
                yield rows[["key", "ids", "h", "cell"]]

    placed = cut(entries.where(sized).mapInPandas(tidy(place), "key binary, ids array<long>, h long, cell int"))
    sizes = np.zeros(len(c1) * n2, np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most centroids ** 2 rows
        sizes[r["cell"]] = r["count"]
    reach = probe(points, c1, c2, sizes, k, recall) if reach is None else reach
    enough = max(least, int(np.ceil(reach * sizes.sum())))
    base, splits = pack(sizes, BLOCK)

    # Distinct query vectors, each with the blocks of the cells that it reaches.
    distinct = asked.where(sized).select("key").distinct()
    n_queries = distinct.count()

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            m = _matrix(rows["key"], dim)
            s1, s2 = m[:, :half] @ c1.T, m[:, half:] @ c2.T
            for key, f, s, h in zip(rows["key"], s1, s2, rows["h"], strict=True):
                cells = np.array(traverse(f, s, sizes, enough))
                reached = np.zeros(len(sizes), bool)
                reached[cells] = True
                blocks = np.unique(np.concatenate([base[c] + np.arange(splits[c]) for c in cells]))
                yield pd.DataFrame({"block": blocks, "q": h, "key": [key] * len(blocks), "reached": [np.packbits(reached).tobytes()] * len(blocks)})

    # By a stated number of partitions: they are small in bytes, not in work.
    dealt = distinct.withColumn("h", F.xxhash64("key")).repartition(max(parts(spark), n_queries // QUERIES_A_TASK), "h")
    visits = dealt.mapInPandas(tidy(visit), "block int, q long, key binary, reached binary")
    # Queries of a block are split into lots, in proportion to all queries, so that no task gets them all.
    lots = max(1, -(-n_queries // QUERY_BLOCK))
    visits = visits.withColumn("lot", F.pmod("q", F.lit(lots)).cast("int"))
    homes = spark.createDataFrame([(c, int(base[c]), int(splits[c])) for c in np.flatnonzero(sizes).tolist()], "cell int, base int, splits int")
    stored = placed.join(F.broadcast(homes), "cell").withColumn("block", F.col("base") + F.pmod(F.col("h"), F.col("splits")).cast("int"))
    stored = stored.select("block", "cell", "key", "ids").withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"key": [], "vec_id": [], "score": []}).astype({"vec_id": "int64", "score": "float64"})
        vectors_, asked_ = _matrix(left["key"], dim), _matrix(right["key"], dim)
        ids, cells, out, longest = left["ids"].to_numpy(), left["cell"].to_numpy(), [], np.linalg.norm(vectors_, axis=1).max()
        for at in range(0, len(asked_), 256):
            q = asked_[at : at + 256]
            reached = np.frombuffer(b"".join(right["reached"].iloc[at : at + 256]), np.uint8).reshape(len(q), -1)
            near = np.where(np.unpackbits(reached, axis=1)[:, cells] == 1, q @ vectors_.T, -np.inf)
            # Products are rounded: all entries that may be among the k + 1 best are ranked by their exact scores.
            place = max(near.shape[1] - k - 1, 0)
            border = np.partition(near, place, axis=1)[:, place] - 4 * dim * np.finfo(np.float64).eps * longest * np.linalg.norm(q, axis=1)
            for i in range(len(q)):
                row = np.flatnonzero((near[i] >= border[i]) & np.isfinite(near[i]))
                exact = (vectors_[row] * q[i]).cumsum(1)[:, -1]  # summed in order, so equal vectors score alike
                found = sorted((-s, v) for s, e in zip(exact, row, strict=True) for v in ids[e])[: k + 1]
                out += [(right["key"].iat[at + i], v, -s) for s, v in found]
        return pd.DataFrame(out, columns=["key", "vec_id", "score"])

    grouped = stored.groupBy("block", "lot").cogroup(visits.groupBy("block", "lot"))
    partial = grouped.applyInPandas(tidy_groups(score), "key binary, vec_id long, score double")
    order = W.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = partial.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("key").agg(F.collect_list(F.struct("vec_id", "score")).alias("found"))
    # Back to the query rows: each drops itself.
    rows = asked.join(best, "key").select(F.col("id").alias("query_id"), F.explode("found").alias("f")).where("f.vec_id <> query_id")
    last = W.partitionBy("query_id").orderBy(F.desc("f.score"), "f.vec_id")
    return rows.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def op8_imi(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
