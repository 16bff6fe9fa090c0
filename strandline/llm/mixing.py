"""Mixing sources to target weights with a curriculum that varies over training time. DataFrame functions only.

1. Targets: sources in code-point order, null last, take the weights in turn; each gets its weight's share of
   all words, but at most `most` times its own size; what is above goes to the others by weight (water filling).
2. Order: a source's documents stand in a fixed hashed order, repeated up to `most` times. A document's place
   on this tape is the words before it: an exact prefix sum, made of sums for each (source, hash bucket) and
   running sums inside each bucket, so that no source is gathered into one task.
3. Time: source s has the demand density w(t) = 1 + g(1 - 2t) for training time t in [0, 1] with slope g in
   [-1, 1] of its own; its integral F(t) = t + g t (1 - t) rises from 0 to 1. A copy whose middle is at word u
   of the source's target T is trained at the time t with F(t) = u / T, the root of a quadratic.
4. Documents are range-sorted by the time of their first copy.

Edge cases: null text has size 0; documents of size 0 are taken 0 words and stand at time 0 of their source;
null sources are one source, the last; a repeated doc_id is another document; a null one is hashed as empty
text; equal hashes are ordered by doc_id, then by size; an empty table gives no rows; other columns of the input are ignored,
but for a struct `_row`, which is carried along and may hold columns of any names.

Two windows pass over the table of sources, one row for each, in one task: sources are labels of collections, and some ten
million of them fit a task (a row of six numbers and a name); no document passes through these windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: Buckets of a source's hashed order.
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes(source, source_size) with `rank`, `weight` and `target`, whose sum is that of the sizes.

    With r = most * size / weight, the sources above their cap are those of smallest r. If the first k are
    capped, the others get L_k = (total - their caps) / (weights left) a unit of weight; k is the least with
    L_k <= r of the next. One row for each source passes through one window: its size is that of the sources' table.
    """
    each = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(each, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("_r", F.col("cap") / F.col("weight"))
    order = W.orderBy("_r", "rank")
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / left
    found = ranked.withColumn("_level", level).withColumn("_ok", F.col("_level") <= F.col("_r"))
    # The least k that fits has the smallest rank by r among those that fit: its level holds for all after it.
    found = found.withColumn("_final", F.min_by("_level", F.when(F.col("_ok"), F.struct("_r", "rank"))).over(every))
    share = F.coalesce(F.least("cap", F.col("_final") * F.col("weight")), F.col("cap"))
    return found.select("source", "source_size", "rank", "weight", share.alias("target"))


def slope(rank: Column) -> Column:
    """Sources take turns: more at the start, even, more at the end."""
    return F.element_at(F.array(F.lit(0.8), F.lit(0.0), F.lit(-0.8)), (rank % 3 + 1).cast("int"))


def inverse_time(x: Column, g: Column) -> Column:
    """t in [0, 1] with t + g t (1 - t) = x. Written without cancellation, so g = 0 is no special case."""
    b = F.lit(1.0) + g
    return F.least(F.lit(1.0), F.lit(2.0) * x / (b + F.sqrt(F.greatest(b * b - F.lit(4.0) * g * x, F.lit(0.0)))))


def placed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """docs(doc_id, source, size, ...) with source_size, target, weight, `start` (words before it on its source's tape) and `rank`."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # Buckets are ranges of the key, so that their order is the key's.
    bucket = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)
    docs = docs.select("doc_id", "source", "size", *(["_row"] if "_row" in docs.columns else []))
    docs = docs.withColumn("_key", key).withColumn("_bucket", F.floor(bucket).cast("int"))
    blocks = cut(docs.groupBy("source", "_bucket").agg(F.sum("size").alias("_block")))  # of bounded size for each source
    goals = targets(blocks.groupBy("source").agg(F.sum("_block").alias("source_size")), weights, most)
    run = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_block").over(run), F.lit(0))).drop("_block")
    joined = blocks.alias("b").join(goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")))
    joined = joined.select(F.col("b.source").alias("_source"), F.col("_bucket").alias("_at"), "_before", "source_size", "rank", "weight", "target")
    inside = W.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ordered = docs.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    found = ordered.join(joined, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_at")))
    return found.withColumn("start", F.col("_before") + F.col("_inside")).drop("_source", "_at", "_before", "_inside", "_bucket", "_key")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, buckets: int = BUCKETS, whole: bool = False) -> DataFrame:
    """Adds to docs(doc_id, source, size, ...): source_size, target, taken, times (a training time for each copy), first_time.

    The copy in pass p covers the words from start + p * source_size on. With whole=False, it is taken as far as
    the target reaches into it, so that a source's taken words are its target, rounded; with whole=True copies are
    taken whole, if their middle is below the target.
    """
    found = placed(docs, weights, most, buckets)
    goal = F.round("target").cast("long")
    pieces = []
    for p in range(most):
        at = F.col("start") + F.lit(p) * F.col("source_size")
        if whole:
            own = F.when(2 * at + F.col("size") < 2 * goal, F.col("size")).otherwise(F.lit(0))
        else:
            own = F.greatest(F.lit(0), F.least(F.col("size"), goal - at))
        place = (at + F.col("size") / 2) / F.col("target")
        time = inverse_time(F.least(F.lit(1.0), place), slope(F.col("rank")))
        pieces.append(F.struct(own.cast("long").alias("words"), F.when(own > 0, time).alias("time")))
    found = found.withColumn("_copies", F.array(*pieces))
    found = found.withColumn("taken", F.aggregate("_copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]))
    found = found.withColumn("times", F.transform(F.filter("_copies", lambda c: c["words"] > 0), lambda c: c["time"]))
    return found.withColumn("first_time", F.coalesce(F.try_element_at("times", F.lit(1)), F.lit(0.0))).drop("_copies", "start", "rank", "weight")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(sized(table(spark, sf_dir, "documents")))
    found = mix(docs).repartitionByRange("first_time", "doc_id").sortWithinPartitions("first_time", "doc_id")
    return found.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
q AS (SELECT *, CASE i % 3 WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / w AS r, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
t AS (SELECT source, source_size, least(cap, w * (SELECT level FROM l WHERE level <= r ORDER BY r, i LIMIT 1)) AS target FROM l),
p AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(greatest(0, least(size, round(target) - a)) + greatest(0, least(size, round(target) - a - source_size)) + greatest(0, least(size, round(target) - a - 2 * source_size)) AS BIGINT) AS taken FROM p
"""
