"""Sums over the stored rows that overlap each query, without a row for each pair.

What overlaps [start, end) began before its end, and did not end by its start. So the sum is the difference of two running sums, one
of the weights by where rows begin, at the query's end, and one by where they end, at its start. Time and space go
with the rows and the queries, not with the pairs, whatever the lengths are.

Running sums are made in two steps, inside bins and over the bins' totals, so that no task holds a whole axis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import BIN, bin_of


def _can(keys: Sequence[str]) -> Column:
    """Whether a row can overlap any."""
    found = F.col("start") < F.col("end")
    for k in keys:
        found = found & F.col(k).isNotNull()
    return F.coalesce(found, F.lit(False))


def overlap_sums(queries: DataFrame, stored: DataFrame, weight: Column, group: Column | None = None, keys: Sequence[str] = ("contig",), width: int | None = None) -> DataFrame:
    """queries with `_sums`: an array of (group, total), the sum of `weight`, a whole number, over stored's rows of that group that overlap the query.

    Each query has all groups that stored has, in one order, with 0 where nothing overlaps it. Without `group` there is one, null.
    Repeated rows, and repeated queries, count one by one. Null keys or bounds and empty intervals overlap nothing.
    """
    width = width or BIN
    group = F.lit(None).cast("string") if group is None else group
    # Rows that overlap nothing stay with a weight of 0, as their group counts.
    rows = stored.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), group.alias("_group"), F.when(_can(keys), weight).alias("_w"))
    kind = rows.schema["_w"].dataType
    none = F.lit(0).cast(kind)
    # Rows go to their bins as they are, and are added up there: what moves afterwards is a row for each position.
    rows = rows.repartition(*(F.col(k) for k in keys), bin_of("start", width))
    # A row is below a bound from the next position on if it begins there, and at once if it ends there.
    begun, ended = F.struct((F.col("start") + 1).alias("at"), F.col("_w").alias("begun"), none.alias("ended")), F.struct(F.col("end").alias("at"), none.alias("begun"), F.col("_w").alias("ended"))
    events = rows.select(*keys, "_group", F.explode(F.array(begun, ended)).alias("x")).select(*keys, "_group", F.col("x.at").alias("_at"), F.col("x.begun").alias("_begun"), F.col("x.ended").alias("_ended"))
    line, two = [*keys, "_group"], ("_begun", "_ended")
    events = events.groupBy(*line, "_at").agg(*(F.coalesce(F.sum(c).cast(kind), none).alias(c) for c in two))
    # The sums are asked for with the groups, so that both uses of events are one exchange.
    known = events.agg(F.sort_array(F.collect_set(F.struct("_group"))).alias("_groups"), *(F.max(c).alias(f"_max{c}") for c in two))
    groups = F.broadcast(known.select(F.when(F.col("_max_begun").isNotNull() & F.col("_max_ended").isNotNull(), F.col("_groups")).otherwise(F.slice("_groups", 1, 0)).alias("_groups")))
    asked = queries.where(_can(keys)).select(*keys, F.explode(F.array(F.col("start").cast("long"), F.col("end").cast("long"))).alias("_at")).distinct()
    points = asked.crossJoin(groups).select(*keys, F.explode("_groups").alias("g"), "_at").select(*keys, F.col("g._group").alias("_group"), "_at", none.alias("_begun"), none.alias("_ended"), F.lit(True).alias("_asked"))
    at = events.withColumn("_asked", F.lit(False)).unionByName(points).groupBy(*line, "_at").agg(*(F.sum(c).cast(kind).alias(c) for c in two), F.max("_asked").alias("_asked")).withColumn("_bin", bin_of("_at", width))
    totals = at.groupBy(*line, "_bin").agg(*(F.sum(c).cast(kind).alias(c) for c in two), F.max("_asked").alias("_asked"))
    before = W.partitionBy(*line).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*line, "_bin", "_asked", *(F.coalesce(F.sum(c).over(before).cast(kind), none).alias(c) for c in two)).where("_asked")
    inside = W.partitionBy(*line, "_bin").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    local = at.select(*line, "_bin", "_at", "_asked", *(F.sum(c).over(inside).cast(kind).alias(c) for c in two)).where("_asked")
    # Joins that take nulls as equal add no filters, which would make two exchanges of one; keys that are asked for are not null.
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*line, "_bin"]]
    each = local.alias("a").join(carry.alias("b"), on).select(*(F.col(f"a.{c}").alias(c) for c in [*line, "_at"]), *((F.col(f"a.{c}") + F.col(f"b.{c}")).cast(kind).alias(c) for c in two))
    lists = each.groupBy(*keys, "_at").agg(F.sort_array(F.collect_list(F.struct("_group", *two))).alias("_list"))
    found = queries
    for side in ("start", "end"):
        to = lists.select(*(F.col(k).alias(f"_q{i}") for i, k in enumerate(keys)), F.col("_at").alias("_q"), F.col("_list").alias(f"_{side}"))
        meet = F.col(side).cast("long").eqNullSafe(F.col("_q"))
        for i, k in enumerate(keys):
            meet = meet & F.col(k).eqNullSafe(F.col(f"_q{i}"))
        found = found.join(to, meet, "left").drop("_q", *(f"_q{i}" for i in range(len(keys))))
    both = F.zip_with("_start", "_end", lambda s, e: F.struct(e["_group"].alias("group"), (e["_begun"] - s["_ended"]).cast(kind).alias("total")))
    empty = F.transform("_groups", lambda g: F.struct(g["_group"].alias("group"), none.alias("total")))
    return found.crossJoin(groups).withColumn("_sums", F.coalesce(F.when(_can(keys), both), empty)).drop("_start", "_end", "_groups")


def count_hits(queries: DataFrame, stored: DataFrame, query_id: str, keys: Sequence[str] = ("contig",), width: int | None = None) -> DataFrame:
    """query_id, n_hits: as joins.batch_hits has them, without the hits."""
    rows = queries.select(query_id, *(k for k in keys if k != query_id), "start", "end")
    sums = overlap_sums(rows, stored, F.lit(1).cast("long"), None, keys, width)
    return sums.groupBy(query_id).agg(F.sum(F.coalesce(F.get("_sums", F.lit(0))["total"], F.lit(0).cast("long"))).alias("n_hits"))
