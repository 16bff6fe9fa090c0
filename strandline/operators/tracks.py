"""Tracks as run tables (keys, start, end, value): coverage, run-length coding, merges of runs.

Running sums over a long axis are made in two steps: sums for each bin, running sums of these few, and running
sums inside the bins, so that no task holds a whole axis.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import bin_of

BIN = 1 << 16


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, width: int = BIN) -> DataFrame:
    """df with the sum of `value` up to each row, for each key by `order` (distinct for each key)."""
    binned = df.withColumn("_bin", bin_of(order, width))
    totals = binned.groupBy(*keys, "_bin").agg(F.sum(value).alias("_total"))
    carry = totals.withColumn("_carry", F.coalesce(F.sum("_total").over(W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    inside = F.sum(value).over(W.partitionBy(*keys, "_bin").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_bin"]]
    joined = binned.withColumn("_inside", inside).alias("a").join(carry.alias("b"), on)
    return joined.select(*(F.col(f"a.{c}").alias(c) for c in df.columns), (F.col("b._carry") + F.col("a._inside")).alias(out))


def coverage(blocks: DataFrame, keys: Sequence[str] = ("contig", "orientation"), weight: Column | None = None, within: tuple[int, int] | None = None, width: int = BIN) -> DataFrame:
    """Runs of the summed weight (1 if not given) over the blocks, without zero runs; clipped to `within`.

    Weights are added up as decimals of 18 places, so what begins and ends cancels exactly, in any order, and no weight from 1e-18 on is lost.
    """
    rows = blocks.select(*keys, "start", "end", (F.lit(1).cast("long") if weight is None else weight.cast("decimal(38,18)")).alias("w")).where("start < end")
    if within:
        rows = rows.select(*keys, F.greatest("start", F.lit(within[0])).alias("start"), F.least("end", F.lit(within[1])).alias("end"), "w").where("start < end")
    events = rows.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.col("w").alias("w")), F.struct(F.col("end").alias("pos"), (-F.col("w")).alias("w")))).alias("e"))
    deltas = events.groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.w").alias("delta")).where("delta <> 0")
    sums = running_sum(deltas, keys, "pos", "delta", "level", width)
    runs = sums.withColumn("end", F.lead("pos").over(W.partitionBy(*keys).orderBy("pos"))).where("end IS NOT NULL AND level <> 0")
    # Neighbours differ in level, as deltas of 0 are gone, so these are runs already.
    return runs.select(*keys, F.col("pos").alias("start"), "end", F.col("level").cast("double").alias("value"))


def rle_encode(runs: DataFrame, keys: Sequence[str] = ("contig",)) -> DataFrame:
    """Neighbouring runs of equal values made one. Runs that do not touch stay apart."""
    order = W.partitionBy(*keys).orderBy("start")
    same = (F.lag("end").over(order) == F.col("start")) & F.lag("value").over(order).eqNullSafe(F.col("value"))
    marked = runs.withColumn("_fresh", (~F.coalesce(same, F.lit(False))).cast("int"))
    marked = marked.withColumn("_run", F.sum("_fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("value").alias("value")).drop("_run")


def rle_encode_tolerant(runs: DataFrame, sensitivity: float, keys: Sequence[str] = ("contig",)) -> DataFrame:
    """As rle_encode, but a run also takes in values within `sensitivity` of its first one; the order matters, so each key's runs, not its positions, go through one task."""

    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start").reset_index(drop=True)
        heads, ends = [], []
        for i, (s, e, v) in enumerate(zip(rows["start"], rows["end"], rows["value"], strict=True)):
            if heads and ends[-1] == s and abs(rows["value"].iat[heads[-1]] - v) <= sensitivity:
                ends[-1] = e
            else:
                heads.append(i)
                ends.append(e)
        out = rows.iloc[heads].copy()
        out["end"] = ends
        return out

    return runs.select(*keys, "start", "end", "value").groupBy(*keys).applyInPandas(encode, runs.select(*keys, "start", "end", "value").schema)


def rle_merge(tracks: Sequence[DataFrame], combine: Callable[[Column], Column], keys: Sequence[str] = ("contig",), alone: Callable[[Column], Column] | None = None) -> DataFrame:
    """Runs over the union of all tracks' bounds. `combine` makes a value of the array of those present, in the tracks'
    order; `alone`, if given, of the only one where one track is present. Places that no track covers give nothing."""
    marked = None
    for i, t in enumerate(tracks):
        one = t.select(*keys, "start", "end", F.col("value").cast("double").alias("value"), F.lit(i).alias("_i"))
        marked = one if marked is None else marked.union(one)
    events = marked.select(*keys, "_i", F.explode(F.array(F.struct(F.col("start").alias("p"), F.lit(1).alias("on"), F.col("value").alias("v")), F.struct(F.col("end").alias("p"), F.lit(0).alias("on"), F.lit(None).cast("double").alias("v")))).alias("e"))
    # Where a run ends and the next begins, the beginning counts.
    at = events.groupBy(*keys, F.col("e.p").alias("p")).agg(*(F.max(F.when(F.col("_i") == i, F.struct("e.on", "e.v"))).alias(f"_t{i}") for i in range(len(tracks))))
    order = W.partitionBy(*keys).orderBy("p")
    held = at.select(*keys, F.col("p").alias("start"), F.lead("p").over(order).alias("end"), *(F.last(f"_t{i}", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)).alias(f"_t{i}") for i in range(len(tracks))))
    present = F.filter(F.array(*(F.when(F.col(f"_t{i}.on") == 1, F.col(f"_t{i}.v")) for i in range(len(tracks)))), lambda v: v.isNotNull())
    both = held.where("end IS NOT NULL").withColumn("_v", present).where(F.size("_v") > 0)
    value = combine(F.col("_v"))
    if alone is not None:
        value = F.when(F.size("_v") == 1, alone(F.element_at("_v", 1))).otherwise(value)
    return rle_encode(both.select(*keys, "start", "end", value.alias("value")), keys)


def rle_merge2(left: DataFrame, right: DataFrame, two: Callable[[Column, Column], Column], keys: Sequence[str] = ("contig",), single: Callable[[Column], Column] | None = None) -> DataFrame:
    """Two tracks: two(a, b) where both are, single(a) (a itself if not given) where one is."""
    single = single or (lambda a: a)
    return rle_merge([left, right], lambda v: two(F.element_at(v, 1), F.try_element_at(v, F.lit(2))), keys, single)


def dense(runs: DataFrame, keys: Sequence[str] = ("contig",)) -> DataFrame:
    """A row for each position of the runs."""
    return runs.select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), "value")


def runs_of(values: np.ndarray, start: int = 0) -> list[tuple[int, int, float]]:
    """Runs of equal values of an array, for tests and kernels."""
    if not len(values):
        return []
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return [(start + int(a), start + int(b), float(values[a])) for a, b in zip(at, [*at[1:], len(values)], strict=True)]
