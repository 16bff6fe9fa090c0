"""Set operations on interval tables.

Runs over a key's whole axis are made in two steps: inside bins first, where most intervals merge away, then
over what is left, so that a long axis is no single task's work until it is small. Where the data are sparse (about an
island for each bin), what is left are the islands, and a key's are one task's sort.

Rows with null keys are a group of their own to ``merge``, and match nothing elsewhere: they stay, whole or without a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import bin_of, overlap_flags, overlap_join

#: Width of the bins of the first step.
MERGE_BIN = 1 << 16
#: Equal rows that are made of one at once.
RUN = 1 << 12


def _islands(df: DataFrame, keys: Sequence[str], distance: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") > before + distance, F.lit(True)).cast("int")
    marked = df.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("_n").alias("_n")).drop("_island")


def merge(df: DataFrame, keys: Sequence[str] = ("contig",), distance: int = 0, bin_width: int = MERGE_BIN, counts: bool = False) -> DataFrame:
    """Union of each key's intervals, those with gaps of at most `distance` between them joined: touching ones merge. counts: adds n_merged."""
    rows = df.select(*keys, "start", "end", F.lit(1).cast("long").alias("_n"))
    local = _islands(rows.withColumn("_bin", bin_of("start", bin_width)), [*keys, "_bin"], distance).drop("_bin")
    out = _islands(local, keys, distance)
    return out.withColumnRenamed("_n", "n_merged") if counts else out.drop("_n")


def merge_within(df: DataFrame, distance: int, keys: Sequence[str] = ("contig",), **options) -> DataFrame:
    return merge(df, keys, distance, **options)


def group_within(df: DataFrame, distance: int, keys: Sequence[str] = ("contig",), width: int | None = None) -> DataFrame:
    """df with `group_start`: the start of the island, with gaps up to `distance`, that each interval belongs to; null for null keys or bounds and empty intervals."""
    islands = merge(df.where("start < end"), keys, distance)
    found = overlap_join(df, islands.withColumn("group_start", F.col("start")), keys, "inner", width)
    group = found.columns[-1]
    odd = F.col("start") < F.col("end")
    for k in keys:
        odd = odd & F.col(k).isNotNull()
    rest = df.where(~F.coalesce(odd, F.lit(False))).withColumn("group_start", F.lit(None).cast("long"))
    return found.select(*df.columns, F.col(group).alias("group_start")).unionByName(rest)


def overlap(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("contig",), width: int | None = None, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All pairwise intersections, as a bag.

    Places of either side are joined once, with their numbers of rows, and the pairs' rows are made again at the end, those of a pair of
    places beside each other: what moves, is sorted and is compared are places, and equal rows in a run take next to no room in a file. cut: what
    the places, which are used twice, are kept by.
    """
    places = [cut(t.groupBy(*keys, "start", "end").agg(F.count("*").alias("_n"))) for t in (left.where("start < end"), right.where("start < end"))]
    joined = overlap_join(*places, keys, "inner", width)
    rows = joined.select(*keys, F.greatest("start", "start_r").alias("start"), F.least("end", "end_r").alias("end"), (F.col("_n") * F.col("_n_r")).alias("_n"))
    rows = rows.withColumn("_before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(RUN).cast("long"))))
    rows = rows.withColumn("_row", F.explode(F.array_repeat(F.lit(True), F.least(F.lit(RUN), F.col("_n") - F.col("_before")).cast("int"))))
    return rows.select(*keys, "start", "end")


def overlaps(source: DataFrame, other: DataFrame, keys: Sequence[str] = ("contig",), width: int | None = None) -> DataFrame:
    """source with `overlaps`: whether any interval of other overlaps the row."""
    return overlap_flags(source, other, keys, width).withColumnRenamed("_hit", "overlaps")


def subtract(source: DataFrame, drop: DataFrame, keys: Sequence[str] = ("contig",), width: int | None = None) -> DataFrame:
    """What is left of each source row without all of drop: other columns are kept, sources are not merged. A row that is
    wholly covered gives none."""
    # Holes belong to keys and bounds, not to row ids, which a task that runs again may give to other rows.
    bounds = source.select(*keys, "start", "end").distinct()
    holes = overlap_join(bounds, merge(drop, keys), keys, "inner", width)
    cut = holes.groupBy(*keys, "start", "end").agg(F.array_sort(F.collect_list(F.struct(F.col("start_r").alias("start"), F.col("end_r").alias("end")))).alias("_holes"))
    whole = source.join(cut, [*keys, "start", "end"], "left").select(*source.columns, "_holes")
    # Gaps lie between the row's start, the holes, and its end.
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    h = F.coalesce("_holes", none)
    starts = F.concat(F.array(F.col("start").cast("long")), F.transform(h, lambda x: x["end"].cast("long")))
    ends = F.concat(F.transform(h, lambda x: x["start"].cast("long")), F.array(F.col("end").cast("long")))
    gaps = F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda g: g["s"] < g["e"])
    rest = [c for c in source.columns if c not in ("start", "end")]
    out = whole.withColumn("_gap", F.explode(gaps))
    return out.select(*rest, F.col("_gap.s").alias("start"), F.col("_gap.e").alias("end")).select(*source.columns)


def split_tasks(df: DataFrame, max_size: int, keys: Sequence[str] = ("contig",)) -> DataFrame:
    """Merged intervals cut into chunks of at most `max_size` from each merged start on; neighbouring chunks are packed
    into one task while they end within `max_size` of its first start: task_start, start, end.

    Packing is sequential, so each key's chunks, which are few beside the data they stand for, are packed in one task.
    """
    import pandas as pd

    chunks = merge(df, keys).withColumn("_at", F.explode(F.sequence("start", F.col("end") - 1, F.lit(max_size))))
    chunks = chunks.select(*keys, F.col("_at").cast("long").alias("start"), F.least(F.col("_at") + max_size, "end").cast("long").alias("end"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start").reset_index(drop=True)
        first, out = None, []
        for s, e in zip(rows["start"], rows["end"], strict=True):
            if first is None or e > first + max_size:
                first = s
            out.append(first)
        return rows.assign(task_start=out)[[*keys, "task_start", "start", "end"]]

    kinds = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in keys)
    return chunks.groupBy(*keys).applyInPandas(pack, f"{kinds}, task_start long, start long, end long")
