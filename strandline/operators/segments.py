"""Maximal segments with the set of data that cover them, and the resolution of annotations built on it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import bin_of, overlap_join
from .setops import MERGE_BIN, merge


#: Width of the bins in which long queries are cut.
PIECE = 1 << 12


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later expressions read and do not compute again, as they would inside their lambdas: an explode keeps projections apart."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _covered(hits: DataFrame, data: str, keys: Sequence[str]) -> DataFrame:
    """Each datum's hits merged, as `_data`, keys, start, end: what covers a place is the same, and a deep pile is one row. Of hits that begin together the longest counts."""
    rows = hits.where("start < end").select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col(data).alias("_data"))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    rows = rows.withColumn("_at", bin_of("start", MERGE_BIN)).repartition(*(F.col(c) for c in [*keys, "_data", "_at"]))
    return merge(rows.groupBy(*keys, "_data", "_at", "start").agg(F.max("end").alias("end")), [*keys, "_data"])


def hit_segments(queries: DataFrame, hits: DataFrame, data: str, query: Sequence[str] = ("query_id",), keys: Sequence[str] = ("contig",), width: int | None = None, piece: int = PIECE, raw: bool = False) -> DataFrame:
    """query columns, start, end, data (sorted array of the distinct data that cover it).

    A query may have several disjoint regions (rows with the same query columns). They are cut at every bound of an
    overlapping hit; neighbouring segments with equal sets merge, also across touching regions; gaps between regions
    give nothing; uncovered parts have an empty set. Null keys or bounds and empty regions give nothing.

    Each datum's hits are merged first, and each place is cut once, for all queries that have a region there: rows go with places
    and sets, not with pairs of queries and hits. Regions are cut into pieces of at most `piece` positions, so that a whole axis is
    many pieces. A place's hits come together as one array, in which it is cut. Only the first and the last segment of a piece of a
    query of several go through a window over their query. raw=True: only covered segments, which may end at pieces' and regions' bounds.
    """
    columns = list(dict.fromkeys([*query, *keys]))
    some = F.col("start") < F.col("end")
    for k in keys:
        some = some & F.col(k).isNotNull()
    regions = queries.select(*columns, "start", "end").where(some).distinct()
    pieces = regions.withColumn("_at", F.explode(F.sequence(bin_of("start", piece), bin_of(F.col("end") - 1, piece))))
    pieces = pieces.select(*columns, F.greatest("start", F.col("_at") * piece).alias("start"), F.least("end", (F.col("_at") + 1) * piece).alias("end"))
    place = [*keys, "start", "end"]
    joined = overlap_join(pieces.select(*place).distinct(), _covered(hits, data, keys).select(*keys, "start", "end", "_data"), keys, "inner", width)
    start, end, value = joined.columns[-3:]
    hit = F.struct(F.greatest("start", start).alias("s"), F.least("end", end).alias("e"), F.col(value).alias("d"))
    found = joined.groupBy(*place).agg(F.collect_list(hit).alias("_hits"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array("start", "end"), F.transform("_hits", lambda h: h["s"]), F.transform("_hits", lambda h: h["e"]))))
    found = once(found, "_cuts", cuts)
    covering = lambda a, b: F.array_sort(F.array_distinct(F.transform(F.filter("_hits", lambda h: (h["s"] <= a) & (b <= h["e"])), lambda h: h["d"])))
    segment = lambda a, i: F.struct(a.alias("s"), F.get("_cuts", i + 1).alias("e"), covering(a, F.get("_cuts", i + 1)).alias("d"))
    found = once(found, "_parts", F.transform(F.slice("_cuts", F.lit(1), F.size("_cuts") - 1), segment)).drop("_cuts", "_hits")
    if raw:
        return pieces.join(found, place).select(*query, F.explode("_parts").alias("p")).where(F.size("p.d") > 0).select(*query, F.col("p.s").alias("start"), F.col("p.e").alias("end"), F.col("p.d").alias("data"))
    # Neighbours of equal sets are one: segments begin where the set is another than before, and end where the next begins.
    found = once(found, "_firsts", F.filter("_parts", lambda p, i: (i == 0) | (F.get("_parts", i - 1)["d"] != p["d"])))
    ends = lambda p, i: F.struct(p["s"].alias("s"), F.coalesce(F.get("_firsts", i + 1)["s"], F.col("end")).alias("e"), p["d"].alias("d"), ((i == 0) | (i == F.size("_firsts") - 1)).alias("edge"))
    found = found.select(*place, F.transform("_firsts", ends).alias("_segments"))
    kind = found.schema["_segments"].dataType
    none = F.array(F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.array().alias("d"), F.lit(True).alias("edge"))).cast(kind)
    pieces = pieces.withColumn("_many", F.count("*").over(W.partitionBy(*query)) > 1)
    each = pieces.join(found, place, "left").select(*query, "_many", F.explode(F.coalesce("_segments", none)).alias("p"))
    each = each.select(*query, F.col("p.s").alias("start"), F.col("p.e").alias("end"), F.col("p.d").alias("data"), "_many", F.col("p.edge").alias("_edge"))
    line = W.partitionBy(*query).orderBy("start")
    edges = each.where("_many AND _edge").drop("_many", "_edge")
    fresh = F.coalesce((F.lag("end").over(line) != F.col("start")) | (F.lag("data").over(line) != F.col("data")), F.lit(True))
    marked = edges.withColumn("_fresh", fresh.cast("int")).withColumn("_run", F.sum("_fresh").over(line.rowsBetween(W.unboundedPreceding, 0)))
    whole = marked.groupBy(*query, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("data").alias("data")).drop("_run")
    return each.where("NOT (_many AND _edge)").drop("_many", "_edge").unionByName(whole)


def resolve_annotation(annotation: DataFrame, key: str, resolution: Callable, keys: Sequence[str] = ("contig", "orientation"), include_gaps: bool = False, width: int | None = None) -> DataFrame:
    """Elementary segments of overlapping annotations, each given to the keys that `resolution` keeps.

    resolution: a function of the column `data` (sorted array of covering keys) to an array of keys to keep; it may
    use the columns of `keys`, start and end. Gaps are passed as empty sets only with include_gaps.
    """
    spans = merge(annotation, keys)
    if include_gaps:
        spans = spans.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    parts = hit_segments(spans, annotation, key, list(keys), list(keys), width)
    if not include_gaps:
        parts = parts.where(F.size("data") > 0)
    kept = parts.withColumn("_kept", resolution(F.col("data")))
    return kept.select(*keys, "start", "end", F.explode("_kept").alias(key))
