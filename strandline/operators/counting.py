"""Weighted counts of alignments for annotated elements, with pluggable resolution of conflicts.

alignments: source, aln_id, contig, orientation, start, end, nh - a row for each block of an alignment.
elements: element, contig, orientation, start, end - a row for each segment of an element.
Only rows of the same contig and orientation meet; a dual alignment hits dual elements only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.intervals import merged_array
from .joins import overlap_flags, overlap_join
from .segments import hit_segments, once
from .setops import merge
from .sums import overlap_sums
from .tracks import running_sum

KEYS = ("contig", "orientation")
ALN = ("source", "aln_id")
#: Units of a weight of 1 in which weights are added up exactly.
UNITS = 1e15


def merged_elements(elements: DataFrame) -> DataFrame:
    """Each element's segments, merged for each contig and orientation."""
    return merge(elements, ("element", *KEYS))


def within_partitions(alignments: DataFrame, partitions: DataFrame, width: int | None = None) -> DataFrame:
    """Alignments of which any block touches a partition (contig, start, end); each once, however many it touches."""
    hit = overlap_join(alignments, merge(partitions), ["contig"], "semi", width).select(*ALN).distinct()
    return alignments.join(hit, list(ALN), "left_semi")


def element_partitions(elements: DataFrame, partitions: DataFrame, width: int | None = None) -> DataFrame:
    """element, contig, orientation, start, end, part_start, part_end: merged segments in each merged partition that they touch, whole."""
    joined = overlap_join(merged_elements(elements), merge(partitions), ["contig"], "inner", width)
    return joined.select("element", *KEYS, "start", "end", F.col("start_r").alias("part_start"), F.col("end_r").alias("part_end"))


def elements_without_partition(elements: DataFrame, partitions: DataFrame, width: int | None = None) -> DataFrame:
    found = element_partitions(elements, partitions, width).select("element").distinct()
    return elements.select("element").distinct().join(found, "element", "left_anti")


# ---- resolutions: (alignments, elements, width) -> (source, aln_id, element, weight)


def any_overlap(alignments: DataFrame, elements: DataFrame, width: int | None = None) -> DataFrame:
    """Each distinct element that an alignment overlaps gets 1 / nh."""
    hits = overlap_join(alignments, elements, KEYS, "inner", width)
    return hits.select(*ALN, F.col("element_r").alias("element"), (F.lit(1.0) / F.col("nh")).alias("weight")).distinct()


def _marked(t: DataFrame, names: Sequence[str]) -> DataFrame:
    """t with `_many`: whether rows share these columns, or may, as one is null."""
    many = F.count("*").over(W.partitionBy(*names)) > 1
    for c in names:
        many = many | F.col(c).isNull()
    return t.withColumn("_many", many)


def _any_units(alignments: DataFrame, elements: DataFrame, width: int | None = None) -> DataFrame:
    """source, element, units: what any_overlap gives to each element, and each source, in units; maybe several rows of one, to be added up.

    Running sums count each pair of a block and a segment. Only alignments of several blocks, and elements of several segments, can meet
    more than once: these are joined, and what they have too much is taken back.
    """
    unit = lambda w: F.round(w * UNITS).cast("decimal(38,0)")
    every = overlap_sums(elements.select("element", *KEYS, "start", "end"), alignments, unit(F.lit(1.0) / F.col("nh")), F.col("source"), KEYS, width)
    every = every.select("element", F.explode("_sums").alias("x")).select(F.col("x.group").alias("source"), "element", F.col("x.total").alias("units"))

    a, e = _marked(alignments.select(*ALN, *KEYS, "start", "end", "nh"), ALN), _marked(elements.select("element", *KEYS, "start", "end"), ["element"])
    # Where nothing comes in several parts, no alignment is dealt to bins.
    reach = F.broadcast(e.where("_many").groupBy(*KEYS).agg(F.min("start").alias("_low"), F.max("end").alias("_high"), F.lit(True).alias("_near")))
    a = a.join(reach, list(KEYS), "left").where(F.col("_many") | (F.col("_near") & (F.col("start") < F.col("_high")) & (F.col("end") > F.col("_low")))).drop("_low", "_high", "_near")
    met = overlap_join(a, e, KEYS, "inner", width).where(F.col("_many") | F.col("_many_r"))
    again = met.groupBy(*ALN, F.col("element_r").alias("element"), (F.lit(1.0) / F.col("nh")).alias("_w")).agg(F.count("*").alias("_n")).where("_n > 1")
    return every.unionByName(again.select("source", "element", ((F.lit(1) - F.col("_n")) * unit(F.col("_w"))).cast("decimal(38,0)").alias("units")))


any_overlap.units = _any_units


def _totals(alignments: DataFrame) -> DataFrame:
    """An alignment's merged blocks, with `total`, their length."""
    # An alignment has a handful of blocks: they are merged as one array, and their total goes with each of them.
    blocks = F.col("_blocks")
    merged = alignments.groupBy(*ALN, *KEYS, "nh").agg(F.collect_set(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))).alias("_blocks"))
    # Empty blocks go here, not by a filter on the rows, which would go down to the reading, and make two exchanges of one.
    merged = merged.select(*ALN, *KEYS, "nh", F.filter("_blocks", lambda b: b["start"] < b["end"]).alias("_set"))
    merged = once(merged, "_blocks", F.when(F.size("_set") == 1, F.col("_set")).otherwise(merged_array("_set")))
    total = F.aggregate(blocks, F.lit(0).cast("long"), lambda t, b: t + b["end"] - b["start"])
    return merged.select(*ALN, *KEYS, "nh", total.alias("total"), F.explode(blocks).alias("b")).select(*ALN, *KEYS, "nh", "total", F.col("b.start").alias("start"), F.col("b.end").alias("end"))


def overlap_weighted(alignments: DataFrame, elements: DataFrame, width: int | None = None) -> DataFrame:
    """Each segment of an alignment's blocks has the weight length / (total length * nh), shared equally by the elements that cover it."""
    segments = hit_segments(_totals(alignments), elements, "element", [*ALN, *KEYS, "nh", "total"], KEYS, width, raw=True)
    share = (F.col("end") - F.col("start")) / (F.col("total") * F.col("nh") * F.size("data"))
    return segments.select(*ALN, share.alias("weight"), F.explode("data").alias("element")).select(*ALN, "element", "weight")


def _cut(segments: DataFrame) -> DataFrame:
    """The axes cut at every bound of the segments: start, end, and n, how many segments cover it, of what some do."""
    events = segments.select(*KEYS, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    deltas = events.groupBy(*KEYS, F.col("x.at").alias("start")).agg(F.sum("x.d").alias("_d"))
    after = F.lead("start").over(W.partitionBy(*KEYS).orderBy("start"))
    return running_sum(deltas, KEYS, "start", "_d", "n").withColumn("end", after).where("n > 0").select(*KEYS, "start", "end", "n")


#: Width of the bins in which blocks meet the parts of the cut axis, of which there may be one for each position.
PART_BIN = 32


def _weighted_units(alignments: DataFrame, elements: DataFrame, width: int | None = None) -> DataFrame:
    """source, element, units: what overlap_weighted gives to each element, and each source, in units; maybe several rows of one, to be added up.

    Between two bounds of elements all of them share alike. So what alignments give is added up for each such part, and an element has the
    sum of its parts, a difference of running sums: no row is made for a pair of an alignment and an element.
    """
    held = elements.select("element", *KEYS, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).where("start < end")
    for k in KEYS:
        held = held.where(F.col(k).isNotNull())
    held = merged_elements(held)
    # Blocks of the same place are a number. As all columns and the number are asked for wherever the join reads them, there is one exchange for both.
    blocks = _totals(alignments).select("source", *KEYS, "start", "end", (F.col("total") * F.col("nh")).alias("_whole"))
    blocks = blocks.groupBy(*blocks.columns).agg(F.count("*").alias("_n")).where("_n > 0")
    met = overlap_join(blocks, _cut(held), KEYS, "inner", PART_BIN)
    length = F.least("end", "end_r") - F.greatest("start", "start_r")
    x = length / (F.col("_whole") * F.col("n_r")) * UNITS
    # As round has it, but for its decimals of any size; a half is exact in this range.
    units = F.when((x >= 0) & (x < float(1 << 51)), F.floor(x + 0.5)).otherwise(F.round(x).cast("long"))
    parts = met.select("source", *KEYS, F.col("start_r").alias("start"), F.col("end_r").alias("end"), units.alias("_u"), "_n")
    # Two longs add up faster than one decimal, and hold 9e9 rows of any weight.
    low = F.col("_u") % 10**9
    parts = parts.groupBy("source", *KEYS, "start", "end").agg(F.sum(low * F.col("_n")).alias("_low"), F.sum(F.expr("_u DIV 1000000000") * F.col("_n")).alias("_high"))
    whole = (F.col("_high").cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)") + F.col("_low").cast("decimal(20,0)")).cast("decimal(38,0)")
    every = overlap_sums(held, parts, whole, F.col("source"), KEYS, width)
    every = every.select("element", F.explode("_sums").alias("x")).select(F.col("x.group").alias("source"), "element", F.col("x.total").alias("units"))
    return every.unionByName(_every(alignments, elements).withColumn("units", F.lit(0).cast("decimal(38,0)")))


overlap_weighted.units = _weighted_units


def top_ranked(ranks: DataFrame) -> Callable:
    """ranks(element, rank): an alignment counts 1, whatever its nh, for the element of the least rank (ties: least element); elements without a rank come last."""

    def foremost(elements: DataFrame) -> DataFrame:
        """Segments with `_best`, the element and its place, without those that lie inside a better one: who meets these meets that, too."""
        place = F.struct(F.col("rank").isNull().alias("last"), "rank", "element")
        rows = elements.select("element", *KEYS, "start", "end").where("start < end").join(ranks, "element", "left").groupBy(*KEYS, "start", "end").agg(F.min(place).alias("_best"))
        for side, order in (("start", F.col("end").desc()), ("end", F.col("start"))):
            line = W.partitionBy(*KEYS, side).orderBy(order)
            rows = rows.withColumn("_top", F.min("_best").over(line)).where(F.col("_top").eqNullSafe(F.col("_best"))).drop("_top")
        return rows

    def resolve(alignments: DataFrame, elements: DataFrame, width: int | None = None) -> DataFrame:
        hits = overlap_join(alignments.select(*ALN, *KEYS, "start", "end"), foremost(elements), KEYS, "inner", width)
        best = hits.groupBy(*ALN).agg(F.min("_best_r").alias("best"))
        return best.select(*ALN, F.col("best.element").alias("element"), F.lit(1.0).alias("weight"))

    def units(alignments: DataFrame, elements: DataFrame, width: int | None = None) -> DataFrame:
        """source, element, units. Alignments of one block have no need of their names: those of the same place are a number."""
        place = [*KEYS, "start", "end"]
        a = _marked(alignments.select(*ALN, *place), ALN).select("source", "_many", F.when(F.col("_many"), F.col("aln_id")).alias("_aln"), *place)
        a = a.groupBy("source", "_many", "_aln", *place).agg(F.count("*").alias("_n"))
        hits = overlap_join(a, foremost(elements), KEYS, "inner", width)
        # Blocks of one alignment are one group; else each place is.
        own = [F.when(~F.col("_many"), F.col(c)).alias(f"_p{i}") for i, c in enumerate(place)]
        best = hits.groupBy("source", "_many", "_aln", *own).agg(F.min("_best_r").alias("_best"), F.max(F.when(F.col("_many"), 1).otherwise(F.col("_n"))).alias("_n"))
        found = best.select("source", F.col("_best.element").alias("element"), (F.col("_n").cast("decimal(20,0)") * F.lit(int(UNITS)).cast("decimal(17,0)")).cast("decimal(38,0)").alias("units"))
        found = found.groupBy("source", "element").agg(F.sum("units").cast("decimal(38,0)").alias("units"))
        return found.unionByName(_every(alignments, elements).withColumn("units", F.lit(0).cast("decimal(38,0)")))

    resolve.units = units
    return resolve


# ---- engine


def count(alignments: DataFrame, elements: DataFrame, resolution: Callable = any_overlap, partitions: DataFrame | None = None, width: int | None = None, zeros: bool = True) -> DataFrame:
    """source, element, count. With zeros, every element has a row for every source."""
    if partitions is not None:
        alignments = within_partitions(alignments, partitions, width)
        used = overlap_join(elements, merge(partitions), ["contig"], "semi", width)
    else:
        used = elements
    # Weights are added up in whole units, so that reruns agree whatever the order of the rows.
    total = lambda units: (F.sum(units).cast("double") / UNITS).alias("count")
    if zeros and hasattr(resolution, "units"):
        # The resolution has its own way to its sums, without a row for each pair, and with the zero rows.
        units = resolution.units(alignments, used, width)
        if partitions is not None:
            units = units.unionByName(_every(alignments, elements).withColumn("units", F.lit(0).cast("decimal(38,0)")))
        known = F.when(F.col("element").isNotNull(), F.col("units"))
        # Null sources go last: a filter on the column itself would go down to the reading, and make two exchanges of one.
        named = units.groupBy("source", "element").agg(total(known), F.max(F.col("source").isNotNull()).alias("_named")).where("_named")
        return named.select("source", "element", F.coalesce("count", F.lit(0.0)).alias("count"))
    sums = resolution(alignments, used, width).groupBy("source", "element").agg(total(F.round(F.col("weight") * UNITS).cast("decimal(38,0)")))
    if not zeros:
        return sums
    return _every(alignments, elements).join(sums, ["source", "element"], "left").select("source", "element", F.coalesce("count", F.lit(0.0)).alias("count"))


def _every(alignments: DataFrame, elements: DataFrame) -> DataFrame:
    """source, element: every element with every source, which is the size of the result. Sources are labels of samples; they come as one array."""
    sources = alignments.agg(F.collect_set("source").alias("_sources"))
    return elements.select("element").distinct().crossJoin(sources).select(F.explode("_sources").alias("source"), "element")


def outcomes(alignments: DataFrame, elements: DataFrame, width: int | None = None) -> DataFrame:
    """source, resolved, discarded: alignments with and without any hit, unweighted."""
    flags = overlap_flags(alignments, elements, KEYS, width).groupBy(*ALN).agg(F.max("_hit").alias("hit"))
    return flags.groupBy("source").agg(F.count_if(F.col("hit")).alias("resolved"), F.count_if(~F.col("hit")).alias("discarded"))


def partition_metrics(alignments: DataFrame, elements: DataFrame, partitions: DataFrame, width: int | None = None) -> DataFrame:
    """source, contig, part_start, part_end, resolved, discarded: an alignment counts in each merged partition that it touches."""
    flags = overlap_flags(alignments, elements, KEYS, width)
    met = overlap_join(flags, merge(partitions), ["contig"], "inner", width)
    each = met.groupBy(*ALN, "contig", F.col("start_r").alias("part_start"), F.col("end_r").alias("part_end")).agg(F.max("_hit").alias("hit"))
    return each.groupBy("source", "contig", "part_start", "part_end").agg(F.count_if(F.col("hit")).alias("resolved"), F.count_if(~F.col("hit")).alias("discarded"))


def wide(counts: DataFrame, elements: Sequence[str]) -> DataFrame:
    """A row for each source, a column for each of the named elements."""
    return counts.groupBy("source").pivot("element", list(elements)).agg(F.sum("count"))
