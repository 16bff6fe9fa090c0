"""Signal against control: models of coverage, enrichment, peaks, and filters of peaks by local baselines.

Tracks are run tables (keys, start, end, value). Positions are made rows only inside the regions that need them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import overlap_join
from .setops import merge
from .tracks import coverage, dense, rle_encode, rle_merge, rle_merge2

KEYS = ("contig", "orientation")
#: Bin width of the joins here: regions, peaks and runs are short. Given, so that no plan is run to find one.
WIDTH = 512


@dataclass(frozen=True)
class ControlModel:
    """Windows of the moving means, and whether the mean over all of a chain's links counts too."""

    windows: tuple[int, ...] = ()
    uniform_baseline: bool = False

    def __post_init__(self):
        if any(w <= 1 for w in self.windows):
            raise ValueError("a window is longer than 1")


@dataclass(frozen=True)
class Cutoff:
    """Peaks: runs of at least `cutoff`, joined over gaps of at most merge_within, longer than min_length."""

    cutoff: float = 0.0
    merge_within: int = 0
    min_length: int = 0


@dataclass(frozen=True)
class Nms:
    """Local filter. fold: factor on the local baseline; group_within and slop for the grouped variant."""

    fold: float = 1.0
    group_within: int = 0
    slop_fraction: float = 1.0
    slop_limits: tuple[int, int] = (0, 1 << 40)
    sensitivity: float = 1e-6

    def __post_init__(self):
        if self.fold < 1 or self.group_within < 0 or self.slop_fraction < 0 or not 0 <= self.slop_limits[0] <= self.slop_limits[1] or self.sensitivity <= 0:
            raise ValueError("fold >= 1, group_within >= 0, slop_fraction >= 0, 0 <= least slop <= most slop, sensitivity > 0")


def signal_model(blocks: DataFrame, min_signal: float = 0.0, keys: Sequence[str] = KEYS, weight=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(track with values of at most min_signal left out, covered regions, modelled regions)."""
    raw = coverage(blocks, keys, weight)
    covered = merge(raw, keys)
    kept = raw.where(F.col("value") > min_signal)
    return kept, covered, merge(kept, keys)


def smooth(track: DataFrame, chains: DataFrame, model: ControlModel, keys: Sequence[str] = KEYS, least: float = 1e-6) -> DataFrame:
    """Greatest of the moving means of each chain's values along its spliced axis: keys, pos, value.

    chains(chain_id, keys, start, end). A window w shorter than the chain gives, where it fits, the mean over
    [i - w // 2, i - w // 2 + w) at spliced position i; even windows are [i - w/2, i + w/2), odd ones are centred. Chains whose sum is below
    `least` are left out. Windows run over one chain's positions.
    """
    # Positions of links, with the track's values there and 0 elsewhere.
    before = W.partitionBy("chain_id").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    links = chains.select("chain_id", *keys, "start", "end").withColumn("_off", F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0)))
    places = links.select("chain_id", *keys, "_off", F.col("start").alias("_s"), F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    inside = overlap_join(links.select("chain_id", *keys, "start", "end"), track.select(*keys, "start", "end", "value"), keys, "inner", WIDTH)
    inside = inside.select("chain_id", F.greatest("start", "start_r").alias("start"), F.least("end", "end_r").alias("end"), F.col("value_r").alias("value"))
    values = dense(inside, ["chain_id"])
    rows = places.join(values, ["chain_id", "pos"], "left").select("chain_id", *keys, "pos", (F.col("_off") + F.col("pos") - F.col("_s")).alias("i"), F.coalesce("value", F.lit(0.0)).alias("v"))
    whole = W.partitionBy("chain_id")
    rows = rows.withColumn("n", F.count("*").over(whole)).withColumn("total", F.sum("v").over(whole)).where(F.col("total") >= least)
    line = W.partitionBy("chain_id").orderBy("i")
    means = [F.when(F.lit(model.uniform_baseline), F.col("total") / F.col("n"))]
    for w in model.windows:
        half = w // 2
        fits = (F.col("n") > w) & (F.col("i") >= half) & (F.col("i") - half + w <= F.col("n"))
        means.append(F.when(fits, F.avg("v").over(line.rowsBetween(-half, w - half - 1))))
    best = F.array_max(F.array(*means))
    return rows.withColumn("value", best).where(F.col("value").isNotNull()).groupBy(*keys, "pos").agg(F.max("value").alias("value"))


def control_model(blocks: DataFrame, chains: DataFrame, model: ControlModel, baseline: float = 0.0, keys: Sequence[str] = KEYS, weight=None, regions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(track, covered regions): coverage, raised to the smoothed models, and to `baseline` everywhere in `regions`."""
    raw = coverage(blocks, keys, weight)
    tracks = [raw]
    if model.windows or model.uniform_baseline:
        smoothed = smooth(raw, chains, model, keys)
        tracks.append(rle_encode(smoothed.select(*keys, F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.round("value", 9).alias("value")), keys))
    if regions is not None:
        tracks.append(merge(regions, keys).withColumn("value", F.lit(float(baseline))))
    track = rle_merge(tracks, lambda v: F.array_max(v), keys)
    track = rle_encode(track.withColumn("value", F.greatest("value", F.lit(float(baseline)))), keys)
    return track, merge(track.where("value > 0"), keys)


def enrichment(signal: DataFrame, control: DataFrame, signal_scale: float = 1.0, control_scale: float = 1.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """0 where there is no signal, else (signal * its scale) / (control * its scale); infinite where the control is 0 or absent."""
    inf = F.lit(float("inf"))

    def two(s, c):
        ratio = F.try_divide(s * F.lit(float(signal_scale)), c * F.lit(float(control_scale)))
        return F.when(s == 0, F.lit(0.0)).otherwise(F.coalesce(ratio, F.when(s > 0, inf).otherwise(-inf)))

    # Which of two tracks is alone matters, so both are made to cover what either does.
    both = merge(signal.select(*keys, "start", "end").union(control.select(*keys, "start", "end")), keys).withColumn("value", F.lit(0.0))
    full = [rle_merge2(t, both, lambda a, b: a, keys) for t in (signal, control)]
    return rle_merge2(full[0], full[1], two, keys)


def call_peaks(track: DataFrame, config: Cutoff, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, start, end, signal (greatest value, the first of equal ones), summit (middle of its run)."""
    runs = track.where(F.col("value") >= config.cutoff)
    order = W.partitionBy(*keys).orderBy("start")
    fresh = F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)) + config.merge_within, F.lit(True))
    marked = runs.withColumn("_peak", F.sum(fresh.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    middle = F.expr("(start + end) div 2")
    peaks = marked.groupBy(*keys, "_peak").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("value").alias("signal"), F.min_by(middle, F.struct(-F.col("value"), F.col("start"))).alias("summit"))
    return peaks.where(F.col("end") - F.col("start") > config.min_length).drop("_peak")


def _recall(rows: DataFrame, group: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Peaks of at least two positions over rows(group, keys, pos, v) that pass; the summit is the first greatest position."""
    order = W.partitionBy(*group).orderBy("pos")
    fresh = F.coalesce(F.col("pos") != F.lag("pos").over(order) + 1, F.lit(True))
    marked = rows.withColumn("_n", F.sum(fresh.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    found = marked.groupBy(*dict.fromkeys([*group, *keys]), "_n").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.max("v").alias("signal"), F.min_by("pos", F.struct(-F.col("v"), F.col("pos"))).alias("summit"))
    return found.where(F.col("end") - F.col("start") > 1).drop("_n")


def nms_uniform(peaks: DataFrame, rois: DataFrame, signal: DataFrame, control: DataFrame, config: Nms, keys: Sequence[str] = KEYS) -> DataFrame:
    """roi_id, keys, start, end, signal, summit: peaks called anew inside each region of interest (roi_id, keys, start, end - a row for each link).

    Over a region's positions with signal or control of at least the sensitivity: difference = signal - control,
    and the baseline is its mean above its least value. A region of a baseline at most the sensitivity gives none;
    in others the positions of peaks count with (difference - least) of at least baseline * fold.
    """
    rows = _positions(rois.select("roi_id", *keys, "start", "end"), signal, control, ["roi_id"], keys, config.sensitivity)
    whole = W.partitionBy("roi_id")
    rows = rows.withColumn("least", F.min("d").over(whole)).withColumn("base", F.avg("d").over(whole) - F.col("least")).where(F.col("base") > config.sensitivity)
    return _inside_peaks(rows, peaks, ["roi_id"], keys, config)


def _positions(regions: DataFrame, signal: DataFrame, control: DataFrame, group: Sequence[str], keys: Sequence[str], least: float) -> DataFrame:
    """group, keys, pos, d = signal - control, for positions of regions where either is at least `least`."""
    both = signal.select(*keys, "start", "end", F.col("value").alias("s"), F.lit(0.0).alias("c")).union(control.select(*keys, "start", "end", F.lit(0.0), "value"))
    hit = overlap_join(regions, both, keys, "inner", WIDTH)
    cut = hit.select(*dict.fromkeys([*group, *keys]), F.explode(F.sequence(F.greatest("start", "start_r"), F.least("end", "end_r") - 1)).alias("pos"), F.col("s_r").alias("s"), F.col("c_r").alias("c"))
    sums = cut.groupBy(*dict.fromkeys([*group, *keys]), "pos").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    return sums.where((F.col("s") >= least) | (F.col("c") >= least)).withColumn("d", F.col("s") - F.col("c"))


def _inside_peaks(rows: DataFrame, peaks: DataFrame, group: Sequence[str], keys: Sequence[str], config: Nms) -> DataFrame:
    passed = rows.withColumn("v", F.col("d") - F.col("least")).where(F.col("v") >= F.col("base") * config.fold)
    points = passed.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + 1)
    inside = overlap_join(points, peaks.select(*keys, "start", "end").withColumn("peak_start", F.col("start")), keys, "inner", WIDTH)
    inside = inside.select(*dict.fromkeys([*group, *keys]), "pos", "v", "peak_start_r")
    return _recall(inside, [*group, "peak_start_r"], keys).drop("peak_start_r")


def nms_slop(peaks: DataFrame, rois: DataFrame, signal: DataFrame, control: DataFrame, config: Nms, keys: Sequence[str] = KEYS, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """As nms_uniform, with a baseline for each group of peaks: peaks are mapped to their region's spliced axis and grouped
    within group_within; a group is widened on both sides by its length times slop_fraction, inside slop_limits, and
    mapped back. The mean divides the widened part's sum by the group's length without slop. cut: as in harvest.
    """
    from .mapping import invmap_intervals, map_intervals

    kinds = [F.first(k).alias(k) for k in keys]
    owner = rois.groupBy("roi_id").agg(*kinds)
    links = rois.select(F.col("roi_id").alias("chain_id"), "start", "end")
    met = overlap_join(peaks.select(*keys, "start", "end"), rois.select(*keys, "start", "end", "roi_id"), keys, "inner", WIDTH)
    asked = met.select(F.col("roi_id_r").alias("chain_id"), "start", "end").distinct().withColumn("query_id", F.concat_ws(":", "chain_id", "start", "end"))
    spliced = map_intervals(asked, links, width=WIDTH).where("status <> 'None'").select("chain_id", "start", "end")
    groups = merge(spliced, ["chain_id"], config.group_within)
    size = F.col("end") - F.col("start")
    total = links.groupBy("chain_id").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    slop = F.greatest(F.lit(config.slop_limits[0]), F.least(F.lit(config.slop_limits[1]), (size * config.slop_fraction).cast("long")))
    wide = cut(groups.join(total, "chain_id").select("chain_id", size.alias("size"), F.concat_ws(":", "chain_id", "start").alias("query_id"), F.greatest(F.col("start") - slop, F.lit(0)).alias("start"), F.least(F.col("end") + slop, F.col("n")).alias("end")))
    back = invmap_intervals(wide.select("query_id", "chain_id", "start", "end"), links, width=WIDTH).where("links IS NOT NULL")
    regions = back.join(wide.select("query_id", "size"), "query_id").select("query_id", F.col("chain_id").alias("roi_id"), "size", F.explode("links").alias("l"))
    regions = regions.select("query_id", "roi_id", "size", F.col("l.start").alias("start"), F.col("l.end").alias("end")).join(owner, "roi_id")
    rows = _positions(regions.select("query_id", "roi_id", "size", *keys, "start", "end"), signal, control, ["query_id", "roi_id", "size"], keys, config.sensitivity)
    whole = W.partitionBy("query_id")
    rows = rows.withColumn("least", F.min("d").over(whole)).withColumn("base", F.sum("d").over(whole) / F.col("size") - F.col("least")).where(F.col("base") > config.sensitivity)
    return _inside_peaks(rows, peaks, ["query_id", "roi_id"], keys, config).drop("query_id")


def shift_peaks(peaks: DataFrame, by: int) -> DataFrame:
    return peaks.withColumn("start", F.col("start") + by).withColumn("end", F.col("end") + by).withColumn("summit", F.col("summit") + by)


def harvest(signal_blocks: DataFrame, control_blocks: DataFrame, rois: DataFrame, control: ControlModel, cutoff: Cutoff, nms: Nms | None = None, keys: Sequence[str] = KEYS, weight=None, baseline: float = 1.0, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """One comparison from end to end, as a long table: kind (signal, control, modelled, peaks, filtered), keys, start, end, signal, summit.

    cut: applied to tracks and peaks, which are used several times; one that writes and rereads them has each computed once.
    """
    s, covered, modelled = map(cut, signal_model(signal_blocks, 0.0, keys, weight))
    c, _ = control_model(control_blocks, rois.withColumnRenamed("roi_id", "chain_id"), control, baseline, keys, weight, modelled)
    c = cut(c)
    control_covered = merge(c.where("value > 0"), keys)
    peaks = cut(call_peaks(enrichment(s, c, keys=keys), cutoff, keys))
    filtered = nms_slop(peaks, rois, s, c, nms, keys, cut) if nms and nms.group_within else nms_uniform(peaks, rois, s, c, nms or Nms(), keys)
    shape = lambda df, kind: df.select(F.lit(kind).alias("kind"), *keys, "start", "end", *((F.col(x) if x in df.columns else F.lit(None)).cast(t).alias(x) for x, t in (("signal", "double"), ("summit", "long"))))
    out = shape(covered, "signal")
    for df, kind in ((control_covered, "control"), (modelled, "modelled"), (peaks, "peaks"), (filtered, "filtered")):
        out = out.union(shape(df, kind))
    return out
