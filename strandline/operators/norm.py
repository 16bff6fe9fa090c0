"""Library normalisation by median of ratios, in long format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaling_factors(values: DataFrame, min_value: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """values(region, sample, value), replicates as further rows, to (raw sums, kept rows, factors(sample, factor)).

    Kept are regions where any sample reaches min_value. Each sample's factor is exp of the median, over the kept
    regions in which all samples are positive, of log(value) less the region's mean log.
    """
    raw = values.groupBy("region", "sample").agg(F.sum("value").alias("value"))
    good = raw.groupBy("region").agg(F.max("value").alias("most")).where(F.col("most") >= min_value).select("region")
    kept = raw.join(good, "region", "left_semi")
    # One number: how many samples there are; a region that lacks one has a zero there.
    samples = raw.select("sample").distinct().count()
    means = kept.where("value > 0").groupBy("region").agg(F.avg(F.log("value")).alias("mean"), F.count("*").alias("n")).where(F.col("n") == samples).select("region", "mean")
    ratios = kept.join(means, "region").select("sample", (F.log("value") - F.col("mean")).alias("ratio"))
    factors = ratios.groupBy("sample").agg(F.exp(F.percentile("ratio", 0.5)).alias("factor"))
    return raw, kept, factors


def normalise(values: DataFrame, min_value: float = 0.0) -> DataFrame:
    """region, sample, value / factor of the raw sums."""
    raw, _, factors = scaling_factors(values, min_value)
    return raw.join(factors, "sample").select("region", "sample", (F.col("value") / F.col("factor")).alias("value"))


def rename(values: DataFrame, names: dict[str, str]) -> DataFrame:
    """Samples renamed; others stay."""
    if not names:
        return values
    pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return values.withColumn("sample", F.coalesce(F.try_element_at(pairs, F.col("sample")), F.col("sample")))
