"""GFF3 records for transcript models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "seqid string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"


def read_gff(spark: SparkSession, path: str, ignore_sources: tuple[str, ...] = (), ignore_types: tuple[str, ...] = (), keep: Column | None = None) -> DataFrame:
    """seqid, source, type, start (0-based), end, score, strand, phase, attributes (map). Lines that begin with # and ignored records go, and those for which `keep` is not true."""
    rows = spark.read.schema(COLUMNS).csv(path, sep="\t", comment="#", mode="FAILFAST", quote="")
    rows = rows.withColumn("start", F.col("start") - 1).withColumn("attributes", F.str_to_map(F.regexp_replace("attributes", ";+$", ""), F.lit(";"), F.lit("=")))
    rows = rows.where(~F.col("source").isin(*ignore_sources) & ~F.col("type").isin(*ignore_types)) if ignore_sources or ignore_types else rows
    return rows.where(keep) if keep is not None else rows


def by_id(records: DataFrame, key: str = "ID") -> DataFrame:
    """type, id, records (array): the records of each id, by place. An id of two types is an error."""
    ids = records.withColumn("id", F.try_element_at("attributes", F.lit(key))).where(F.col("id").isNotNull())
    each = F.struct("seqid", "source", "start", "end", "score", "strand", "phase", "attributes")
    whole = ids.groupBy("id").agg(F.collect_set("type").alias("_t"), F.collect_list(each).alias("records"))
    kind = F.when(F.size("_t") == 1, F.element_at("_t", 1)).otherwise(F.raise_error(F.concat(F.lit("GFF: an id of two types: "), F.col("id"))))
    in_order = F.array_sort(F.col("records"), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise((a["end"] - b["end"]).cast("int")))
    return whole.select(kind.alias("type"), "id", in_order.alias("records"))
