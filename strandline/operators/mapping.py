"""Coordinates through chains of links: genomic to spliced, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import overlap_join


def chain_links(chains: DataFrame, chain: str = "chain_id") -> DataFrame:
    """chains(chain, start, end), a row for each link, with `offset`: the spliced position of its start."""
    before = W.partitionBy(chain).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    return chains.withColumn("offset", F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0)).cast("long"))


def _status(mapped, wanted):
    return F.when(mapped.isNull(), "None").when(mapped == wanted, "Complete").otherwise("Truncated")


def map_intervals(queries: DataFrame, chains: DataFrame, chain: str = "chain_id", query: str = "query_id", width: int | None = None) -> DataFrame:
    """query, chain, status, start, end: where queries(query, chain, start, end) lie on the spliced axis. Complete: all
    of the query is in links; Truncated: a part; None: nothing, with null bounds."""
    links = chain_links(chains, chain)
    hit = overlap_join(queries.select(query, chain, "start", "end"), links.select(chain, "start", "end", "offset"), [chain], "inner", width)
    s, e = F.greatest("start", "start_r"), F.least("end", "end_r")
    place = hit.select(query, chain, (F.col("offset_r") + s - F.col("start_r")).alias("s"), (F.col("offset_r") + e - F.col("start_r")).alias("e"))
    found = place.groupBy(query, chain).agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum(F.col("e") - F.col("s")).alias("n"))
    out = queries.select(query, chain, (F.col("end") - F.col("start")).alias("wanted")).join(found, [query, chain], "left")
    return out.select(query, chain, _status(F.col("n"), F.col("wanted")).alias("status"), F.col("s").alias("start"), F.col("e").alias("end"))


def invmap_intervals(queries: DataFrame, chains: DataFrame, chain: str = "chain_id", query: str = "query_id", width: int | None = None) -> DataFrame:
    """query, chain, status, links (array of genomic intervals, in order; null if none) of queries on the spliced axis."""
    links = chain_links(chains, chain)
    spliced = links.select(chain, F.col("offset").alias("start"), (F.col("offset") + F.col("end") - F.col("start")).alias("end"), F.col("start").alias("genomic"))
    hit = overlap_join(queries.select(query, chain, "start", "end"), spliced, [chain], "inner", width)
    s, e = F.greatest("start", "start_r"), F.least("end", "end_r")
    shift = F.col("genomic_r") - F.col("start_r")
    found = hit.groupBy(query, chain).agg(F.array_sort(F.collect_list(F.struct((s + shift).alias("start"), (e + shift).alias("end")))).alias("links"), F.sum(e - s).alias("n"))
    out = queries.select(query, chain, (F.col("end") - F.col("start")).alias("wanted")).join(found, [query, chain], "left")
    return out.select(query, chain, _status(F.col("n"), F.col("wanted")).alias("status"), "links")
