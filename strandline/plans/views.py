"""Interval tables derived from the test tables, in the same words for Spark and for SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days since 1992-01-01, in Spark's and in the SQL oracle's words.
_DAY = {"spark": "datediff({0}, date'1992-01-01')", "sql": "date_diff('day', DATE '1992-01-01', CAST({0} AS DATE))"}
READS = """SELECT DISTINCT concat('s', l_linenumber % 2) AS source,
 concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), DAY_l_shipdate) AS aln_id,
 concat('c', l_suppkey % 7) AS contig, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS orientation,
 CAST(DAY_l_shipdate * 10 + l_partkey % 10 AS BIGINT) AS start, CAST(DAY_l_shipdate * 10 + l_partkey % 10 + l_quantity AS BIGINT) AS "end",
 CAST(l_linenumber AS BIGINT) AS nh, CAST(l_partkey AS BIGINT) AS partkey, CAST(l_orderkey AS BIGINT) AS orderkey, CAST(l_suppkey AS BIGINT) AS suppkey
 FROM lineitem"""
ELEMENTS = """SELECT DISTINCT CAST(o_orderkey AS BIGINT) AS element, concat('c', o_custkey % 7) AS contig,
 CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS orientation,
 CAST(DAY_o_orderdate * 10 AS BIGINT) AS start, CAST(DAY_o_orderdate * 10 + 5 + o_orderkey % 40 AS BIGINT) AS "end", CAST(o_custkey AS BIGINT) AS custkey
 FROM orders"""
EVENTS = "SELECT CAST(user_id AS BIGINT) AS contig, CAST(event_id AS BIGINT) AS event_id, event_type, value FROM events"


def sql(template: str) -> str:
    out = template
    for c in ("l_shipdate", "o_orderdate"):
        out = out.replace(f"DAY_{c}", _DAY["sql"].format(c))
    return out


#: What the rows of a view are dealt by for its DISTINCT, before its columns are made of theirs: a column of the view each.
DEALT = {READS: "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), DAY_l_shipdate)", ELEMENTS: "CAST(o_orderkey AS BIGINT)"}
USED = re.compile(r"\b[lo]_[a-z]+\b")


#: The same for groups by place, which rows that repeat share: contig, orientation, start and end, as the view has them.
PLACE = {
    READS: ["concat('c', l_suppkey % 7)", "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END", "CAST(DAY_l_shipdate * 10 + l_partkey % 10 AS BIGINT)", "CAST(DAY_l_shipdate * 10 + l_partkey % 10 + l_quantity AS BIGINT)"],
    ELEMENTS: ["concat('c', o_custkey % 7)", "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END", "CAST(DAY_o_orderdate * 10 AS BIGINT)", "CAST(DAY_o_orderdate * 10 + 5 + o_orderkey % 40 AS BIGINT)"],
}


def frame(spark: SparkSession, sf_dir: str, template: str, repeated: bool = False, by_place: bool = False) -> DataFrame:
    """The view's rows. Those of READS come dealt by aln_id, those of ELEMENTS by element, so a DISTINCT or groups by these move no row again.

    What moves are the table's columns that the view reads, not the view's, which are three times as wide.
    repeated: without the DISTINCT, as the rows lie in the table, for what repeated rows do not change.
    by_place: dealt by contig, orientation, start and end instead.
    """
    out, deal = template.replace('"end"', "`end`"), [DEALT[template]] if template in DEALT else []
    if repeated:
        out, deal = out.replace("SELECT DISTINCT", "SELECT", 1), []
    elif by_place:
        deal = PLACE[template]
    for c in ("l_shipdate", "o_orderdate"):
        out = out.replace(f"DAY_{c}", _DAY["spark"].format(c))
        deal = [x.replace(f"DAY_{c}", _DAY["spark"].format(c)) for x in deal]
    head, _, tail = out.rpartition("FROM ")
    name = tail.strip()
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if deal:
        rows = rows.select(*dict.fromkeys(USED.findall(head))).repartition(*map(F.expr, deal))
    return spark.sql(f"{head}FROM {{t}}", t=rows)


def reads(spark: SparkSession, sf_dir: str, repeated: bool = False, by_place: bool = False) -> DataFrame:
    return frame(spark, sf_dir, READS, repeated, by_place)


def elements(spark: SparkSession, sf_dir: str, by_place: bool = False) -> DataFrame:
    return frame(spark, sf_dir, ELEMENTS, by_place=by_place)
