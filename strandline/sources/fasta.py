"""FASTA files: reader, writer, index, and slices by index."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import Ranges, opened

WIDTH = 80


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, seq. The id is the whole line after `>`, as it is; blank lines and line ends inside a sequence go; a sequence
    is of ASCII letters and not empty, a file begins with `>`. Records are split at `>` that begins a line."""
    rows = spark.read.option("lineSep", "\n>").text(path).withColumn("file", F.input_file_name())
    # The first record of a file keeps its mark; others lose it to the separator, so one that has it is a damaged file.
    text = F.regexp_replace("value", "^>", "")
    parts = rows.where(F.length(F.regexp_replace("value", r"[\r\n]", "")) > 0).select(text.alias("t"))
    split = F.instr("t", "\n")
    seq = F.regexp_replace(F.col("t").substr(split + 1, F.length("t")), r"[\r\n]", "")
    out = parts.select(F.regexp_replace(F.substring_index("t", "\n", 1), "\r$", "").alias("id"), F.when((split > 0) & seq.rlike("^[A-Za-z]+$"), seq).otherwise(F.raise_error(F.concat(F.lit("FASTA: bad sequence of "), F.substring("t", 1, 80)))).alias("seq"))
    return out.select(F.when(F.length("id") > 0, F.col("id")).otherwise(F.raise_error(F.lit("FASTA: empty id"))).alias("id"), "seq")


def fasta_lines(df: DataFrame, width: int = WIDTH) -> DataFrame:
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return df.select(F.concat(F.lit(">"), F.col("id"), F.lit("\n"), wrapped).alias("value"))


def write_fasta(df: DataFrame, path: str, width: int = WIDTH, compression: str | None = None) -> None:
    fasta_lines(df, width).write.mode("overwrite").text(path, compression=compression)


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """id, length, offset, line_bases, line_bytes; values are positive, lines have more bytes than bases, ids do not repeat."""
    rows = spark.read.schema("id string, length long, offset long, line_bases long, line_bytes long").csv(path, sep="\t", mode="FAILFAST", quote="")
    good = (F.col("length") > 0) & (F.col("offset") > 0) & (F.col("line_bases") > 0) & (F.col("line_bytes") > F.col("line_bases")) & (F.count("*").over(W.partitionBy("id")) == 1)
    return rows.withColumn("_ok", good).withColumn("_ok", F.when(F.col("_ok"), True).otherwise(F.raise_error(F.concat(F.lit("FASTA index: bad line of "), F.col("id"))).cast("boolean"))).where("_ok").drop("_ok")


def fetch(queries: DataFrame, index: DataFrame, fasta: str) -> DataFrame:
    """queries(seqid, start, end) with `seq`, read as byte ranges of a file by its index; a blocked gzip file needs its .gzi beside it. A
    slice that is empty or beyond the end is an error."""
    asked = queries.join(index.select(F.col("id").alias("seqid"), F.col("length").alias("_n"), F.col("offset").alias("_o"), F.col("line_bases").alias("_b"), F.col("line_bytes").alias("_w")), "seqid", "left")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    names = queries.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = opened(fasta)
        with store.open_input_file(path) as file:
            content = Ranges(file, fasta)
            for rows in batches:
                out = []
                for s, e, n, o, b, w in zip(rows["start"], rows["end"], rows["_n"], rows["_o"], rows["_b"], rows["_w"], strict=True):
                    if not (n == n and 0 <= s < e <= n):
                        raise ValueError(f"no slice [{s}, {e}) of a sequence of length {n}")
                    at = lambda p, o=o, b=b, w=w: int(o + p // b * w + p % b)
                    out.append(content.read(at(s), at(e - 1) + 1 - at(s)).translate(None, b"\r\n").decode())
                yield rows[names].assign(seq=out)

    return asked.mapInPandas(run, fields + ", seq string")


def fetch_from(queries: DataFrame, sequences: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """As fetch, from a table (id, seq): sequences are cut into chunks, so slices meet chunks, not whole sequences."""
    n = F.expr(f"cast((length(seq) + {chunk - 1}) div {chunk} as int)")
    parts = sequences.select("id", "seq", F.length("seq").alias("_n")).withColumn("_k", F.explode(F.sequence(F.lit(0), n - 1)))
    parts = parts.select(F.col("id").alias("seqid"), F.col("_k").cast("long").alias("_k"), "_n", F.col("seq").substr((F.col("_k") * chunk + 1).cast("int"), F.lit(chunk)).alias("_seq"))
    asked = queries.withColumn("_k", F.explode(F.sequence(F.expr(f"start div {chunk}"), F.expr(f"(end - 1) div {chunk}"))))
    met = asked.join(parts, ["seqid", "_k"])
    s, e = F.greatest(F.col("start") - F.col("_k") * chunk, F.lit(0)), F.least(F.col("end") - F.col("_k") * chunk, F.lit(chunk))
    piece = F.col("_seq").substr((s + 1).cast("int"), (e - s).cast("int"))
    found = met.groupBy(*queries.columns).agg(F.array_sort(F.collect_list(F.struct("_k", piece.alias("p")))).alias("_p"), F.max("_n").alias("_n"))
    whole = F.array_join(F.transform("_p", lambda x: x["p"]), "")
    return found.select(*queries.columns, F.when(F.col("end") <= F.col("_n"), whole).otherwise(F.raise_error(F.lit("slice beyond the end"))).alias("seq"))


def lengths(sequences: DataFrame) -> DataFrame:
    return sequences.select("id", F.length("seq").cast("long").alias("length"))
