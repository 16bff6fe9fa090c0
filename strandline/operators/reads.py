"""Read transforms: flag filters, strand deduction, CIGAR blocks, mates.

reads: qname, flags, contig, start (0-based), mapq, cigar array<struct<op, len>>, seq, quals array<int>, nh, hi.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import merged_array

BLOCKS = "array<struct<start: bigint, end: bigint>>"
REVERSE, FIRST = 16, 64



def flag_filter(reads: DataFrame, inflags: int = 0, exflags: int = 516, min_mapq: int = 0) -> DataFrame:
    """Reads with all of inflags, none of exflags and at least min_mapq; a missing quality counts as 255."""
    flags = F.col("flags")
    return reads.where((flags.bitwiseAND(inflags) == inflags) & (flags.bitwiseAND(exflags) == 0) & (F.coalesce("mapq", F.lit(255)) >= min_mapq))


def in_region(reads: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """A region scan: contig and start go down to the files; the end is that of the CIGAR."""
    stop = F.col("start") + reference_length("cigar")
    return reads.where((F.col("contig") == contig) & (F.col("start") < end)).where(stop > start)


def parse_cigar(text: str | Column) -> Column:
    """A CIGAR string as array<struct<op, len>>."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.substring(p, -1, 1).alias("op"), F.regexp_extract(p, r"^(\d+)", 1).cast("int").alias("len")))


def reference_length(cigar: str) -> Column:
    return F.aggregate(F.col(cigar), F.lit(0).cast("long"), lambda a, x: a + F.when(x["op"].isin("M", "=", "X", "D", "N"), x["len"]).otherwise(0))


def cigar_blocks(start: str | Column, cigar: str) -> Column:
    """Aligned blocks: M, = and X emit one each, D and N advance, the rest does nothing; neighbours are not merged."""
    start = F.col(start) if isinstance(start, str) else start
    zero = F.struct(start.cast("long").alias("pos"), F.array().cast(BLOCKS).alias("blocks"))

    def step(acc, x):
        after = acc["pos"] + x["len"].cast("long")
        aligned = x["op"].isin("M", "=", "X")
        block = F.array(F.struct(acc["pos"].alias("start"), after.alias("end")))
        return F.struct(
            F.when(aligned | x["op"].isin("D", "N"), after).otherwise(acc["pos"]).alias("pos"),
            F.when(aligned, F.concat(acc["blocks"], block)).otherwise(acc["blocks"]).alias("blocks"),
        )

    return F.aggregate(F.col(cigar), zero, step, lambda acc: acc["blocks"])


def orientation(flags: str | Column, layout: str = "PE", strandedness: str = "reverse") -> Column:
    """1 forward, -1 reverse, 0 dual, by the library's layout (SE, PE) and strandedness (unstranded, forward, reverse)."""
    flags = F.col(flags) if isinstance(flags, str) else flags
    if strandedness == "unstranded":
        return F.lit(0).cast("byte")
    if strandedness not in ("forward", "reverse") or layout not in ("SE", "PE"):
        raise ValueError(f"unknown library {layout} {strandedness}")
    is_reverse, is_first = flags.bitwiseAND(REVERSE) != 0, flags.bitwiseAND(FIRST) != 0
    forward = ~is_reverse if layout == "SE" else is_first != is_reverse
    sign = 1 if strandedness == "forward" else -1
    return F.when(forward, sign).otherwise(-sign).cast("byte")


def single_alignments(reads: DataFrame, strandedness: str = "reverse", one_based_blocks: bool = False) -> DataFrame:
    """qname, hi, contig, orientation, nh, blocks of single-end reads."""
    start = F.col("start") + (1 if one_based_blocks else 0)
    return reads.select("qname", "hi", "contig", orientation("flags", "SE", strandedness).alias("orientation"), _hits("nh").alias("nh"), cigar_blocks(start, "cigar").alias("blocks"))


def _hits(nh: str) -> Column:
    return F.when(F.col(nh).isNull(), F.raise_error(F.lit("a read has no hit count")).cast("int")).otherwise(F.col(nh))


def mate_pairs(reads: DataFrame) -> DataFrame:
    """First and second segments with the same name and hit index, as structs `first` and `second`; mates alone are dropped.

    A name that comes more than once on either side is no pair, and is dropped; a read without a hit index is an error.
    """
    index = F.when(F.col("hi").isNull(), F.raise_error(F.lit("a read has no hit index")).cast(reads.schema["hi"].dataType)).otherwise(F.col("hi"))
    reads = reads.withColumn("hi", index)
    whole = F.struct(*(c for c in reads.columns))
    sides = reads.withColumn("_first", F.col("flags").bitwiseAND(FIRST) != 0)
    paired = sides.groupBy("qname", "hi").agg(
        F.count_if("_first").alias("n1"), F.count_if(~F.col("_first")).alias("n2"),
        F.any_value(F.when(F.col("_first"), whole), ignoreNulls=True).alias("first"), F.any_value(F.when(~F.col("_first"), whole), ignoreNulls=True).alias("second"))
    return paired.where((F.col("n1") == 1) & (F.col("n2") == 1)).select("qname", "hi", "first", "second")


def paired_alignments(reads: DataFrame, strandedness: str = "reverse") -> DataFrame:
    """qname, hi, contig, orientation, nh, blocks: both mates' blocks, merged. Mates of unlike orientation are an error."""
    pairs = mate_pairs(reads)
    o1, o2 = (orientation(F.col(f"{m}.flags"), "PE", strandedness) for m in ("first", "second"))
    same = F.when(o1 == o2, o1).otherwise(F.raise_error(F.lit("mates of unlike orientation")).cast("byte"))
    blocks = pairs.select("*", F.col("first.cigar").alias("_c1"), F.col("second.cigar").alias("_c2"), F.col("first.start").alias("_s1"), F.col("second.start").alias("_s2"))
    both = F.concat(cigar_blocks("_s1", "_c1"), cigar_blocks("_s2", "_c2"))
    return blocks.where(F.col("first.contig") == F.col("second.contig")).select("qname", "hi", F.col("first.contig").alias("contig"), same.alias("orientation"), F.col("first.nh").alias("nh"), merged_array(both).alias("blocks"))


def alignments(reads: DataFrame, layout: str = "PE", strandedness: str = "reverse") -> DataFrame:
    """The transform of a library's layout."""
    return paired_alignments(reads, strandedness) if layout == "PE" else single_alignments(reads, strandedness)


def block_rows(aligned: DataFrame, source: str) -> DataFrame:
    """As counting takes them: a row for each block."""
    return aligned.select(F.lit(source).alias("source"), F.concat_ws(":", "qname", F.col("hi").cast("string")).alias("aln_id"), "contig", "orientation", "nh", F.explode("blocks").alias("b")).select("source", "aln_id", "contig", "orientation", F.col("b.start").alias("start"), F.col("b.end").alias("end"), "nh")
