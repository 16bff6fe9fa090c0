"""Pileups by base, site metrics, and the selection of sites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import overlap_flags
from .setops import merge

BASES = ("A", "C", "G", "T", "N", "deletion")
SITE = ("tag", "seqid", "orientation", "position")


def reference_base(base: str | Column) -> Column:
    """A C G T N; other ambiguity codes are N; anything else, U too, is an error."""
    b = F.upper(F.col(base) if isinstance(base, str) else base)
    return F.when(b.isin("A", "C", "G", "T", "N"), b).when(b.isin(*"RYSWKMBDHV"), "N").otherwise(F.raise_error(F.concat(F.lit("no reference base: "), b)))


def observed_base(base: str | Column) -> Column:
    """A C G T; anything else is N."""
    b = F.upper(F.col(base) if isinstance(base, str) else base)
    return F.when(b.isin("A", "C", "G", "T"), b).otherwise("N")


def explode_bases(reads: DataFrame, min_phred: int = 0) -> DataFrame:
    """A row for each counted base: columns of reads but cigar, seq and quals, with `position` and `observed`.

    An aligned base counts if its quality is at least min_phred; a deleted one always; skips only advance;
    insertions and soft clips use up the read; hard clips and pads do nothing.
    """
    rest = [c for c in reads.columns if c not in ("cigar", "seq", "quals")]
    zero = F.struct(F.col("start").cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.array().cast("array<struct<op: string, len: bigint, r: bigint, q: bigint>>").alias("ops"))

    def step(acc, x):
        n = x["len"].cast("long")
        one = F.array(F.struct(x["op"].alias("op"), n.alias("len"), acc["r"].alias("r"), acc["q"].alias("q")))
        return F.struct(
            (acc["r"] + F.when(x["op"].isin("M", "=", "X", "D", "N"), n).otherwise(0)).alias("r"),
            (acc["q"] + F.when(x["op"].isin("M", "=", "X", "I", "S"), n).otherwise(0)).alias("q"),
            F.when(x["op"].isin("M", "=", "X", "D"), F.concat(acc["ops"], one)).otherwise(acc["ops"]).alias("ops"))

    ops = reads.withColumn("_op", F.explode(F.aggregate("cigar", zero, step, lambda acc: acc["ops"])))
    each = ops.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_op.len") - 1)))
    deleted = F.col("_op.op") == "D"
    at = (F.col("_op.q") + F.col("_i")).cast("int")
    good = deleted | (F.try_element_at("quals", at + 1) >= min_phred)
    base = F.when(deleted, "deletion").otherwise(observed_base(F.col("seq").substr(at + 1, F.lit(1))))
    return each.where(good).select(*rest, (F.col("_op.r") + F.col("_i")).alias("position"), base.alias("observed"))


def counts(bases: DataFrame, keys=SITE) -> DataFrame:
    """Counts of each observed base for each site; both mates count. Sites without any are absent."""
    return bases.groupBy(*keys).agg(*(F.count_if(F.col("observed") == b).alias(b) for b in BASES))


def clip(bases: DataFrame, tasks: DataFrame) -> DataFrame:
    """Positions inside the tasks' intervals (seqid, start, end)."""
    points = bases.withColumn("start", F.col("position")).withColumn("end", F.col("position") + 1)
    return overlap_flags(points, merge(tasks, ["seqid"]), ["seqid"]).where("_hit").select(*bases.columns)


def coverage() -> Column:
    total = F.lit(0)
    for b in BASES:
        total = total + F.col(b)
    return total


def matches(reference: str = "reference") -> Column:
    return F.coalesce(*(F.when(F.col(reference) == b, F.col(b)) for b in BASES[:-1]), F.lit(0))


def mismatches(reference: str = "reference") -> Column:
    return coverage() - matches(reference)


def attach_reference(sites: DataFrame, sequences: DataFrame, chunk: int = 512) -> DataFrame:
    """sites with `reference`, from sequences(seqid, seq): these are cut into chunks, so a join moves no whole sequence."""
    n = F.expr(f"cast((length(seq) + {chunk - 1}) div {chunk} as int)")
    parts = sequences.where(F.length("seq") > 0).withColumn("_k", F.explode(F.sequence(F.lit(0), n - 1)))
    parts = parts.select("seqid", F.col("_k").cast("long").alias("_k"), F.col("seq").substr((F.col("_k") * chunk + 1).cast("int"), F.lit(chunk)).alias("_seq"))
    joined = sites.withColumn("_k", F.expr(f"position div {chunk}")).join(parts, ["seqid", "_k"])
    return joined.withColumn("reference", reference_base(F.col("_seq").substr((F.pmod("position", F.lit(chunk)) + 1).cast("int"), F.lit(1)))).drop("_k", "_seq")


# ---- selectors: (sites with reference) -> sites with boolean `selected`


def select_mismatches(min_mismatches: int = 1, min_freq: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    if not 0 <= min_freq <= 1:
        raise ValueError("a frequency lies in [0, 1]")
    m, cov = mismatches(), coverage()
    freq = F.when(cov == 0, F.lit(0.0)).otherwise(m / F.greatest(cov, F.lit(1)))
    return lambda sites: sites.withColumn("selected", (m >= min_mismatches) & (freq >= min_freq))


def select_required(required: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """required(seqid, orientation, start, end): covered positions inside, of the same orientation."""

    def run(sites: DataFrame) -> DataFrame:
        points = sites.withColumn("start", F.col("position")).withColumn("end", F.col("position") + 1)
        flagged = overlap_flags(points, merge(required, ["seqid", "orientation"]), ["seqid", "orientation"])
        return flagged.select(*sites.columns, (F.col("_hit") & (coverage() > 0)).alias("selected"))

    return run


def select_any(*selectors: Callable) -> Callable[[DataFrame], DataFrame]:
    """Sites that any of the selectors selects."""

    def run(sites: DataFrame) -> DataFrame:
        columns, flags = sites.columns, []
        for i, s in enumerate(selectors):
            sites = s(sites).withColumnRenamed("selected", f"_s{i}")
            flags.append(F.col(f"_s{i}"))
        whole = flags[0]
        for f in flags[1:]:
            whole = whole | f
        return sites.select(*columns, whole.alias("selected"))

    return run


def pileup(reads: DataFrame, sequences: DataFrame, selector: Callable, tasks: DataFrame | None = None, min_phred: int = 0) -> DataFrame:
    """reads(tag, seqid, orientation, start, cigar, seq, quals) to selected sites with counts and reference."""
    bases = explode_bases(reads, min_phred)
    if tasks is not None:
        bases = clip(bases, tasks)
    sites = attach_reference(counts(bases), sequences)
    return selector(sites).where("selected").drop("selected").select(*SITE, "reference", *BASES)


def concat(chunks: list[DataFrame]) -> DataFrame:
    """Distinct chunks of sites as one table; a site that comes twice is an error."""
    whole = chunks[0]
    for c in chunks[1:]:
        whole = whole.unionByName(c)
    n = F.count("*").over(W.partitionBy(*SITE))
    return whole.withColumn("_n", n).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("a site comes twice")).cast("boolean")).otherwise(True)).where("_ok").drop("_n", "_ok")
