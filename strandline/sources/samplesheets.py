"""Sample sheets of sequencing archives as projects, and the design and result files of an expression workflow."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metadata import Project, consistent

#: Columns of a sample sheet that must be there and not empty: fixed names.
REQUIRED = (
    "study_accession", "study_title", "sample_accession", "experiment_accession", "experiment_title", "run_accession",
    "scientific_name", "library_source", "library_selection", "library_layout", "instrument_model", "read_count", "base_count", "fastq_1",
)
FORBIDDEN = r"[,|/\[\]]"


def load_samplesheet(spark: SparkSession, path: str, keep: Column | None = None, fastq_root: str | None = None) -> list[Project]:
    """A project for each study; rows for which `keep` is not true go. An empty required value, or a title or name that
    is not constant for its id, is an error. Studies are few: their ids come to the driver."""
    rows = spark.read.option("header", True).csv(path, quote='"', escape='"')
    if missing := [c for c in REQUIRED if c not in rows.columns]:
        raise ValueError(f"the sample sheet lacks {missing}")
    rows = rows if keep is None else rows.where(keep)
    empty = rows.where(" OR ".join(f"coalesce(trim({c}), '') = ''" for c in REQUIRED)).select("run_accession").limit(5).collect()
    if empty:
        raise ValueError(f"empty required values in runs {[r[0] for r in empty]}")
    for key, columns in (("study_accession", ["study_title"]), ("sample_accession", ["scientific_name"]), ("experiment_accession", ["experiment_title", "sample_accession", "library_layout"])):
        if bad := consistent(rows, key, columns).limit(5).collect():
            raise ValueError(f"not constant: {[tuple(r) for r in bad]}")
    root = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(fastq_root.rstrip("/") + "/"), F.regexp_extract(c, r"([^/]+)$", 1))) if fastq_root else F.col(c)
    meta = F.create_map(F.lit("study"), F.col("study_accession"))
    text = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    out = []
    for study in [r[0] for r in rows.select("study_accession").distinct().orderBy("study_accession").collect()]:
        own = rows.where(F.col("study_accession") == study)
        kind = F.when(F.upper("library_layout") == "PAIRED", "PE").otherwise("SE")
        samples = own.select(F.col("sample_accession").alias("ind"), F.array("scientific_name").alias("organisms"), meta.alias("meta"), text("sample_description").alias("description")).dropDuplicates(["ind"])
        libraries = own.select(F.concat("experiment_accession", F.lit("-lib")).alias("ind"), F.col("sample_accession").alias("sample"), F.array("library_source").alias("source"), F.array("library_selection").alias("selection"), F.lit(None).cast("string").alias("strandedness"), meta.alias("meta"), F.lit(None).cast("string").alias("description")).dropDuplicates(["ind"])
        experiments = own.select(F.col("experiment_accession").alias("ind"), F.concat("experiment_accession", F.lit("-lib")).alias("library"), kind.alias("layout"), meta.alias("meta"), F.col("experiment_title").alias("description")).dropDuplicates(["ind"])
        runs = own.select(F.col("run_accession").alias("ind"), F.col("experiment_accession").alias("experiment"), kind.alias("kind"), root("fastq_1").alias("file1"), (root("fastq_2") if "fastq_2" in rows.columns else F.lit(None).cast("string")).alias("file2"), F.col("instrument_model").alias("machine"), F.col("read_count").cast("long").alias("reads"), F.col("base_count").cast("long").alias("bases"), meta.alias("meta"), F.lit(None).cast("string").alias("description"))
        out.append(Project(study, samples, libraries, experiments, runs))
    return out


def descriptor(ind: str | Column, title: str | Column, sep: str = "+") -> Column:
    """id, separator, title; characters that file names of the workflow cannot have are an error."""
    ind, title = (F.col(c) if isinstance(c, str) else c for c in (ind, title))
    whole = F.concat(ind, F.lit(sep), title)
    return F.when(whole.rlike(FORBIDDEN), F.raise_error(F.concat(F.lit("forbidden character in "), whole))).otherwise(whole)


def experiment_of(text: str | Column, sep: str = "+") -> Column:
    return F.substring_index(text, sep, 1)


def design(project: Project) -> DataFrame:
    """sample, fastq_1, fastq_2, strandedness: a row for each run; unknown strandedness is auto."""
    ex = project.experiments.select(F.col("ind").alias("experiment"), "library", F.col("description").alias("title"))
    lib = project.libraries.select(F.col("ind").alias("library"), "strandedness")
    rows = project.runs.join(ex, "experiment").join(lib, "library")
    return rows.select(descriptor("experiment", "title").alias("sample"), F.col("file1").alias("fastq_1"), F.coalesce("file2", F.lit("")).alias("fastq_2"), F.coalesce("strandedness", F.lit("auto")).alias("strandedness"))


def write_design(project: Project, path: str) -> None:
    design(project).write.mode("overwrite").csv(path, header=True)


def results(project: Project, folder: str) -> DataFrame:
    """experiment, bam, bigwig (array), salmon, inflags, exflags: where the workflow puts an experiment's results."""
    ex = project.experiments.select(F.col("ind").alias("experiment"), "library", "layout", F.col("description").alias("title")).join(project.libraries.select(F.col("ind").alias("library"), "strandedness"), "library")
    name, base = descriptor("experiment", "title"), F.lit(folder.rstrip("/"))
    tracks = F.when(F.coalesce("strandedness", F.lit("unstranded")) == "unstranded", F.array(F.concat(base, F.lit("/bigwig/"), name, F.lit(".bigWig")))).otherwise(F.array(*(F.concat(base, F.lit("/bigwig/"), name, F.lit(f".{d}.bigWig")) for d in ("forward", "reverse"))))
    return ex.select("experiment", F.concat(base, F.lit("/bam/"), name, F.lit(".markdup.sorted.bam")).alias("bam"), tracks.alias("bigwig"), F.concat(base, F.lit("/salmon/"), name).alias("salmon"), F.when(F.col("layout") == "PE", 1).otherwise(0).alias("inflags"), F.lit(2564).alias("exflags"))


def dump(project: Project) -> str:
    """A project as text (JSON, which YAML readers take): experiments name their library, libraries their sample. Projects are small: they describe files."""
    return json.dumps({"ind": project.ind} | {n: [json.loads(x) for x in df.orderBy("ind").toJSON().collect()] for n, df in project.tables().items()}, indent=1)


SCHEMAS = {
    "samples": "ind string, organisms array<string>, meta map<string,string>, description string",
    "libraries": "ind string, sample string, source array<string>, selection array<string>, strandedness string, meta map<string,string>, description string",
    "experiments": "ind string, library string, layout string, meta map<string,string>, description string",
    "runs": "ind string, experiment string, kind string, file1 string, file2 string, machine string, reads long, bases long, meta map<string,string>, description string",
}


def loads(spark: SparkSession, text: str) -> Project:
    """From dump's text, or YAML of that shape where a YAML reader is installed. The description stays; ids that repeat among samples are an error."""
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    inds = [s["ind"] for s in found["samples"]]
    if len(set(inds)) != len(inds):
        raise ValueError("sample ids repeat")
    names = {n: [c.split()[0] for c in s.split(", ")] for n, s in SCHEMAS.items()}
    return Project(found["ind"], **{n: spark.createDataFrame([tuple(r.get(c) for c in names[n]) for r in found.get(n, [])], s) for n, s in SCHEMAS.items()})
