"""Projects of sequencing runs, reference registries and transcript models: checks, filters and lookups.

A project is five tables: samples(ind, organisms, meta, description), libraries(ind, sample, source, selection,
strandedness, meta, description), experiments(ind, library, layout, meta, description),
runs(ind, experiment, kind, file1, file2, machine, reads, bases, meta, description), and its own id.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARENTS = (("libraries", "sample", "samples"), ("experiments", "library", "libraries"), ("runs", "experiment", "experiments"))


@dataclass(frozen=True)
class Project:
    ind: str
    samples: DataFrame
    libraries: DataFrame
    experiments: DataFrame
    runs: DataFrame

    def tables(self):
        return {n: getattr(self, n) for n in ("samples", "libraries", "experiments", "runs")}


def _problem(df: DataFrame, where: Column, table: str, what: str) -> DataFrame:
    return df.where(where).select(F.lit(table).alias("table"), F.lit(what).alias("problem"), F.col("ind").cast("string").alias("ind"))


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def problems(project: Project) -> DataFrame:
    """table, problem, ind: everything that makes a project invalid; no rows if it is valid."""
    found = []
    tables = project.tables()
    for name, df in tables.items():
        found.append(_problem(df, _blank(F.col("ind")), name, "empty id"))
    for name, column, parent in PARENTS:
        dangling = tables[name].join(tables[parent].select(F.col("ind").alias(column)), column, "left_anti")
        found.append(_problem(dangling, F.lit(True), name, f"unknown {column}"))
    every = reduce(DataFrame.union, [df.select(F.lit(n).alias("table"), F.col("ind").cast("string").alias("ind")) for n, df in tables.items()])
    twice = every.groupBy("ind").agg(F.count("*").alias("n"), F.min("table").alias("table")).where((F.col("n") > 1) | (F.col("ind") == project.ind))
    found.append(_problem(twice, F.lit(True), "project", "id is not unique"))
    runs = project.runs
    found.append(_problem(runs, (F.col("reads") <= 0) | (F.col("bases") <= 0), "runs", "no reads or bases"))
    found.append(_problem(runs, _blank(F.col("file1")) | ((F.col("kind") == "PE") & _blank(F.col("file2"))) | ((F.col("kind") == "SE") & F.col("file2").isNotNull()), "runs", "files do not match the layout"))
    with_layout = runs.join(project.experiments.select(F.col("ind").alias("experiment"), "layout"), "experiment")
    found.append(_problem(with_layout, F.col("kind") != F.col("layout"), "runs", "layout differs from the experiment's"))
    bare = project.experiments.join(runs.select(F.col("experiment").alias("ind")), "ind", "left_anti")
    found.append(_problem(bare, F.lit(True), "experiments", "no runs"))
    return reduce(DataFrame.union, found)


def layouts(project: Project) -> DataFrame:
    """experiment, layout (null unless its runs agree), strandedness."""
    kinds = project.runs.groupBy("experiment").agg(F.collect_set("kind").alias("kinds"))
    ex = project.experiments.select(F.col("ind").alias("experiment"), "library").join(kinds, "experiment", "left")
    return ex.join(project.libraries.select(F.col("ind").alias("library"), "strandedness"), "library", "left").select("experiment", F.when(F.size("kinds") == 1, F.element_at("kinds", 1)).alias("layout"), "strandedness")


@dataclass(frozen=True)
class Filters:
    """Conjunctive filters for each level."""

    sample: tuple[Column, ...] = ()
    library: tuple[Column, ...] = ()
    experiment: tuple[Column, ...] = ()
    run: tuple[Column, ...] = ()
    projects: tuple[str, ...] = field(default=())

    def with_sample(self, *c: Column):
        return replace(self, sample=self.sample + c)

    def with_library(self, *c: Column):
        return replace(self, library=self.library + c)

    def with_experiment(self, *c: Column):
        return replace(self, experiment=self.experiment + c)

    def with_run(self, *c: Column):
        return replace(self, run=self.run + c)

    def with_project(self, *inds: str):
        return replace(self, projects=self.projects + inds)

    def with_attribute(self, key: str, value: str):
        return self.with_sample(F.try_element_at("meta", F.lit(key)) == value)

    def with_layout(self, layout: str):
        return self.with_experiment(F.col("layout") == layout)

    def __call__(self, project: Project) -> Project | None:
        """The project with what passes: runs fall with their experiments, and samples, libraries and experiments without runs go."""
        if self.projects and project.ind not in self.projects:
            return None
        where = lambda df, cs: reduce(DataFrame.where, cs, df)
        up = lambda df, col, other: df.join(other.select(F.col("ind").alias(col)), col, "left_semi").select(*df.columns)
        down = lambda df, other, col: df.join(other.select(F.col(col).alias("ind")).distinct(), "ind", "left_semi").select(*df.columns)
        samples = where(project.samples, self.sample)
        libraries = up(where(project.libraries, self.library), "sample", samples)
        experiments = up(where(project.experiments, self.experiment), "library", libraries)
        runs = up(where(project.runs, self.run), "experiment", experiments)
        experiments = down(experiments, runs, "experiment")
        libraries = down(libraries, experiments, "library")
        return Project(project.ind, down(samples, libraries, "sample"), libraries, experiments, runs)


# ---- reference registries: refs(name, length, label, description, aliases)


def aliases(refs: DataFrame) -> DataFrame:
    """alias, name: each name and each alias."""
    return refs.select(F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"), "name")


def registry_problems(refs: DataFrame) -> DataFrame:
    """Names and aliases that stand for more than one reference."""
    names = refs.select(F.col("name").alias("alias")).union(refs.select(F.explode("aliases")))
    return names.groupBy("alias").count().where("count > 1")


def resolve(queries: DataFrame, refs: DataFrame, column: str = "name") -> DataFrame:
    """queries with `reference`: the canonical name of a name or alias, or null."""
    return queries.join(aliases(refs).select(F.col("alias").alias(column), F.col("name").alias("reference")), column, "left")


def get(refs: DataFrame, name: str) -> DataFrame:
    """Canonical names only."""
    return refs.where(F.col("name") == name)


def merge_registries(*registries: DataFrame) -> DataFrame:
    """Their union by name; a name or alias that comes twice is an error when the result is used."""
    whole = reduce(DataFrame.unionByName, registries)
    twice = registry_problems(whole).agg(F.count("*").alias("_n"))
    checked = whole.crossJoin(F.broadcast(twice)).withColumn("_ok", F.when(F.col("_n") > 0, F.raise_error(F.lit("names or aliases come twice")).cast("boolean")).otherwise(True))
    return checked.where("_ok").drop("_n", "_ok").orderBy("name")


# ---- transcripts


def tss(start: str = "start", end: str = "end", strand: str = "strand") -> Column:
    """First base in the strand's direction."""
    return F.when(F.col(strand) == 1, F.col(start)).otherwise(F.col(end))


def tes(start: str = "start", end: str = "end", strand: str = "strand") -> Column:
    return F.when(F.col(strand) == 1, F.col(end)).otherwise(F.col(start))


def introns(exons: DataFrame, rna: str = "rna") -> DataFrame:
    """rna, start, end: gaps between an RNA's neighbouring exons."""
    line = W.partitionBy(rna).orderBy("start")
    return exons.select(rna, F.col("end").alias("start"), F.lead("start").over(line).alias("end")).where("start < end")


def transcriptome_problems(genes: DataFrame, rnas: DataFrame) -> DataFrame:
    """problem, ind: genes(ind, transcripts array), rnas(ind, gene): ids that repeat, RNAs without gene, and genes whose list differs from their RNAs'."""
    out = []
    for name, df in (("gene", genes), ("rna", rnas)):
        out.append(df.groupBy("ind").count().where("count > 1").select(F.lit(f"{name} id is not unique").alias("problem"), "ind"))
    out.append(rnas.join(genes.select(F.col("ind").alias("gene")), "gene", "left_anti").select(F.lit("unknown gene").alias("problem"), "ind"))
    real = rnas.groupBy("gene").agg(F.array_sort(F.collect_set("ind")).alias("real"))
    none = F.array().cast("array<string>")
    listed = genes.join(real.withColumnRenamed("gene", "ind"), "ind", "left").where(F.array_sort(F.array_distinct(F.coalesce("transcripts", none))) != F.coalesce("real", none))
    out.append(listed.select(F.lit("transcripts differ").alias("problem"), "ind"))
    return reduce(DataFrame.union, out)


def consistent(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column: where a column that must be constant for each key is not."""
    checks = [df.groupBy(key).agg(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias("n")).where("n > 1").select(key, F.lit(c).alias("column")) for c in columns]
    return reduce(DataFrame.union, checks)


# ---- assemblies: annotations(assembly, key, kind, path), sequences(assembly, path), organisms(assembly, organism)


def merge_annotations(*tables: DataFrame) -> DataFrame:
    """assembly, key, kind, paths: annotations of all tables by key; a key of two kinds is an error when the result is used."""
    whole = reduce(DataFrame.unionByName, tables).groupBy("assembly", "key").agg(F.collect_set("kind").alias("_k"), F.array_sort(F.collect_set("path")).alias("paths"))
    kind = F.when(F.size("_k") == 1, F.element_at("_k", 1)).otherwise(F.raise_error(F.concat(F.lit("annotations of two kinds: "), F.col("key"))))
    return whole.select("assembly", "key", kind.alias("kind"), "paths")


def merge_assemblies(sequences: list[DataFrame], organisms: list[DataFrame]) -> DataFrame:
    """assembly, organisms, paths: the union of organisms and of sequence files; an assembly without a file is an error when the result is used."""
    files = reduce(DataFrame.unionByName, sequences).groupBy("assembly").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    names = reduce(DataFrame.unionByName, organisms).groupBy("assembly").agg(F.array_sort(F.collect_set("organism")).alias("organisms"))
    joined = names.join(files, "assembly", "full")
    none = F.array().cast("array<string>")
    paths = F.when(F.col("paths").isNotNull(), F.col("paths")).otherwise(F.raise_error(F.concat(F.lit("no sequence of "), F.col("assembly"))).cast("array<string>"))
    return joined.select("assembly", F.coalesce("organisms", none).alias("organisms"), paths.alias("paths"))


def storage_exists(storage) -> bool:
    """Whether all files of a run's storage(file1, file2), of which file2 may be null, are there. A folder counts, a missing name does not."""
    from pyarrow import fs

    for name in [storage["file1"], *([storage["file2"]] if storage["file2"] is not None else [])]:
        if name is None:
            return False
        store, own = fs.FileSystem.from_uri(name) if ":" in name else (fs.LocalFileSystem(), name)
        if store.get_file_info(own).type == fs.FileType.NotFound:
            return False
    return True
