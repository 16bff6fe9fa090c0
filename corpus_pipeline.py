"""From raw documents to token ids: STAGES, and run() over a table of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Stages are judged on their own input: copies that one leaves do not matter to the one before.

Edge cases: columns beside those of documents are carried along, whatever their names. Null and empty texts have
the quality of a text without features, are no copies of each other, have no passages, are not taken by the mix (their
size is 0), and encode to the begin and end ids. Rows of one doc_id, or of a null one, are documents of their own to all
stages but passages, where what they share among each other is no repeat; of rows that are copies exactly one stays.
Null sources are one source. Ties are settled by doc_id, null last, then by content. An empty table gives empty tables.
The tables of the stages stay in the shared folder below `pipeline-...`: what run() returns reads the last of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import jaccard, mixing, pieces, quality, substrings
from strandline.llm.common import named, packed, shared_dir, table, unpacked


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is the best one at least as probably as not; the others, toxic or of low quality, go."""
    scored = quality.classify(spark, docs.select(packed(docs), named("doc_id").alias("doc_id"), named("text").alias("text")), sf_dir)
    return scored.where(quality.kept()).select(*unpacked(docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least doc_id of each class of documents linked by a Jaccard similarity of 0.8 of five-word shingles."""
    return jaccard.one_of_each(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words or more that a document of smaller doc_id has too; n_chars follows."""
    others = docs.select(*(named(c) for c in docs.columns if c not in ("text", "n_chars")))
    plain = docs.select(packed(others), named("doc_id").alias("doc_id"), named("text").alias("text"))
    found = substrings.remove_repeats(plain, layout=True)
    fields = dict(zip(others.columns, unpacked(others.columns), strict=True))
    fields |= {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return found.select(*(fields[c] for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the curriculum takes, in training order."""
    plain = docs.select(packed(docs), named("doc_id").alias("doc_id"), named("source").alias("source"), mixing.size_of(named("text")).alias("size"))
    copies = mixing.mix(plain, whole=True).select("doc_id", "_row", F.explode("times").alias("_time"))
    return copies.repartitionByRange("_time", "doc_id").sortWithinPartitions("_time", "doc_id").select(*unpacked(docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (with begin and end ids), and whether they decode to the text."""
    return pieces.encode_texts(docs, check=True)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", keep_one_of_near_copies),
    ("passages", remove_repeated_passages),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The stages are hashed models, joins and a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
