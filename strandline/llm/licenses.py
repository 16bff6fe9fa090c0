"""License scans by diagonal voting.

All rolling hashes of k = 2 consecutive words of all texts are joined to the templates' positions (a fixed,
small table, so it is broadcast). A hit at word p of the text and word t of the template votes for the
diagonal p - t, where the template would begin. Votes are aggregated for each diagonal as the set of the
template's positions, whatever its length; a diagonal of a long template needs two of them. Neighbouring diagonals
(words put in or left out) are merged, and a span is verified by the share of the template's positions that its
words, hit for hit, cover and by its length.

Base phrases are templates too: such a place is a diagonal with all positions. Words are lower-cased (A-Z) runs of
a-z, 0-9 and bytes above 0x7F.

Rows are told apart by their doc_id and a 64-bit hash of their text: rows that repeat both are scanned once and
reported once each, so a text that a third of all rows share is reduced before anything is shuffled.

Edge cases: a null text is empty; a text with fewer than two words has no hits; rows of one doc_id, or of a null
one, with other texts are reported one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, grams, hash_spans, lower_ascii, named, spans, table, tidy

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
SEPARATOR[65:91] = True  # never met: texts are lower-cased first
#: Base phrases and their labels: fixed values.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Templates of the method's own labels, of any number of words: fixed values.
OWN = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
K = 2
#: Diagonals at most so far apart are merged; a merged span must cover this share of the template's k-grams.
GAP, COVER = 3, 0.75
#: A diagonal of a template with more k-grams than this needs two votes: single ones are words that every text has.
LONE_VOTES = 6
_SUMMARY = -1


def text_words(data: np.ndarray, offsets: np.ndarray):
    """(hash, row) of each word, and bytes in lower case."""
    low = lower_ascii(data)
    start, end, row = spans(low, offsets, SEPARATOR)
    return hash_spans(low, start, end), row


def templates(base: dict[str, str] = BASE, own=OWN):
    """(hash, template, position) of all k-grams, and (label, k-grams, is base) of each template."""
    rows, kinds = [], []
    for label, text, is_base in [*((k, v, True) for k, v in base.items()), *((k, v, False) for k, v in own)]:
        raw = np.frombuffer(text.encode() + b"\0" * 8, np.uint8)
        words, _ = text_words(raw, np.array([0, len(raw) - 8]))
        hashes = grams(words, K).view(np.int64)
        if not len(hashes):
            raise ValueError(f"template {label} has too few words")
        rows += [(int(h), len(kinds), t) for t, h in enumerate(hashes)]
        kinds.append((label, len(hashes), is_base))
    return rows, kinds


def rolling(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content (a hash of the text), pos, h: a row for each k-gram; and one with pos = number of words and h = -1 for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, contents = batch.column(0), batch.column(2)
            for first, n, data, offsets in chunks(batch.column(1)):
                words, row = text_words(data, offsets)
                h = grams(words, K)
                inside = np.flatnonzero(row[: len(h)] == row[K - 1 :]) if len(h) else np.zeros(0, np.int64)
                counts = np.bincount(row, minlength=n)
                begin = np.cumsum(counts) - counts
                own = pa.array(np.concatenate([row[inside], np.arange(n)]))
                pos = np.concatenate([inside - begin[row[inside]], counts])
                values = np.concatenate([h[inside].view(np.int64), np.full(n, _SUMMARY)])
                yield pa.RecordBatch.from_arrays([ids.slice(first, n).take(own), contents.slice(first, n).take(own), pa.array(pos, pa.int64()), pa.array(values, pa.int64())], names=["doc_id", "content", "pos", "h"])

    text = F.coalesce(named(text_col), F.lit(""))
    return docs.select(named(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("content")).mapInArrow(tidy(run), "doc_id long, content long, pos long, h long")


def diagonals(docs: DataFrame, base: dict[str, str] = BASE, own=OWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content, template, diagonal, hits (sorted positions of the template), rows; template -1 has the number of words
    as diagonal, and the number of equal rows."""
    found, _ = templates(base, own)
    spots = docs.sparkSession.createDataFrame([*found, (_SUMMARY, -1, 0)], "h long, template int, t int")
    hits = rolling(docs, id_col, text_col).join(F.broadcast(spots), "h")
    return hits.groupBy("doc_id", "content", "template", (F.col("pos") - F.col("t")).alias("diagonal")).agg(F.array_sort(F.collect_set("t")).alias("hits"), F.count("*").alias("rows"))


def scan(docs: DataFrame, base: dict[str, str] = BASE, own=OWN, gap: int = GAP, cover: float = COVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans: doc_id, content, label, is_base, first, last (words, the last one included), cover; and a row with null label, `n_words`
    and `rows` (how many rows are equal) for each document."""
    spark = docs.sparkSession
    _, kinds = templates(base, own)
    names = spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "template int, label string, grams int, is_base boolean")
    votes = diagonals(docs, base, own, id_col, text_col).join(F.broadcast(names), "template", "left")
    votes = votes.where(F.col("label").isNull() | F.col("is_base") | (F.col("grams") <= LONE_VOTES) | (F.size("hits") > 1))
    order = W.partitionBy("doc_id", "content", "template").orderBy("diagonal")
    # A base place is one diagonal: each starts a span of its own. Others join the diagonal before them within `gap`.
    fresh = F.col("is_base") | F.col("label").isNull() | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > gap, F.lit(True))
    marked = votes.withColumn("span", F.sum(fresh.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = marked.groupBy("doc_id", "content", "template", "label", "grams", "is_base", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("covered"), F.min(F.col("diagonal") + F.element_at("hits", 1)).alias("first"),
        F.max(F.col("diagonal") + F.element_at("hits", -1) + K - 1).alias("last"), F.first("diagonal").alias("diagonal"), F.first("rows").alias("rows"))
    found = merged.withColumn("cover", F.col("covered") / F.col("grams"))
    length = F.col("last") - F.col("first") + 1
    good = F.when(F.col("is_base"), F.col("cover") == 1).otherwise((F.col("cover") >= cover) & (length <= F.col("grams") * 4 / 3 + 2 * gap))
    summary = F.col("label").isNull()
    return found.where(summary | good).select("doc_id", "content", "label", "is_base", "first", "last", "cover", F.when(summary, F.col("diagonal")).alias("n_words"), F.when(summary, F.col("rows")).alias("rows"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans_ = scan(table(spark, sf_dir, "documents"))
    at_base = F.when(F.col("is_base"), F.col("first"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    each = spans_.groupBy("doc_id", "content").agg(
        F.max("n_words").alias("n_words"), F.count(at_base).alias("n_base"),
        F.min(at_base).alias("first_word"), F.max(at_base).alias("last_word"),
        joined(F.when(F.col("is_base"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"),
        F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("cover"))), F.lit(0.0)).alias("score"), F.max("rows").alias("_rows"))
    # A row for each of the equal rows.
    return each.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).drop("content", "_rows", "_copy")
