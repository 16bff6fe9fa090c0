"""BED files of 3, 4, 5, 6, 8, 9 and 12 columns: reader, writer, conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intervals import orientation_of
from .text import read_lines

COLUMNS = ("seqid", "start", "end", "name", "score", "orientation", "thick_start", "thick_end", "rgb", "blocks")
#: Columns of each kind; BED8 has both thick bounds, BED12 count, sizes and starts of blocks.
WIDTHS = {3: 3, 4: 4, 5: 5, 6: 6, 8: 8, 9: 9, 12: 10}


def _check(good: Column, value: Column, what: str) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.concat(F.lit(f"BED: {what}: "), F.col("value"))))


def read_bed(spark: SparkSession, path: str, n: int, strict: bool = True) -> DataFrame:
    """Rows of BED`n`; a line with another number of fields or a bad value is an error. Blocks are relative to the start.

    Not strict: an empty thick part (common in files of other tools) gives null bounds instead of an error.
    """
    if n not in WIDTHS:
        raise ValueError(f"no BED{n}")
    lines = read_lines(spark, path).select(F.regexp_replace("value", "\r$", "").alias("value"))
    f = F.split("value", "\t", -1)
    lines = lines.withColumn("f", F.when(F.size(f) == n, f).otherwise(F.raise_error(F.concat(F.lit(f"BED: not {n} fields: "), F.col("value"))).cast("array<string>")))
    g = lambda i: F.col("f")[i]
    num = lambda c, what, kind="long": _check(c.rlike(r"^\d+$"), c, what).cast(kind)
    start, end = num(g(1), "start"), num(g(2), "end")
    cols = [_check(g(0).rlike(r"^\S{1,255}$"), g(0), "seqid").alias("seqid"), start.alias("start"), _check(start < end, end, "start < end").alias("end")]
    if n >= 4:
        cols.append(_check(g(3).rlike(r"^[\x20-\x7e]{1,255}$"), g(3), "name").alias("name"))
    if n >= 5:
        score = num(g(4), "score", "int")
        cols.append(_check(score <= 1000, score, "score").alias("score"))
    if n >= 6:
        cols.append(orientation_of(_check(g(5).isin("+", "-", "."), g(5), "strand")).alias("orientation"))
    if n >= 8:
        ts, te = num(g(6), "thick start"), num(g(7), "thick end")
        inside = (ts >= start) & (te <= end) & (ts < te)
        if strict:
            cols += [_check(inside, ts, "thick part").alias("thick_start"), _check(inside, te, "thick part").alias("thick_end")]
        else:
            cols += [F.when(inside, ts).alias("thick_start"), F.when(inside, te).alias("thick_end")]
    if n >= 9:
        whole = _check(g(8).rlike(r"^(0|\d{1,3},\d{1,3},\d{1,3})$"), g(8), "rgb")
        rgb = F.split(F.when(whole == "0", "0,0,0").otherwise(whole), ",")
        each = [_check(rgb[i].cast("int") <= 255, rgb[i], "rgb").cast("short").alias(k) for i, k in enumerate("rgb")]
        cols.append(F.struct(*each).alias("rgb"))
    if n == 12:
        size, at = (F.transform(F.split(F.regexp_replace(g(i), ",$", ""), ","), lambda x: x.cast("long")) for i in (10, 11))
        blocks = F.transform(F.arrays_zip(size.alias("s"), at.alias("a")), lambda x: F.struct(x["a"].alias("start"), (x["a"] + x["s"]).alias("end")))
        count = num(g(9), "blocks", "int")
        cols += [count.alias("_n"), size.alias("_size"), at.alias("_at"), blocks.alias("blocks")]
    out = lines.select("value", *cols)
    if n == 12:
        b, length = F.col("blocks"), F.col("end") - F.col("start")
        good = (F.size("_size") == F.col("_n")) & (F.size("_at") == F.col("_n")) & (F.col("_n") > 0) & (F.col("_n") <= length) & F.forall(b, lambda x: x["start"] < x["end"])
        ordered = F.forall(F.sequence(F.lit(1), F.size(b)), lambda i: (i == F.size(b)) | (F.element_at(b, i)["end"] <= F.try_element_at(b, i + 1)["start"]))
        fits = (F.element_at(b, 1)["start"] == 0) & (F.element_at(b, -1)["end"] == length)
        out = out.withColumn("blocks", _check(F.coalesce(good & ordered & fits, F.lit(False)), F.col("blocks"), "blocks"))
    return out.select(*COLUMNS[: WIDTHS[n]])


def bed_lines(df: DataFrame, n: int) -> DataFrame:
    """value: the lines of BED`n`. Dual orientation is a point; block lists have no comma at the end."""
    t = lambda c: F.col(c).cast("string")
    parts = [t("seqid"), t("start"), t("end")]
    if n >= 4:
        parts.append(t("name"))
    if n >= 5:
        parts.append(t("score"))
    if n >= 6:
        parts.append(F.when(F.col("orientation") == 1, "+").when(F.col("orientation") == -1, "-").otherwise("."))
    if n >= 8:
        parts += [F.coalesce(t("thick_start"), t("start")), F.coalesce(t("thick_end"), t("start"))]
    if n >= 9:
        parts.append(F.concat_ws(",", *(F.col(f"rgb.{k}").cast("string") for k in "rgb")))
    if n == 12:
        parts += [F.size("blocks").cast("string"), F.array_join(F.transform("blocks", lambda x: (x["end"] - x["start"]).cast("string")), ","), F.array_join(F.transform("blocks", lambda x: x["start"].cast("string")), ",")]
    return df.select(F.concat_ws("\t", *parts).alias("value"))


def write_bed(df: DataFrame, path: str, n: int, compression: str | None = None) -> None:
    bed_lines(df, n).write.mode("overwrite").text(path, compression=compression)


def to_bed(df: DataFrame, n: int) -> DataFrame:
    """Fewer columns, or more with defaults: name ".", score 0, dual, thick all, black, one block."""
    defaults = {
        "name": F.lit("."), "score": F.lit(0), "orientation": F.lit(0).cast("byte"), "thick_start": F.col("start"), "thick_end": F.col("end"),
        "rgb": F.struct(*(F.lit(0).cast("short").alias(k) for k in "rgb")), "blocks": F.array(F.struct(F.lit(0).cast("long").alias("start"), (F.col("end") - F.col("start")).alias("end")))}
    return df.select(*(F.col(c) if c in df.columns else defaults[c].alias(c) for c in COLUMNS[: WIDTHS[n]]))
