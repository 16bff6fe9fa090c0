"""Overlap joins of interval tables, as equi-joins on bins.

Each interval is put in the bins it touches; pairs meet in each bin they share and are kept in the first of
them only (the bin of the larger start), so none comes twice. The bin is part of the key, so a hot contig is spread.

Bins come in levels, each STEP times as wide as the one below: an interval belongs to the lowest level where it is at
most SPAN bins long, and is also put in the wider bins of the levels that the other table's intervals belong to. A
pair meets at the higher of its two levels. So a whole chromosome makes a few rows, and where no interval is long, the
rows are those of one level. Which levels are in use is found by an aggregate that is part of the plan, and is broadcast:
one row of LEVELS flags at most.

Null keys or bounds and empty intervals (end at or before start) overlap nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Width of the lowest level's bins where the caller gives none.
BIN = 1 << 12
SPAN, STEP, LEVELS = 16, 64, 4


def bin_of(pos, width) -> Column:
    """Floor of pos / width, for negative positions too."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    width = width if isinstance(width, Column) else F.lit(width)
    return ((pos - F.pmod(pos, width)) / width).cast("long")


def bins(start, end, width) -> Column:
    end = F.col(end) if isinstance(end, str) else end
    return F.sequence(bin_of(start, width), bin_of(end - 1, width))


def level_of(start: str, end: str, width: int) -> Column:
    length, level = F.col(end) - F.col(start), F.lit(LEVELS - 1)
    for i in range(LEVELS - 2, -1, -1):
        level = F.when(length <= SPAN * width * STEP**i, i).otherwise(level)
    return level


def _width(level: Column, width: int) -> Column:
    return F.element_at(F.array(*(F.lit(width * STEP**i) for i in range(LEVELS))), level + 1)


def _levels(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    # With a count, the rows are read as the join reads them, so that an exchange below, of a view's DISTINCT, is made once for both.
    found = df.where(F.col(start) < F.col(end)).agg(F.collect_set(level_of(start, end, width)).alias("_used"), F.count("*").alias("_n"))
    return F.broadcast(found.select(F.when(F.col("_n") > 0, F.col("_used")).otherwise(F.slice("_used", 1, 0)).alias("_used")))


def dealt(df: DataFrame, start: str, end: str, width: int, used: DataFrame | None, prefix: str, ordered: bool = False) -> DataFrame:
    """df's intervals, a row for each bin: `_level`, `_bin`, and `<prefix>own`, the interval's own level. used: the other table's levels; None: all intervals are short.
    ordered: what a task sends to a bin is in order."""
    df = df.where(F.col(start) < F.col(end))
    own, order = f"{prefix}own", [start, end]
    if used is None:
        df = df.sortWithinPartitions(order) if ordered else df
        return df.withColumn(own, F.lit(0)).withColumn("_level", F.lit(0)).withColumn("_bin", F.explode(bins(start, end, width)))
    found = df.crossJoin(used).withColumn(own, level_of(start, end, width))
    found = found.sortWithinPartitions(order) if ordered else found
    higher = F.filter("_used", lambda x: x > F.col(own))
    found = found.withColumn("_level", F.explode(F.concat(F.array(own), higher))).drop("_used")
    return found.withColumn("_bin", F.explode(bins(start, end, _width(F.col("_level"), width))))


def _renamed(columns: Sequence[str], taken: Sequence[str]) -> list[str]:
    """Right's columns with the suffix _r, and one more for as long as left has such a column."""
    out = []
    for c in columns:
        name = f"{c}_r"
        while name in taken or name in out:
            name += "_r"
        out.append(name)
    return out


def _wide(df: DataFrame, keys: Sequence[str]) -> int:
    """Bytes of a row, about, without the keys."""
    return sum(8 if isinstance(f.dataType, NumericType) else 20 for f in df.schema.fields if f.name not in keys)


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("contig",), how: str = "inner", width: int | None = None, long_rows: bool = True) -> DataFrame:
    """Pairs of rows with equal keys whose [start, end) overlap.

    inner: columns of left, then those of right with the suffix _r (keys once; one more _r where left has such a column,
    so a join's result can be joined again). semi and anti: left's rows with, or without, any partner. left: as inner,
    and rows without a partner with nulls. Null keys or bounds, and empty intervals, never match. Rows that repeat match
    one by one. long_rows=False: no row is much longer than a bin, so one level of bins will do.
    """
    width = width or BIN
    if how in ("semi", "anti"):
        # An interval has a partner if one of its pieces, cut at the bins' bounds, has one in that bin: pieces need no row ids.
        flagged = overlap_flags(left, right, keys, width, long_rows)
        return flagged.where(F.col("_hit") if how == "semi" else ~F.col("_hit")).drop("_hit")
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join {how}")
    rest = [c for c in right.columns if c not in keys]
    names = dict(zip(rest, _renamed(rest, left.columns), strict=True))
    own = {c: f"_k{i}" for i, c in enumerate(keys)}
    a = left.select(*(F.col(c).alias(own.get(c, f"_l{i}")) for i, c in enumerate(left.columns)))
    b = right.select(*(F.col(c).alias(own.get(c, f"_r{i}")) for i, c in enumerate(right.columns)))
    for k in own.values():
        a, b = a.where(F.col(k).isNotNull()), b.where(F.col(k).isNotNull())
    (ls, le), (rs, re) = ([f"_{x}{t.columns.index(c)}" for c in ("start", "end")] for x, t in (("l", left), ("r", right)))
    used = (_levels(b, rs, re, width), _levels(a, ls, le, width)) if long_rows else (None, None)
    # A sort-merge join goes through its first table's rows and holds the other's of a bin. So the pairs of a row of the wider table come beside each other:
    # its values repeat in a run, which takes the least room in a file, and the narrower rows are held. Those of like places come together in each run.
    other = _wide(right, keys) > _wide(left, keys)
    sides = [dealt(a, ls, le, width, used[0], "_a", other), dealt(b, rs, re, width, used[1], "_b", not other)]
    met = sides[other].join(sides[not other], [*own.values(), "_level", "_bin"])
    wide = _width(F.col("_level"), width)
    first = (F.col("_bin") == F.greatest(bin_of(ls, wide), bin_of(rs, wide))) & (F.col("_level") == F.greatest("_aown", "_bown"))
    meet = (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    out = [F.col(own.get(c, f"_l{i}")).alias(c) for i, c in enumerate(left.columns)] + [F.col(f"_r{i}").alias(names[c]) for i, c in enumerate(right.columns) if c not in keys]
    inner = met.where(meet & first).select(*out)
    if how == "inner":
        return inner
    # By content, not by row ids, which a task that runs again may give to other rows.
    missing = overlap_flags(left, right, keys, width, long_rows).where(~F.col("_hit")).select(*left.columns, *(F.lit(None).cast(right.schema[c].dataType).alias(names[c]) for c in rest))
    return inner.unionByName(missing)


def overlap_flags(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("contig",), width: int | None = None, long_rows: bool = True) -> DataFrame:
    """left with `_hit`: whether any row of right overlaps it. Rows that repeat, or have null keys, all stay."""
    width = width or BIN
    # Of right's intervals that begin together the longest meets whatever the others meet. Null keys and empty intervals go first, as
    # in overlap_join, so that an exchange below is made once for both.
    can = [t.where(F.col("start") < F.col("end")) for t in (left, right)]
    for k in keys:
        can = [t.where(F.col(k).isNotNull()) for t in can]
    bounds = [can[0].select(*keys, "start", "end").distinct(), can[1].groupBy(*keys, "start").agg(F.max("end").alias("end")).select(*keys, "start", "end")]
    used = [_levels(t, "start", "end", width) if long_rows else None for t in bounds]
    a, b = dealt(bounds[0], "start", "end", width, used[1], "_a").alias("l"), dealt(bounds[1], "start", "end", width, used[0], "_b").alias("r")
    on = (F.col("l._level") == F.col("r._level")) & (F.col("l._bin") == F.col("r._bin")) & (F.col("l.start") < F.col("r.end")) & (F.col("r.start") < F.col("l.end"))
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    hits = a.join(b, on, "left_semi").select(*keys, "start", "end").distinct().withColumn("_found", F.lit(True))
    return left.join(hits, [*keys, "start", "end"], "left").select(*left.columns, F.coalesce("_found", F.lit(False)).alias("_hit"))


def batch_hits(queries: DataFrame, stored: DataFrame, query_id: str, value: str, keys: Sequence[str] = ("contig",), width: int | None = None) -> DataFrame:
    """For each query, empty ones too: query_id, n_hits, hits (array of (start, end, value), in order)."""
    joined = overlap_join(queries.select(query_id, *(k for k in keys if k != query_id), "start", "end"), stored.select(*keys, "start", "end", F.col(value).alias("value")), keys, "inner", width)
    hits = joined.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct(F.col("start_r").alias("start"), F.col("end_r").alias("end"), F.col("value_r").alias("value")))).alias("hits"))
    out = queries.select(query_id).distinct().join(hits, query_id, "left")
    kind = hits.schema["hits"].dataType
    return out.select(query_id, F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_hits"), F.coalesce("hits", F.array().cast(kind)).alias("hits"))
