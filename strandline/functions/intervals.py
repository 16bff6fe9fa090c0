"""Column expressions over half-open intervals [start, end), orientations and chains.

Orientation is a signed byte: 1 forward, -1 reverse, 0 dual; strand has no 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def interval(start, end) -> Column:
    """struct(start, end); an error unless start < end."""
    start, end = _c(start).cast("long"), _c(end).cast("long")
    return F.when(start < end, F.struct(start.alias("start"), end.alias("end"))).otherwise(F.raise_error(F.lit("an interval needs start < end")))


def length(start, end) -> Column:
    return _c(end) - _c(start)


def contains(start, end, pos) -> Column:
    return (_c(start) <= _c(pos)) & (_c(pos) < _c(end))


def intersects(s1, e1, s2, e2) -> Column:
    """Strict overlap: touching intervals do not intersect."""
    return (_c(s1) < _c(e2)) & (_c(s2) < _c(e1))


def touches(s1, e1, s2, e2) -> Column:
    return (_c(s1) == _c(e2)) | (_c(e1) == _c(s2))


def envelops(s1, e1, s2, e2) -> Column:
    return (_c(s1) <= _c(s2)) & (_c(e2) <= _c(e1))


def intersection(s1, e1, s2, e2) -> Column:
    """struct(start, end), or null."""
    s, e = F.greatest(_c(s1), _c(s2)), F.least(_c(e1), _c(e2))
    return F.when(s < e, F.struct(s.alias("start"), e.alias("end")))


clamped = intersection


def intersection_length(s1, e1, s2, e2) -> Column:
    return F.greatest(F.least(_c(e1), _c(e2)) - F.greatest(_c(s1), _c(s2)), F.lit(0).cast("long"))


def union(s1, e1, s2, e2) -> Column:
    """struct(start, end) of two intervals that overlap or touch, or null."""
    near = (_c(s1) <= _c(e2)) & (_c(s2) <= _c(e1))
    return F.when(near, F.struct(F.least(_c(s1), _c(s2)).alias("start"), F.greatest(_c(e1), _c(e2)).alias("end")))


def extended(start, end, left, right) -> Column:
    left, right = _c(left), _c(right)
    return F.when((left >= 0) & (right >= 0), F.struct((_c(start) - left).alias("start"), (_c(end) + right).alias("end"))).otherwise(F.raise_error(F.lit("an interval is extended by amounts >= 0")))


def shifted(start, end, by) -> Column:
    """By a positive amount to the right (>>), by a negative one to the left (<<)."""
    return F.struct((_c(start) + _c(by)).alias("start"), (_c(end) + _c(by)).alias("end"))


def cast(start, end, kind: str) -> Column:
    """struct of another integer type, or null where a bound does not fit."""
    s, e = _c(start).try_cast(kind), _c(end).try_cast(kind)
    return F.when(s.isNotNull() & e.isNotNull(), F.struct(s.alias("start"), e.alias("end")))


def display(start, end) -> Column:
    return F.concat(F.lit("["), _c(start), F.lit(", "), _c(end), F.lit(")"))


# ---- orientation and strand

_SYMBOLS = {1: "+", -1: "-", 0: "="}


def flipped(orientation) -> Column:
    return (-_c(orientation)).cast("byte")


def orientation_symbol(orientation) -> Column:
    o = _c(orientation)
    return F.when(o == 1, "+").when(o == -1, "-").when(o == 0, "=")


def orientation_of(symbol) -> Column:
    """From + - =, and from . as BED has it."""
    s = _c(symbol)
    return F.when(s == "+", 1).when(s == "-", -1).when(s.isin("=", "."), 0).otherwise(F.raise_error(F.concat(F.lit("unknown orientation "), s))).cast("byte")


def strand_of(orientation) -> Column:
    """An orientation as strand; dual is an error."""
    o = _c(orientation)
    return F.when(o != 0, o).otherwise(F.raise_error(F.lit("a dual orientation is no strand"))).cast("byte")


# ---- chains: array<struct<start, end>>


def chain(links) -> Column:
    """The links, checked: none is empty, they are in order, and they neither overlap nor touch."""
    links = _c(links)
    whole = (F.size(links) > 0) & F.forall(links, lambda x: x["start"] < x["end"])
    ordered = F.forall(F.sequence(F.lit(1), F.size(links)), lambda i: (i == F.size(links)) | (F.element_at(links, i)["end"] < F.try_element_at(links, i + 1)["start"]))
    return F.when(whole & ordered, links).otherwise(F.raise_error(F.lit("links of a chain are ordered, not empty and apart")))


def chain_start(links) -> Column:
    return F.element_at(_c(links), 1)["start"]


def chain_end(links) -> Column:
    return F.element_at(_c(links), -1)["end"]


def chain_length(links) -> Column:
    return F.aggregate(_c(links), F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def chain_display(links) -> Column:
    return F.array_join(F.transform(_c(links), lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")


def merged_array(intervals, distance: int = 0) -> Column:
    """Union of an array of intervals; gaps of at most `distance` are closed. For arrays at the edges of tables, such as a read's blocks."""
    kind = "array<struct<start: bigint, end: bigint>>"
    ordered = F.array_sort(_c(intervals)).cast(kind)
    return F.aggregate(
        ordered,
        F.array().cast(kind),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"] + distance),
            F.concat(
                F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )


# ---- a value for each orientation


class PerOrientation:
    """Columns for forward (1), reverse (-1) and dual (0); without `dual`, for the two strands only."""

    def __init__(self, forward: Column, reverse: Column, dual: Column | None = None):
        self.slots = {1: forward, -1: reverse, **({} if dual is None else {0: dual})}

    @classmethod
    def with_default(cls, default: Column, strands: bool = False) -> PerOrientation:
        return cls(default, default, None if strands else default)

    def map(self, f) -> PerOrientation:
        return PerOrientation(*(f(c) for c in self.slots.values()))

    def replaced(self, orientation: int, value: Column) -> PerOrientation:
        if orientation not in self.slots:
            raise KeyError(f"no value for orientation {orientation}")
        return PerOrientation(*{**self.slots, orientation: value}.values())

    def items(self):
        return self.slots.items()

    def at(self, orientation: Column) -> Column:
        """The value of a row's orientation; null for one without a value."""
        out = F.lit(None)
        for k, c in self.slots.items():
            out = F.when(orientation == k, c).otherwise(out)
        return out
