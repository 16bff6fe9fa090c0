"""Interval algebra, set operations, joins, segments and coordinate mapping against known cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import intervals as iv
from strandline.operators import joins, mapping, segments, setops

IV = "contig string, start long, end long"


def frame(spark, rows, contig="c"):
    return spark.createDataFrame([(contig, s, e) for s, e in rows], IV)


def pairs(df, *cols):
    cols = cols or ("start", "end")
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def brute_merge(rows, distance=0):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1] + distance:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def drawn(seed, n=80, top=400):
    r = random.Random(seed)
    return [(s, s + r.randrange(1, 30)) for s in (r.randrange(-50, top) for _ in range(n))]


def test_merge(spark):
    rows = [(1, 10), (5, 15), (20, 30), (25, 35)]
    assert pairs(setops.merge(frame(spark, rows))) == [(1, 15), (20, 35)]
    assert pairs(setops.merge(frame(spark, []))) == []
    more = frame(spark, [*rows, (100, 200)])
    assert pairs(setops.merge_within(more, 5)) == [(1, 35), (100, 200)]
    assert pairs(setops.merge_within(more, 100)) == [(1, 200)]


@pytest.mark.parametrize("distance,width", [(0, 16), (5, 16), (3, 1 << 16)])
def test_merge_brute(spark, distance, width):
    rows = drawn(distance)
    assert pairs(setops.merge(frame(spark, rows), distance=distance, bin_width=width)) == brute_merge(rows, distance)


def test_subtract(spark):
    got = pairs(setops.subtract(frame(spark, [(50, 110), (0, 100)]), frame(spark, [(25, 75), (90, 100)]), width=16))
    assert got == sorted([(75, 90), (100, 110), (0, 25), (75, 90)])
    assert pairs(setops.subtract(frame(spark, [(1, 10)]), frame(spark, [(2, 4), (6, 8)]))) == [(1, 2), (4, 6), (8, 10)]


def test_overlap_and_flags(spark):
    left, right = [(10, 20), (1, 5), (15, 25)], [(12, 18), (0, 3), (17, 22)]
    assert pairs(setops.overlap(frame(spark, left), frame(spark, right), width=4)) == sorted([(1, 3), (12, 18), (17, 20), (15, 18), (17, 22)])
    flags = setops.overlaps(frame(spark, [(10, 20), (1, 5), (15, 25)]), frame(spark, [(30, 35), (0, 5), (40, 50)]))
    assert pairs(flags, "start", "overlaps") == [(1, True), (10, False), (15, False)]


@pytest.mark.parametrize("how", ["inner", "semi", "anti", "left"])
def test_joins_brute(spark, how):
    a, b = drawn(3) + [(5, 9), (5, 9)], drawn(4)
    got = joins.overlap_join(frame(spark, a), frame(spark, b), ["contig"], how, 16)
    hit = {x: [y for y in b if x[0] < y[1] and y[0] < x[1]] for x in a}
    if how == "inner":
        want = sorted((*x, *y) for x in a for y in hit[x])
        assert pairs(got, "start", "end", "start_r", "end_r") == want
    elif how == "left":
        assert got.count() == sum(max(1, len(hit[x])) for x in a)
    else:
        assert pairs(got) == sorted(x for x in a if bool(hit[x]) == (how == "semi"))


def test_long_rows_make_few(spark):
    short, whole = [(s, s + 50) for s in range(0, 100_000, 100)], [(0, 250_000_000), (-70_000, 3)]
    left, right = frame(spark, [*short, whole[0]]), frame(spark, [*short[::3], *whole])
    used = joins._levels(right, "start", "end", 128)
    assert joins.dealt(frame(spark, [whole[0]]), "start", "end", 128, used, "_a").count() <= 2 * joins.SPAN
    assert joins.dealt(frame(spark, short), "start", "end", 128, used, "_a").count() <= 6 * len(short)
    got = joins.overlap_join(left.repartition(5), right.repartition(3), ["contig"], "inner", 128)
    want = sorted((*x, *y) for x in [*short, whole[0]] for y in [*short[::3], *whole] if x[0] < y[1] and y[0] < x[1])
    assert pairs(got, "start", "end", "start_r", "end_r") == want
    assert joins.overlap_join(left, frame(spark, whole), ["contig"], "semi").count() == len(short) + 1


def test_join_of_a_join(spark):
    a, b, c = drawn(5, 30), drawn(6, 30), drawn(7, 30)
    one = joins.overlap_join(frame(spark, a), frame(spark, b), ["contig"], "inner", 16)
    two = joins.overlap_join(one, frame(spark, c), ["contig"], "inner", 16)
    assert two.columns == ["contig", "start", "end", "start_r", "end_r", "start_r_r", "end_r_r"]
    meet = lambda x, y: x[0] < y[1] and y[0] < x[1]
    assert pairs(two, *two.columns[1:]) == sorted((*x, *y, *z) for x in a for y in b if meet(x, y) for z in c if meet(x, z))


def test_rows_without_ids(spark):
    """Left joins and differences do not depend on where rows stand."""
    rows = drawn(8, 200) + drawn(8, 200)
    df = spark.createDataFrame([("c", s, e, i) for i, (s, e) in enumerate(rows)], IV + ", i long").repartition(7, F.rand())
    drop = frame(spark, drawn(9, 40))
    left = joins.overlap_join(df, drop, ["contig"], "left", 16).collect()
    assert {r.i for r in left} == set(range(len(rows)))
    holes = brute_merge([(r.start, r.end) for r in drop.collect()])
    want = sorted((p, i) for i, (s, e) in enumerate(rows) for p in range(s, e) if not any(a <= p < b for a, b in holes))
    assert sorted((p, r.i) for r in setops.subtract(df, drop, width=16).collect() for p in range(r.start, r.end)) == want


def test_empty_intervals_and_null_keys(spark):
    odd = spark.createDataFrame([("c", 64, 64), ("c", 70, 60), (None, 5, 9), ("c", 5, 9)], IV)
    whole = frame(spark, [(5, 100)])
    assert joins.overlap_join(odd, whole, ["contig"], "inner", 16).count() == 1
    groups = {(r.contig, r.start): r.group_start for r in setops.group_within(odd, 3).collect()}
    assert groups == {("c", 64): None, ("c", 70): None, (None, 5): None, ("c", 5): 5}


def test_joins_nulls_and_empty(spark):
    odd = spark.createDataFrame([(None, 1, 5), ("c", None, 5), ("c", 2, 4)], IV)
    assert joins.overlap_join(odd, frame(spark, [(0, 10)]), ["contig"], "inner", 8).count() == 1
    assert joins.overlap_join(odd, frame(spark, [(0, 10)]), ["contig"], "anti", 8).count() == 2
    assert joins.overlap_join(frame(spark, []), frame(spark, [(0, 10)]), ["contig"], "inner").count() == 0


def test_scalar_algebra(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    lit = lambda *v: [F.lit(x) for x in v]
    assert value(iv.union(*lit(1, 10, 0, 1)))["start"] == 0
    assert value(iv.union(*lit(1, 10, 11, 12))) is None
    assert value(iv.union(*lit(1, 10, 9, 11)))["end"] == 11
    assert value(iv.touches(*lit(1, 5, 5, 7))) and not value(iv.intersects(*lit(1, 5, 5, 7)))
    assert value(iv.cast(F.lit(1), F.lit(300), "byte")) is None
    assert value(iv.orientation_symbol(iv.flipped(F.lit(1)))) == "-"
    for bad in (iv.interval(*lit(3, 3)), iv.extended(*lit(1, 2, -1, 0)), iv.strand_of(F.lit(0))):
        with pytest.raises(Exception):
            value(bad)
    chain = F.expr("array(struct(1L as start, 3L as end), struct(5L as start, 6L as end))")
    assert value(iv.chain_length(iv.chain(chain))) == 3 and value(iv.chain_display(chain)) == "1-3,5-6"
    with pytest.raises(Exception):
        value(iv.chain(F.expr("array(struct(1L as start, 3L as end), struct(3L as start, 6L as end))")))
    merged = value(iv.merged_array(F.expr("array(struct(5L as start, 8L as end), struct(1L as start, 5L as end), struct(9L as start, 9L+1 as end))")))
    assert [tuple(x) for x in merged] == [(1, 8), (9, 10)]


def test_tasks(spark):
    split = lambda rows, n: [(r.task_start, r.start, r.end) for r in setops.split_tasks(frame(spark, rows), n).orderBy("start").collect()]
    assert split([(0, 284)], 100) == [(0, 0, 100), (100, 100, 200), (200, 200, 284)]
    assert split([(0, 3), (2, 5), (4, 8)], 5) == [(0, 0, 5), (5, 5, 8)]
    assert len({t for t, _, _ in split([(0, 10), (100, 110)], 20)}) == 2


LINKS = [(10, 20), (30, 40), (50, 60)]


def test_chain_map(spark):
    chains = spark.createDataFrame([("x", s, e) for s, e in LINKS], "chain_id string, start long, end long")
    ask = lambda rows: spark.createDataFrame([(i, "x", s, e) for i, (s, e) in enumerate(rows)], "query_id long, chain_id string, start long, end long")
    got = mapping.map_intervals(ask([(30, 40), (39, 51), (25, 26), (10, 60)]), chains, width=8)
    assert pairs(got, "query_id", "status", "start", "end") == [(0, "Complete", 10, 20), (1, "Truncated", 19, 21), (2, "None", None, None), (3, "Truncated", 0, 30)]
    back = mapping.invmap_intervals(ask([(5, 29), (-5, 21), (30, 70)]), chains, width=8)
    got = {r.query_id: (r.status, r.links and [tuple(x) for x in r.links]) for r in back.collect()}
    assert got == {0: ("Complete", [(15, 20), (30, 40), (50, 59)]), 1: ("Truncated", [(10, 20), (30, 40), (50, 51)]), 2: ("None", None)}


CASES = [
    ([(10, 20), (50, 80)], [(5, 15, "A"), (60, 70, "B")], [(10, 15, "A"), (15, 20, ""), (50, 60, ""), (60, 70, "B"), (70, 80, "")]),
    ([(0, 10), (20, 30)], [(0, 100, "A"), (0, 2, "A"), (2, 10, "A"), (20, 25, "A"), (25, 30, "A")], [(0, 10, "A"), (20, 30, "A")]),
]


@pytest.mark.parametrize("regions,hits,want", CASES)
def test_hit_segments(spark, regions, hits, want):
    q = spark.createDataFrame([(1, "c", s, e) for s, e in regions], "query_id long, contig string, start long, end long")
    h = spark.createDataFrame([("c", s, e, d) for s, e, d in hits], "contig string, start long, end long, d string")
    got = segments.hit_segments(q, h, "d", width=16).withColumn("data", F.array_join("data", ""))
    assert pairs(got, "start", "end", "data") == want


@pytest.mark.parametrize("piece", [8, 4096])
def test_hit_segments_brute(spark, piece):
    regions, hits = [(1, -20, 60), (1, 60, 90), (2, 30, 200), (3, 500, 510)], [(s, e, i % 4) for i, (s, e) in enumerate(drawn(12, 60, 200))]
    q = spark.createDataFrame([(i, "c", s, e) for i, s, e in regions], "query_id long, contig string, start long, end long")
    h = spark.createDataFrame([("c", *x) for x in hits], "contig string, start long, end long, d long")
    got = [(r.query_id, r.start, r.end, tuple(r.data)) for r in segments.hit_segments(q, h, "d", width=16, piece=piece).collect()]
    want = []
    for i in (1, 2, 3):
        for p in sorted(p for k, s, e in regions if k == i for p in range(s, e)):
            data = tuple(sorted({d for s, e, d in hits if s <= p < e}))
            if want and want[-1][0] == i and want[-1][2] == p and want[-1][3] == data:
                want[-1] = (i, want[-1][1], p + 1, data)
            else:
                want.append((i, p, p + 1, data))
    assert sorted(got) == sorted(want)


def test_tree_queries(spark):
    stored = spark.createDataFrame([("c", 1, 10, "a"), ("c", 5, 15, "b"), ("c", 10, 20, "c")], "contig string, start long, end long, d string")
    q = spark.createDataFrame([(i, "c", s, e) for i, (s, e) in enumerate([(0, 1), (5, 15), (14, 25), (20, 50)])], "query_id long, contig string, start long, end long")
    got = {r.query_id: "".join(h.value for h in r.hits) for r in joins.batch_hits(q, stored, "query_id", "d", width=8).collect()}
    assert got == {0: "", 1: "abc", 2: "bc", 3: ""}


def test_resolve_annotation(spark):
    a = spark.createDataFrame([("c", 1, 0, 10, "x"), ("c", 1, 5, 15, "y"), ("c", 1, 20, 25, "z")], "contig string, orientation int, start long, end long, key string")
    got = segments.resolve_annotation(a, "key", lambda d: F.when(F.size(d) > 1, F.slice(d, 1, 1)).otherwise(d), width=16)
    assert pairs(got, "start", "end", "key") == [(0, 5, "x"), (5, 10, "x"), (10, 15, "y"), (20, 25, "z")]


def test_overlap_moves_places(spark):
    """Rows of the same place are joined once, and all their pairs come back."""
    left = [("a", 0, 10)] * 90 + [("a", 4, 6), ("a", 4, 6), ("a", 9, 9), (None, 0, 10), ("b", 0, 3)]
    right = [("a", 5, 20)] * 100 + [("a", 9, 12), (None, 0, 10), ("b", 3, 5)]
    seen = []

    def cut(places):
        seen.append(places.count())
        return places

    got = setops.overlap(*(spark.createDataFrame(t, "contig string, start long, end long") for t in (left, right)), width=4, cut=cut)
    want = {("a", 5, 10): 9000, ("a", 9, 10): 90, ("a", 5, 6): 200}
    assert {tuple(r)[:3]: r["count"] for r in got.groupBy("contig", "start", "end").count().collect()} == want
    assert seen == [4, 4] and 9000 > 2 * setops.RUN


@pytest.mark.parametrize("how", ["inner", "left"])
def test_wider_rows_in_runs(spark, how):
    """The pairs of a row of the wider table come beside each other, on whichever side it is."""
    n, kinds, limit = 40, ("contig string, start long, end long, id long", "contig string, start long, end long, name string, note string"), "spark.sql.autoBroadcastJoinThreshold"
    narrow, wide = spark.createDataFrame([("a", i, 100 + i, i) for i in range(n)], kinds[0]), spark.createDataFrame([("a", i, 90 + i, f"n{i}", "x") for i in range(n)], kinds[1])
    before = spark.conf.get(limit)
    spark.conf.set(limit, -1)
    try:
        for pair, name in (((narrow, wide), "name_r"), ((wide, narrow), "name")):
            got = [r[name] for r in joins.overlap_join(*pair, how=how, width=1000).collect()]
            assert len(got) == n * n and sum(x != y for x, y in zip(got, got[1:], strict=False)) == n - 1
    finally:
        spark.conf.set(limit, before)


def test_held_rows_in_order(spark):
    """In the run of a wider row its partners come by place, those that one task sent to the bin at least."""
    n, limit = 200, "spark.sql.autoBroadcastJoinThreshold"
    starts = random.Random(5).sample(range(n), n)
    narrow = spark.createDataFrame([("a", s, 500, s) for s in starts], "contig string, start long, end long, id long").coalesce(2)
    wide = spark.createDataFrame([("a", 300, 400, f"n{i}", "x") for i in range(3)], "contig string, start long, end long, name string, note string")
    before = spark.conf.get(limit)
    spark.conf.set(limit, -1)
    try:
        for long_rows in (True, False):
            got = joins.overlap_join(wide, narrow, width=1000, long_rows=long_rows).collect()
            assert len(got) == 3 * n and sum(x.start_r > y.start_r for x, y in zip(got, got[1:], strict=False)) <= 3 * 2 - 1
    finally:
        spark.conf.set(limit, before)
