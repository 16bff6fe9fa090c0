"""Counts without pairs: small tables against brute force, and plans that join no row with another."""

import random

from pyspark.sql import functions as F

from strandline.operators import counting, sums
from strandline.plans import registry

ROW = "id long, contig string, start long, end long"


def meet(q, r):
    return None not in (*q[1:], *r[1:]) and q[1] == r[1] and q[2] < q[3] and r[2] < r[3] and q[2] < r[3] and r[2] < q[3]


def some(rng, n, far):
    at = lambda: rng.randrange(-far, far)
    out = [(rng.randrange(n), rng.choice(["a", "b", None]), s, s + rng.choice([-2, 0, 1, 3, 40, far])) for s in (at() for _ in range(n))]
    return [*out, *out[:5], (n, "a", None, 3), (n + 1, "a", 3, None), (n + 2, "c", 1, 2)]


def test_count_hits(spark):
    rng = random.Random(11)
    for far in (30, 500):
        q, r = some(rng, 60, far), some(rng, 80, far)
        want = {}
        for x in q:
            want[x[0]] = want.get(x[0], 0) + sum(meet(x, y) for y in r)
        got = sums.count_hits(spark.createDataFrame(q, ROW), spark.createDataFrame(r, ROW), "id", width=16)
        assert sorted(map(tuple, got.collect())) == sorted(want.items())


def test_counts_of_parts(spark):
    """Alignments of several blocks and elements of several segments count once; null ids, labels, keys and bounds."""
    rng = random.Random(12)
    kinds = "source string, aln_id string, contig string, orientation int, start long, end long, nh long", "element long, contig string, orientation int, start long, end long"
    for far, many in ((40, 30), (300, 400)):
        a = [(("s0", "s1", None)[i % 3], rng.choice([f"r{rng.randrange(many)}", f"x{i}", f"x{i}", None if i % 9 == 0 else "r0"]), c, 1, s, e, 1 + i % 3) for i, (_, c, s, e) in enumerate(some(rng, 50, far))]
        a.append(("none", "y", None, 1, 1, 2, 1))
        e = [(rng.choice([rng.randrange(8), 100 + i, 100 + i]) if i % 11 else None, c, 1, s, t) for i, (_, c, s, t) in enumerate(some(rng, 30, far))]
        pairs = {(x[0], x[1], y[0], x[6]) for x in a for y in e if meet((0, x[2], x[4], x[5]), (0, *y[1:2], *y[3:]))}
        want = {(s, k): 0 if k is None else sum(round(1e15 / n) for s2, _, k2, n in pairs if (s2, k2) == (s, k)) / 1e15 for s in ("s0", "s1", "none") for k in {y[0] for y in e}}
        for joined in (False, True):
            resolution = (lambda *x: counting.any_overlap(*x)) if joined else counting.any_overlap
            got = counting.count(spark.createDataFrame(a, kinds[0]), spark.createDataFrame(e, kinds[1]), resolution, width=16)
            got = {(r.source, r.element): r["count"] for r in got.collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_top_ranked_of_parts(spark):
    rng = random.Random(13)
    kinds = "source string, aln_id string, contig string, orientation int, start long, end long, nh long", "element long, contig string, orientation int, start long, end long"
    for far, many in ((40, 30), (300, 400)):
        a = [(("s0", "s1")[i % 2], rng.choice([f"r{rng.randrange(many)}", f"x{i}", "one", None if i % 9 == 0 else f"x{i}"]), c, 1, s, e, 1) for i, (_, c, s, e) in enumerate(some(rng, 80, far))]
        a += [(x[0], f"{x[1]}+", *x[2:]) for x in a]
        e = [(rng.choice([rng.randrange(8), 100 + i]), c, 1, s, t) for i, (_, c, s, t) in enumerate(some(rng, 40, far))]
        ranks = {k: k % 5 for k in {y[0] for y in e} if k % 3}
        best = {}
        for x in a:
            for y in e:
                if meet((0, x[2], x[4], x[5]), (0, y[1], *y[3:])):
                    best[x[:2]] = min(best.get(x[:2], (2,)), (y[0] not in ranks, ranks.get(y[0], 0), y[0]))
        want = {(s, k): sum(1.0 for (s2, _), b in best.items() if (s2, b[2]) == (s, k)) for s in ("s0", "s1") for k in {y[0] for y in e}}
        frames = spark.createDataFrame(a, kinds[0]), spark.createDataFrame(e, kinds[1])
        resolve = counting.top_ranked(spark.createDataFrame(list(ranks.items()), "element long, rank long"))
        for way in (resolve, lambda *x: resolve(*x)):
            assert {(r.source, r.element): r["count"] for r in counting.count(*frames, way, width=16).collect()} == want


def test_counts_make_no_pairs(spark, tmp_path):
    """Rows that all lie on one place: 4,000 x 2,000 pairs, and no join makes more rows than there are."""
    lines = spark.range(4000).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(3).cast("long").alias("l_partkey"), F.lit(7).cast("long").alias("l_suppkey"), F.lit(9.0).alias("l_quantity"), F.lit("1992-01-05").cast("date").alias("l_shipdate"), F.lit("A").alias("l_returnflag"))
    orders = spark.range(2000).select(F.col("id").alias("o_orderkey"), F.lit(7).cast("long").alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit("1992-01-05").cast("date").alias("o_orderdate"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = registry.queries()["count_any_overlap"](spark, str(tmp_path))
    assert [tuple(r)[::2] for r in found.collect()] == [("s1", 4000.0)] * 2000
    assert most_joined(found) <= 4000
    assert most_joined(registry.queries()["count_top_ranked"](spark, str(tmp_path))) <= 4000
    found = registry.queries()["overlap_left_counts"](spark, str(tmp_path))
    # Reads lie on [43, 52); elements on [40, 45 + k % 40).
    assert [r.n_hits for r in found.collect()] == [4000] * 2000
    assert most_joined(found) <= 4000


def most_joined(df):
    """Greatest number of rows that a join of the plan that ran made."""
    df.write.format("noop").mode("overwrite").save()
    plan, most = df._jdf.queryExecution(), 0
    plan.executedPlan().executeCollect()
    todo = [plan.executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            if "Join" in name and node.metrics().contains("numOutputRows"):
                most = max(most, node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_join_reads_views_once(spark, tmp_path):
    """The levels in use and the pairs come from one exchange of each view's rows."""
    spark.sql("SELECT id AS l_orderkey, 1 AS l_linenumber, id AS l_partkey, id AS l_suppkey, 9.0D AS l_quantity, date'1992-01-05' AS l_shipdate, 'A' AS l_returnflag FROM range(50)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS o_orderkey, id AS o_custkey, 'F' AS o_orderstatus, date'1992-01-05' AS o_orderdate FROM range(50)").write.parquet(f"{tmp_path}/orders.parquet")
    found = registry.queries()["overlap_join"](spark, str(tmp_path))
    assert found.count() and found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet [l_") == 1 and plan.count("FileScan parquet [o_") == 1


def test_segments_make_no_pairs(spark, tmp_path):
    """4,000 reads of three labels in one place, under 2,000 elements of 40 places: a join makes a row for a label and place, or an element."""
    spark.sql("SELECT id AS l_orderkey, 1 + id % 3 AS l_linenumber, 3L AS l_partkey, 7L AS l_suppkey, 9.0D AS l_quantity, date'1992-01-05' AS l_shipdate, 'A' AS l_returnflag FROM range(4000)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS o_orderkey, 7L AS o_custkey, 'F' AS o_orderstatus, date'1992-01-05' AS o_orderdate FROM range(2000)").write.parquet(f"{tmp_path}/orders.parquet")
    asked = lambda: registry.queries()["hit_segments"](spark, str(tmp_path))
    # Reads lie on [43, 52); elements on [40, 45 + k % 40).
    want = [(k, s, e, d) for k in range(2000) for s, e, d in ((40, 43, ""), (43, min(52, 45 + k % 40), "1,2,3"), (52, 45 + k % 40, "")) if s < e]
    assert sorted(map(tuple, asked().collect())) == want
    assert most_joined(asked()) <= 2000


def test_weights_of_parts(spark, tmp_path):
    """Shares by positions: alignments of several blocks, elements of several segments that overlap; and no pairs of reads and elements."""
    rng = random.Random(14)
    kinds = "source string, aln_id string, contig string, orientation int, start long, end long, nh long", "element long, contig string, orientation int, start long, end long"
    for far in (40, 300):
        a = [(("s0", "s1", None)[i % 3], f"r{rng.randrange(40)}", c, 1, s, e, 1 + i % 2) for i, (_, c, s, e) in enumerate(some(rng, 50, far)) if s is not None and e is not None]
        e = [(rng.choice([rng.randrange(8), 100 + i]), c, 1, s, t) for i, (_, c, s, t) in enumerate(some(rng, 30, far))]
        held, read = {}, {}
        for k, c, _, s, t in e:
            if c is not None and s is not None and t is not None:
                for p in range(s, t):
                    held.setdefault((c, p), set()).add(k)
        for s, n, c, _, x, y, nh in a:
            read.setdefault((s, n, c, nh), set()).update(range(x, y))
        want = {(s, k): 0.0 for s in ("s0", "s1") for k in {y[0] for y in e}}
        for (s, _, c, nh), at in read.items():
            for p in at if s else ():
                for k in held.get((c, p), ()):
                    want[s, k] += 1 / (len(at) * nh * len(held[c, p]))
        for way in (counting.overlap_weighted, lambda *x: counting.overlap_weighted(*x)):
            got = counting.count(spark.createDataFrame(a, kinds[0]), spark.createDataFrame(e, kinds[1]), way, width=16)
            got = {(r.source, r.element): r["count"] for r in got.collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    spark.sql("SELECT id AS l_orderkey, 1 AS l_linenumber, id AS l_partkey, 7L AS l_suppkey, 9.0D AS l_quantity, date'1992-01-05' AS l_shipdate, 'A' AS l_returnflag FROM range(2000)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS o_orderkey, 7L AS o_custkey, 'F' AS o_orderstatus, date'1992-01-05' AS o_orderdate FROM range(1000)").write.parquet(f"{tmp_path}/orders.parquet")
    assert most_joined(registry.queries()["count_overlap_weighted"](spark, str(tmp_path))) <= 2000


def test_left_join_reads_reads_once(spark, tmp_path):
    """Pairs, and what has none, come from one exchange of the reads."""
    spark.sql("SELECT id AS l_orderkey, 1 AS l_linenumber, id AS l_partkey, id AS l_suppkey, 9.0D AS l_quantity, date'1992-01-05' AS l_shipdate, 'A' AS l_returnflag FROM range(50)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS o_orderkey, id AS o_custkey, 'F' AS o_orderstatus, date'1992-01-05' AS o_orderdate FROM range(50)").write.parquet(f"{tmp_path}/orders.parquet")
    found = registry.queries()["overlap_left"](spark, str(tmp_path))
    assert found.count() and found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet [l_") == 1
