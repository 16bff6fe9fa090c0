"""Registered queries take all rows of their tables: small tables against brute force."""

import datetime
import random
import time

import numpy as np
import pytest

from strandline.operators import repeats
from strandline.operators.align import Scoring, align
from strandline.plans import registry


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng, root = random.Random(4), str(tmp_path_factory.mktemp("small"))
    day = lambda: datetime.date(1992, 1, 1) + datetime.timedelta(rng.randrange(60))
    orders = [(k, rng.randrange(3), rng.choice("FOP"), day()) for k in range(1, 81)]
    lines = [(rng.randrange(1, 81), rng.randrange(1, 8), rng.randrange(1, 50), rng.randrange(3), float(rng.randrange(1, 51)), day(), rng.choice("ARN")) for _ in range(300)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date").write.parquet(f"{root}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_shipdate date, l_returnflag string").write.parquet(f"{root}/lineitem.parquet")
    days = lambda d: (d - datetime.date(1992, 1, 1)).days
    elements = [(f"c{c % 7}", {"F": 1, "O": -1}.get(s, 0), days(d) * 10, days(d) * 10 + 5 + k % 40) for k, c, s, d in orders]
    reads = [(f"s{n % 2}", f"c{u % 7}", {"A": 1, "R": -1}.get(f, 0), days(d) * 10 + p % 10, days(d) * 10 + p % 10 + int(q)) for _, n, p, u, q, d, f in lines]
    return root, elements, reads


def test_regions_are_all_elements(spark, small):
    root, elements, reads = small
    inside = {(c, o, p) for c, o, a, b in elements for p in range(a, b)}
    covered = {(c, o, p) for s, c, o, a, b in reads if s == "s0" for p in range(a, b)}
    regions: dict = {}
    # Elements that touch are one link; links that begin in the same 500 positions are one region.
    for c, o, p in sorted(inside):
        if (c, o, p - 1) not in inside:
            start = p
        regions.setdefault((c, o, start // 500), set()).add((c, o, p))
    want = set().union(*(r for r in regions.values() if r & covered))
    got = {(r.contig, r.orientation, r.pos) for r in registry.queries()["smooth_control"](spark, root).collect()}
    assert got == want


def test_required_are_all_elements(spark, small):
    root, elements, _ = small
    inside = {(c, o, p) for c, o, a, b in elements for p in range(a, b)}
    sites = {tuple(r)[:4] for r in registry.queries()["pileup_counts"](spark, root).select("tag", "seqid", "orientation", "position").collect()}
    got = {tuple(r) for r in registry.queries()["select_required"](spark, root).select("tag", "seqid", "orientation", "position").collect()}
    assert got == {s for s in sites if s[1:] in inside}


def predicted_by_scan(seq, keep):
    """As repeats.predict, by the alignment cell by cell."""
    n, taken, out = len(seq), set(), []
    found = align(seq[::-1], seq, repeats.RNA, best=False, inside=lambda i, j: i + j < n - 1) if n else []
    for f in sorted(found, key=lambda f: (-f.score, f.start2, f.start1)):
        cells, arms = {(i, j) for i, j, op in f.cells() if op in "=X~"}, repeats.arms_of(f, n)
        if arms and keep.passes(f.score, arms) and not cells & taken:
            taken |= cells
            out.append((f.score, arms))
    return out


def test_repeats_by_diagonals():
    rng = random.Random(5)
    for n in [*range(8), *(rng.randrange(8, 130) for _ in range(40))]:
        seq = "".join(rng.choice("ACGU") for _ in range(n))
        seq += "".join({"A": "U", "C": "G", "G": "C", "U": "A"}[c] for c in reversed(seq[: n // 2] + seq[n // 2 + 3 :])) * (n % 2)  # with gaps that pay
        for keep in (repeats.Filter(), repeats.Filter(min_score=3, min_matches=3)):
            assert repeats.predict(seq, keep) == predicted_by_scan(seq, keep)


def best_total(found, lo, hi):
    """Greatest total of (score, arms) inside [lo, hi), by trying each as the first."""
    top = 0
    for score, arms in found:
        edges = sorted([a[:2] for a in arms] + [a[2:] for a in arms])
        if lo <= edges[0][0] and edges[-1][1] <= hi:
            within = sum(best_total(found, a[1], b[0]) for a, b in zip(edges, edges[1:], strict=False))
            top = max(top, score + within + best_total(found, edges[-1][1], hi))
    return top


def test_best_set_by_trial():
    rng = random.Random(6)
    for n in (0, 3, 12, 16, 20, 24):
        seq = "".join(rng.choice("ACGU") for _ in range(n))
        found = repeats.predict(seq, repeats.Filter(min_score=2))[:9]
        for scores in ([s for s, _ in found], [s / 7 for s, _ in found]):
            chosen, total = repeats.optimize([a for _, a in found], scores)
            assert total == pytest.approx(best_total([(s, a) for s, (_, a) in zip(scores, found, strict=True)], 0, n))
            assert sum(scores[i] for i in chosen) == pytest.approx(total)


def test_best_set_in_one_task_or_by_groups(spark):
    texts = [(1, "GAUUACA" * 9), (2, None), (3, ""), (4, "AAAACCCCGGGGUUUU"), (None, "ACGUACGU")]
    frame = spark.createDataFrame(texts, "seqid long, seq string")
    keep = repeats.Filter(min_score=2)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(repeats.best_repeats(frame, keep)) == rows(repeats.optimize_repeats(repeats.predict_repeats(frame, keep)).select("seqid", "repeat_id", "score", "total"))


def test_repeats_of_whole_texts(spark, tmp_path):
    texts = [(1, "aaaacccc " + "x" * 50 + " ggggtttt"), (2, None), (3, "gattaca " * 12)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {1: "AAAACCCCGGGGUUUU", 3: "GAUUACA" * 12}
    got = registry.queries()["inverted_repeats"](spark, str(tmp_path)).collect()
    keep = repeats.Filter(min_score=3, min_matches=3)
    expected = sorted((k, n, s, a) for k, seq in want.items() for n, (s, a) in enumerate(predicted_by_scan(seq, keep)))
    assert sorted((r.seqid, r.repeat_id, r.score, [tuple(x) for x in r.segments]) for r in got) == expected
    assert {r.seqid for r in registry.queries()["repeat_optimize"](spark, str(tmp_path)).collect()} == {1, 3}


def test_time_of_repeats():
    """Cell by cell or path by path in Python these take several times as long."""
    rng, keep = random.Random(7), repeats.Filter(min_score=3, min_matches=3)
    seqs = ["".join(rng.choice("ACGU") for _ in range(2500)) for _ in range(4)]
    began = time.process_time()
    found = [repeats.predict(seq, keep) for seq in seqs]
    assert min(map(len, found)) > 10_000 and time.process_time() - began < 4


def test_repeats_of_several_sequences_at_once():
    rng = random.Random(8)
    seqs = ["".join(rng.choice("ACGU") for _ in range(n)) for n in (2, 3, 40, 41, 90, 97)]
    for scoring in (repeats.RNA, Scoring(1, -2, 0, 0, True), Scoring(3, -2, -2, -1, True, (("G", "U", 1), ("U", "G", 1)))):
        keep, out = repeats.Filter(min_score=3, min_matches=3), [[] for _ in seqs]
        r = repeats._repeats(seqs, keep, scoring)
        for at, doc in enumerate(r.doc.tolist()):
            out[doc].append((int(r.score[at]), list(zip(*(t[r.first[at] : r.first[at + 1]].tolist() for t in r.arms), strict=True))))
        assert out == [repeats.predict(seq, keep, scoring) for seq in seqs]


def test_best_sets_of_several_sequences_at_once():
    rng, keep = random.Random(9), repeats.Filter(min_score=2)
    seqs = ["".join(rng.choice("ACGU") for _ in range(n)) for n in (12, 50, 51, 120)]
    r = repeats._repeats(seqs, keep, repeats.RNA)
    sets = repeats._best_sets(4, 120, np.int16, r.doc, r.arms[0][r.first[:-1]], r.arms[3][r.first[:-1]], r.score, repeats._gaps(r.first, r.arms))
    for (chosen, total), seq in zip(sets, seqs, strict=True):
        found = repeats.predict(seq, keep)
        assert (r.repeat_id[chosen].tolist(), total) == repeats.optimize([a for _, a in found], [s for s, _ in found])
