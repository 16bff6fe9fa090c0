"""Tracks, peaks, reads, pileups and counts against known cases and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import counting, peaks, pileup, reads, tracks


def runs(spark, values, contig="c", start=0):
    return spark.createDataFrame([(contig, s, e, v) for s, e, v in tracks.runs_of(np.array(values, float), start)], "contig string, start long, end long, value double")


def got(df):
    return sorted((r.start, r.end, r.value) for r in df.collect())


def test_coverage_brute(spark):
    r = random.Random(1)
    rows = [("c", s, s + r.randrange(1, 20), r.randrange(1, 4)) for s in (r.randrange(-30, 100) for _ in range(60))]
    dense = np.zeros(200)
    for _, s, e, n in rows:
        dense[s + 50 : e + 50] += 12 / n
    want = [x for x in tracks.runs_of(dense, -50) if x[2]]
    df = spark.createDataFrame(rows, "contig string, start long, end long, nh int")
    assert got(tracks.coverage(df, ["contig"], F.lit(12) / F.col("nh"), width=16)) == want
    clipped = tracks.coverage(df, ["contig"], F.lit(12) / F.col("nh"), (0, 50), 16)
    assert got(clipped) == [x for x in tracks.runs_of(dense[50:100], 0) if x[2]]


def test_coverage_keeps_small_weights(spark):
    df = spark.createDataFrame([("c", 0, 10, 1e-13), ("c", 5, 8, 1.0), ("c", 20, 20, 1.0)], "contig string, start long, end long, w double")
    assert got(tracks.coverage(df, ["contig"], F.col("w"))) == [(0, 5, 1e-13), (5, 8, 1.0 + 1e-13), (8, 10, 1e-13)]
    assert got(tracks.coverage(df, ["contig"])) == [(0, 5, 1.0), (5, 8, 2.0), (8, 10, 1.0)]


def test_merge2(spark):
    top = lambda a, b: F.greatest(a, b)
    assert got(tracks.rle_merge2(runs(spark, [3, 3, 3]), runs(spark, [1, 2, 4]), top)) == [(0, 2, 3.0), (2, 3, 4.0)]
    long = got(tracks.rle_merge2(runs(spark, [3, 4, 5, 6, 6, 6]), runs(spark, [1, 2, 3, 4, 5, 6]), top))
    assert [(e - s, v) for s, e, v in long] == [(1, 3), (1, 4), (1, 5), (3, 6)]
    assert got(tracks.rle_merge2(runs(spark, []), runs(spark, [1, 2, 2]), top)) == [(0, 1, 1.0), (1, 3, 2.0)]


def test_tolerant_runs(spark):
    assert [(s, e) for s, e, _ in got(tracks.rle_encode_tolerant(runs(spark, [1, 1.4, 1.8, 3]), 0.5))] == [(0, 2), (2, 3), (3, 4)]


def test_enrichment_and_peaks(spark):
    e = peaks.enrichment(runs(spark, [0, 4, 4, 2]), runs(spark, [1, 2, 0, 4]), keys=["contig"])
    assert got(e) == [(0, 1, 0.0), (1, 2, 2.0), (2, 3, float("inf")), (3, 4, 0.5)]
    track = runs(spark, [0, 2, 3, 3, 0, 5, 5, 0, 0, 0, 2, 2])
    found = peaks.call_peaks(track, peaks.Cutoff(2, 1, 2), ["contig"]).collect()
    assert [(p.start, p.end, p.signal, p.summit) for p in found] == [(1, 7, 5.0, 6)]


@pytest.mark.parametrize("window", [4, 5])
def test_smooth_brute(spark, window):
    links = [(2, 7), (12, 20)]
    values = np.array([random.Random(i).randrange(5) for i in range(25)], float)
    chains = spark.createDataFrame([("x", "c", s, e) for s, e in links], "chain_id string, contig string, start long, end long")
    spliced = np.concatenate([values[s:e] for s, e in links])
    places = [p for s, e in links for p in range(s, e)]
    want = {}
    for i, p in enumerate(places):
        a = i - window // 2
        if a >= 0 and a + window <= len(spliced):
            want[p] = spliced[a : a + window].mean()
    out = peaks.smooth(runs(spark, values), chains, peaks.ControlModel((window,)), ["contig"])
    assert {r.pos: pytest.approx(r.value) for r in out.collect()} == want
    flat = peaks.smooth(runs(spark, values), chains, peaks.ControlModel((), True), ["contig"])
    assert {round(r.value, 9) for r in flat.collect()} == {round(spliced.mean(), 9)}


def test_nms_uniform_brute(spark):
    r = random.Random(5)
    s, c = np.array([r.randrange(6) for _ in range(40)], float), np.array([r.randrange(3) for _ in range(40)], float)
    peak, roi = [(3, 18), (20, 36)], (0, 30)
    df = lambda rows, x: spark.createDataFrame([(f"{x}{i}", "c", a, b) for i, (a, b) in enumerate(rows)], "roi_id string, contig string, start long, end long")
    got_ = peaks.nms_uniform(df(peak, "p"), df([roi], "r"), runs(spark, s), runs(spark, c), peaks.Nms(1.0), ["contig"])
    on = [p for p in range(*roi) if s[p] > 0 or c[p] > 0]
    d = {p: s[p] - c[p] for p in on}
    least = min(d.values())
    base = sum(d.values()) / len(on) - least
    want = []
    for a, b in peak:
        run = []
        for p in [*range(a, b), None]:
            if p is not None and p in d and d[p] - least >= base:
                run.append(p)
            else:
                if len(run) > 1:
                    want.append((run[0], run[-1] + 1, max(d[q] - least for q in run)))
                run = []
    assert sorted((x.start, x.end, x.signal) for x in got_.collect()) == sorted(want)
    grouped = peaks.nms_slop(df(peak, "p"), df([roi], "r"), runs(spark, s), runs(spark, c), peaks.Nms(1.0, 5, 0.5, (2, 10)), ["contig"])
    assert grouped.count() >= 0
    with pytest.raises(ValueError):
        peaks.Nms(fold=0.5)


READS = "qname string, flags int, contig string, start long, mapq int, cigar array<struct<op: string, len: int>>, seq string, quals array<int>, nh int, hi int"


def test_strand_rules(spark):
    df = spark.createDataFrame([(64 * f + 16 * r,) for f in (1, 0) for r in (1, 0)], "flags int")
    forward = [r[0] for r in df.select(reads.orientation("flags", "PE", "forward")).collect()]
    assert forward == [-1, 1, 1, -1]
    assert [r[0] for r in df.select(reads.orientation("flags", "PE", "reverse")).collect()] == [1, -1, -1, 1]


def test_blocks_pairs_and_filter(spark):
    def read(name, flags, start, cigar, nh=1, hi=1):
        return (name, flags, "c", start, 30, [{"op": o, "len": n} for o, n in cigar], "A" * 50, [30] * 50, nh, hi)

    rows = [read("a", 99, 10, [("S", 2), ("M", 5), ("N", 10), ("M", 5)]), read("a", 147, 20, [("M", 8), ("D", 1), ("M", 2)]), read("b", 99, 1, [("M", 3)]), read("c", 4, 1, [("M", 3)])]
    df = spark.createDataFrame(rows, READS)
    assert reads.flag_filter(df).count() == 3
    assert reads.in_region(df, "c", 11, 30).count() == 2
    single = {(r.qname, tuple(map(tuple, r.blocks))) for r in reads.single_alignments(df.where("qname = 'a' and flags = 99")).collect()}
    assert single == {("a", ((10, 15), (25, 30)))}
    pair = reads.paired_alignments(df).collect()
    assert len(pair) == 1 and [tuple(b) for b in pair[0].blocks] == [(10, 15), (20, 31)] and pair[0].orientation == -1
    with pytest.raises(Exception, match="hit index"):
        reads.mate_pairs(df.withColumn("hi", F.lit(None).cast("int"))).collect()
    assert [tuple(x) for x in spark.range(1).select(reads.parse_cigar(F.lit("3S10M2D")).alias("c")).first().c] == [("S", 3), ("M", 10), ("D", 2)]


def test_pileup(spark):
    row = ("t", "s", 1, 5, [{"op": "S", "len": 1}, {"op": "M", "len": 3}, {"op": "I", "len": 1}, {"op": "D", "len": 2}, {"op": "N", "len": 4}, {"op": "M", "len": 1}], "XACGTRT", [9, 30, 5, 30, 30, 30, 30])
    df = spark.createDataFrame([row], "tag string, seqid string, orientation int, start long, cigar array<struct<op: string, len: int>>, seq string, quals array<int>")
    sites = {r.position: r for r in pileup.counts(pileup.explode_bases(df, 10)).collect()}
    assert sorted(sites) == [5, 7, 8, 9, 14]
    assert sites[5].A == 1 and sites[7].G == 1 and sites[8].deletion == 1 and sites[14].N == 1
    refs = spark.createDataFrame([("s", "NNNNNAAAAAAAAAAAAAAAA")], "seqid string, seq string")
    chosen = pileup.pileup(df, refs, pileup.select_mismatches(1, 0.5), min_phred=10)
    assert sorted(r.position for r in chosen.collect()) == [7, 8, 9, 14]


def test_counts(spark):
    a = spark.createDataFrame([("s", "r1", "c", 1, 0, 10, 2), ("s", "r2", "c", 1, 100, 110, 1), ("s", "r3", "c", 0, 0, 10, 1)], "source string, aln_id string, contig string, orientation int, start long, end long, nh int")
    e = spark.createDataFrame([("x", "c", 1, 0, 4), ("y", "c", 1, 2, 8), ("z", "c", -1, 0, 9)], "element string, contig string, orientation int, start long, end long")
    table = lambda df: {r["element"]: round(r["count"], 9) for r in df.collect()}
    assert table(counting.count(a, e, width=16)) == {"x": 0.5, "y": 0.5, "z": 0.0}
    weighted = table(counting.count(a, e, counting.overlap_weighted, width=16))
    assert weighted == {"x": round((2 + 1) / 20, 9), "y": round((4 + 1) / 20, 9), "z": 0.0}
    ranks = spark.createDataFrame([("y", 0), ("x", 1)], "element string, rank int")
    assert table(counting.count(a, e, counting.top_ranked(ranks), width=16)) == {"x": 0.0, "y": 1.0, "z": 0.0}
    assert counting.outcomes(a, e, 16).first()["discarded"] == 2
