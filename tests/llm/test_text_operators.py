"""Substring dedup, Jaccard join, mixing, Katz scores and license scans against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import jaccard, katz, licenses, mixing, substrings
from strandline.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    """Random words from a small vocabulary, with shared passages, copies, near copies and odd rows."""
    r = random.Random(seed)
    word = lambda: r.choice("the of and to in a is that it for".split() + [f"w{i}" for i in range(300)])
    passages = [[word() for _ in range(40)] for _ in range(3)]
    texts = []
    for i in range(n):
        w = [word() for _ in range(r.randrange(5, 120))]
        if i % 4 == 0:
            at = r.randrange(len(w))
            w[at:at] = r.choice(passages)
        if i % 7 == 6:
            w = texts[r.randrange(len(texts))].split()
        if i % 11 == 10:
            w = texts[r.randrange(len(texts))].split()
            w[len(w) // 2] = "changed"
        texts.append(r.choice([" ", "  ", "\n"]).join(w))
    texts += [None, "", "   ", "one", "a b c d", "é ß 日本 " * 3, "for " * 50, "x" * 5000 + " y", " ".join(word() for _ in range(3000))]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


def words_of(text):
    return (text or "").encode().split()


def frame(spark, rows):
    return spark.createDataFrame(rows, DOC)


# ---- 1


def brute_repeats(rows, length=13):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < i:
                gone |= set(range(p, p + length))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_brute(spark, seed):
    rows = corpus(seed)
    rows.append(rows[3])  # a repeated row
    got = substrings.remove_repeats(frame(spark, rows).withColumn("pid", F.lit("x")).withColumn("_text", F.lit(1)))
    assert {"pid", "_text", "lang", "_dedup"} <= set(got.columns)
    got = sorted((r.doc_id, r._dedup.n_words, r._dedup.n_removed, r.text.encode()) for r in got.collect())
    assert got == brute_repeats([(i, t) for i, t, *_ in rows])
    assert sum(g[2] for g in got) > 100


def test_substrings_layout_and_edges(spark):
    p = " ".join(f"w{i}" for i in range(20))
    rows = [(1, p, "", "", 0), (2, f"a\n b  {p}  c\n", "", "", 0), (None, p, "", "", 0), (3, None, "", "", 0)]
    got = {r.doc_id: r for r in substrings.remove_repeats(frame(spark, rows), layout=True).collect()}
    assert got[1].text == p and got[2].text == "a\n b  c\n" and got[None].text == "" and got[3].text == ""
    assert [list(x) for x in got[2]._dedup.repeats] == [[2, 22]] and got[2]._dedup.sources == [1] == got[None]._dedup.sources
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("collide", [False, True])
def test_extension_compares_words(monkeypatch, collide):
    """Occurrences of one anchor that differ somewhere around it match just as far as their words are equal, even if all hashes collide."""
    if collide:
        monkeypatch.setattr(substrings, "mix", lambda x: x & np.uint64(1))
    r = np.random.default_rng(3)
    around = r.integers(1, 3, (200, 14)).astype(np.uint64)
    anchor, ids = r.integers(1, 3, 200).astype(np.uint64) * np.uint64(2), r.integers(0, 40, 200)
    low, high = r.integers(0, 4, 200), r.integers(4, 8, 200)
    bits, source = substrings.extended(anchor, around, low, high, ids)
    for i in range(200):
        want, least = 0, substrings._LAST
        for b in range(low[i], high[i] + 1):
            cols = [*range(b), *range(7, 14 - b)]
            same = [j for j in range(200) if low[j] <= b <= high[j] and anchor[j] == anchor[i] and (around[j, cols] == around[i, cols]).all()]
            if min(ids[same]) < ids[i]:
                want, least = want | 1 << b, min(least, min(ids[same]))
        assert (bits[i], source[i]) == (want, least)


# ---- 3


def brute_classes(rows, k=5, t=0.8):
    sets = [frozenset(tuple(w[p : p + k]) for p in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []) for w in (words_of(x) for _, x in rows)]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and n / len(sets[i] | sets[j]) >= t:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    names = defaultdict(list)
    for i in range(len(rows)):
        names[find(i)].append(rows[i][0])
    return sorted((rows[i][0], min(names[find(i)]), links[i]) for i in range(len(rows)))


@pytest.mark.parametrize("block", [200, 500_000])
def test_jaccard_brute(spark, block):
    rows = corpus(5)
    rows.append(rows[2])
    got = jaccard.jaccard_join(frame(spark, rows).withColumn("node", F.lit(0)), block=block)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == brute_classes([(i, t) for i, t, *_ in rows])


def test_jaccard_near_copies_of_null_ids(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(4, a), (None, a + " x"), (None, a + " x"), (None, b), (None, b + " y"), (7, "alone and apart from all others")]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(4, 4, 2), (7, 7, 0), (None, 4, 2), (None, 4, 2), (None, None, 1), (None, None, 1)]
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_jaccard_empty_and_depth(spark):
    assert jaccard.jaccard_join(frame(spark, [])).count() == 0
    assert jaccard.prefix_depth(0.8, 40, 8, 0.99999) == 6 and jaccard.prefix_depth(0.99, 40, 8, 0.9) == 8
    possible = {n: {a / (n + b) for a in range(n + 1) for b in range(n) if (a, b) != (n, 0) and a / (n + b) >= 0.8} for n in range(1, 40)}
    assert {n: jaccard.least_similarity(n, 0.8) for n in possible} == {n: min(p, default=None) for n, p in possible.items()}
    need = jaccard.needs(0.8, 40, 7, 0.99999)
    assert need[:8].tolist() == [0, 0, 0, 0, 6, 6, 7, 7] and need[-1] == 6


def test_common_levels():
    keys = np.array([0x0102030405060708, 0x0102030405060708, 0x0102030405060709, 0x01020304050607FF + (1 << 8), 0x0202030405060708, -1, -2], np.int64)
    assert jaccard.common_levels(keys).tolist() == [7, 6, 5, -1, -1, 6]


def test_forest_recall_by_level(spark):
    """Links by matched level against brute force: recall rises as prefixes are shortened, and reaches the target."""
    r = random.Random(11)
    rows = []
    for c in range(60):
        base = [f"w{r.randrange(10**6)}" for _ in range(80)]
        rows.append((2 * c, " ".join(base)))
        rows.append((2 * c + 1, " ".join(base[: 80 - r.randrange(1, 9)] + [f"v{r.randrange(10**6)}" for _ in range(r.randrange(0, 8))])))
    near = {(i, j) for i, ids, n in [(a, b, c) for a, b, c in brute_classes(rows)] for j in [ids] if n and i != j}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.nodes_of(docs, 5, jaccard.TREES, jaccard.DEEPEST, jaccard.needs(0.8, jaccard.TREES, jaccard.DEEPEST, jaccard.RECALL), "doc_id", "text")
    ids = {x.node: x.doc_id for x in found.collect()}
    links = [(tuple(sorted((ids[x.a], ids[x.b]), reverse=True)), x.level) for x in jaccard.forest_links(found.drop("doc_id")).collect()]
    recall = [len({p for p, level in links if level >= d} & near) / len(near) for d in (7, 6)]
    assert len(near) > 30 and recall[0] <= recall[1] == 1.0 and {level for _, level in links} <= {6, 7}


def test_hot_copies(spark):
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(62))
    rows = [(i, text) for i in range(3000)] + [(5000, other), (5001, None), (5002, "")] + [(i, f"doc {i} of its own and of no other") for i in range(6000, 6400)]
    got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got[0] == (0, 3000) == got[2999] and got[5000] == (0, 3000) and got[5001] == (5001, 0) and got[6001] == (6001, 0) and len(got) == len(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


# ---- 4


def water(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    target = {s: total * w[s] / sum(w.values()) for s in names}
    while True:
        over = [s for s in free if target[s] > most * sizes[s] + 1e-9]
        if not over:
            return target
        excess = sum(target[s] - most * sizes[s] for s in over)
        for s in over:
            target[s] = most * sizes[s]
            free.discard(s)
        for s in free:
            target[s] += excess * w[s] / sum(w[x] for x in free)


@pytest.mark.parametrize("seed,whole", [(1, False), (2, True)])
def test_mixing(spark, seed, whole):
    r = random.Random(seed)
    sources = ["a", "b", "B", "é", None, "", "zz"]
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 30, 200])), "", r.choice(sources[:2] if i % 3 else sources), 0) for i in range(400)]
    rows += [(1000, None, "", "only empty", 0), rows[5]]
    sizes = Counter()
    for row in rows:
        sizes[row[3]] += len(words_of(row[1]))
    want = water(dict(sizes))
    out = mixing.mix(mixing.sized(frame(spark, rows)), buckets=8, whole=whole).collect()
    again = mixing.mix(mixing.sized(frame(spark, rows[::-1]).repartition(5)), buckets=8, whole=whole).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    taken = Counter()
    for x in out:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source]
        assert x.taken <= 3 * x.size and len(x.times) <= 3 and all(0 <= t <= 1 for t in x.times)
        taken[x.source] += x.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= (100 if whole else 1)
    assert mixing.mix(mixing.sized(frame(spark, []))).count() == 0


def test_inverse_time(spark):
    rows = spark.range(101).select((F.col("id") / 100).alias("x"))
    for g in (0.8, 0.0, -0.8):
        t = mixing.inverse_time(F.col("x"), F.lit(g))
        for r in rows.select("x", t.alias("t")).collect():
            assert r.t + g * r.t * (1 - r.t) == pytest.approx(r.x, abs=1e-9)


# ---- 5


def brute_katz(rows):
    low = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    docs = [(i, low((t or "").encode()).split() + [None]) for i, t in rows]
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0 for i, _ in docs]
    uni, bi, hist = Counter(), Counter(), Counter()
    for (_, w), h in zip(docs, held, strict=True):
        if not h:
            uni.update(w)
            bi.update(zip(["<"] + w[:-1], w, strict=True))
            hist.update(["<"] + w[:-1])
    N, V = sum(uni.values()), len(uni)
    count = lambda c: np.array([sum(v == r for v in c.values()) for r in range(1, 7)])
    u, d = katz.Unigrams(N, V, count(uni)), katz.discounts(count(bi))
    p = lambda w: float(u.probability(np.array([uni[w]]))[0])
    cut = lambda c: 1.0 if c > 5 else d[c]
    follow = defaultdict(list)
    for (v, w), c in bi.items():
        follow[v].append((w, c))
    alpha, whole = {}, {}
    for v, ws in follow.items():
        left = sum(c * (1 - cut(c)) for _, c in ws)
        whole[v] = hist[v] + (left <= 0)
        alpha[v] = (left if left > 0 else 1.0) / whole[v] / (1 - sum(p(w) for w, _ in ws))
        seen = sum(cut(c) * c / whole[v] for _, c in ws)
        unseen = alpha[v] * (sum(p(w) for w in uni if (v, w) not in bi) + u.unknown)
        assert seen + unseen == pytest.approx(1.0)  # exactly normalised
    out = []
    for (i, w), h in zip(docs, held, strict=True):
        s = b = 0.0
        for v, x in zip(["<"] + w[:-1], w, strict=True):
            c = bi[v, x]
            s += math.log10(cut(c) * c / whole[v] if c else alpha.get(v, 1.0) * p(x))
            b += math.log10((uni[x] + 0.1) / (N + 0.1 * (V + 1)))
        out.append((i, h, len(w), sum(uni[x] > 0 for x in w), N, b, s))
    return out


def test_katz_brute(spark):
    rows = [(i, t) for i, t, *_ in corpus(9, 50)] + [(3, "repeated ID")]
    got = katz.score(spark.createDataFrame(rows, "doc_id long, text string").withColumn("pid", F.lit(1)))
    key = lambda r: (r[0], r[2], r[5])
    for a, b in zip(sorted(map(tuple, got.collect()), key=key), sorted(brute_katz(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])


def test_katz_edges(spark):
    assert katz.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][0]  # held out: nothing to learn from
    (r,) = katz.score(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).collect()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == 0.0


# ---- 7


def test_licenses(spark):
    rows = [
        (1, "x CC-BY y. Licensed under CC BY-NC 4.0. ALL rights,reserved"), (2, None), (3, "cc"), (4, "general public license general public license"),
        (5, "Permission is hereby granted, free of charge, to any person getting a copy of this software and its associated documentation files (the Software), to deal in the Software without any restriction"),
        (6, "all rights é reserved all rights reservedé"), (7, ""), (8, "z " * 4000 + "cc by"), (9, "MIT License is released under the"),
    ]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)))
    facts = {r.doc_id: r for r in out.where("label is null").collect()}
    found = defaultdict(set)
    for r in out.where("label is not null").collect():
        found[r.doc_id].add((r.label, r["first"]))
    for i, text in rows:
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        want = {(label, p) for label, ph in licenses.BASE.items() for p in range(len(w)) if w[p : p + len(ph.split())] == ph.encode().split()}
        assert {x for x in found[i] if x[0] in licenses.BASE} == want
        assert facts[i].n_words == len(w)
    assert ("mit", 0) in found[5] and ("cc-by-nc", 4) in found[1] and not found[9]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_query(spark, tmp_path):
    spark.createDataFrame([(1, "all rights reserved"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in licenses.op7_licenses(spark, str(tmp_path)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].base_labels, got[1].score) == (1, 0, "reserved", 1.0)
    assert (got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, None, "", 0.0)


def test_license_query_is_a_row_for_each_row(spark, tmp_path):
    rows = [(1, "cc by"), (1, "x CC-BY"), (1, "cc by"), (None, "cc by all rights reserved"), (None, None), (None, "cc by all rights reserved"), (2, ""), (3, "general public license " * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS template", "2 AS rows", "3 AS content").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, text in rows:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower().encode())
        at = [(label, p) for label, ph in licenses.BASE.items() for p in range(len(w)) if w[p : p + len(ph.split())] == ph.encode().split()]
        places = [p for _, p in at]
        want.append((i, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for x, _ in at}))))
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.op7_licenses(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_long_templates(spark):
    long = dict((label, t) for label, t in licenses.OWN if len(t.split()) > 100)
    r = random.Random(4)
    rows = []
    for i, (label, t) in enumerate(sorted(long.items())):
        w = t.split()
        for _ in range(6):
            w.insert(r.randrange(len(w)), "inserted")
        rows.append((i, "in the software " * 30 + " ".join(w) + " of the software" * 30))
        rows.append((100 + i, " ".join(r.sample(t.split(), len(t.split())))))
    got = defaultdict(set)
    for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("label IS NOT NULL").collect():
        got[x.doc_id].add(x.label)
    assert all(label in got[i] and not got[100 + i] for i, label in enumerate(sorted(long)))


def test_digest_is_of_joined_words():
    assert hashlib.sha256(b"a b").hexdigest() == hashlib.sha256(b" ".join(b"a \t b".split())).hexdigest()
