"""GIF, quality, nearest neighbours, SentencePiece, WARC and the pipeline, with round trips and odd rows."""

import hashlib
import io
import itertools
import os
import random
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import gif, imi, pieces, quality, warc

SF = "/root/testdata/sf0.001"


# ---- 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=900), st.integers(1, 4), st.sampled_from([1, 3, 8192]))
def test_gif_round_trip(values, rows, frame_rows):
    width = 24
    data = (bytes(values) * (rows * width))[: rows * width * 8]
    data = data[: len(data) // width * width]
    media = gif.encode(data, width, frame_rows)
    back, frames = gif.samples(media)
    assert back == data and len(frames) == -(-len(data) // width // frame_rows)


def lzw_naive(codes, least):
    bits, at, width, count = 0, 0, least + 1, 0
    for c in codes:
        bits |= c << at
        at += width
        if c == 1 << least:
            width, count = least + 1, 0
        else:
            count += 1
            if count > 1 and (1 << least) + 2 + count - 1 == 1 << width and width < 12:
                width += 1
    return bits.to_bytes((at + 7) // 8, "little")


def picture(frames, palette, size=(2, 2)):
    out = b"GIF89a" + size[0].to_bytes(2, "little") + size[1].to_bytes(2, "little") + bytes([0x80 | 1, 0, 0]) + bytes(x for c in palette for x in c)
    for x, y, w, h, index, disposal, clear, delay, interlaced, local in frames:
        out += b"\x21\xf9\4" + bytes([disposal << 2 | (clear is not None)]) + delay.to_bytes(2, "little") + bytes([clear or 0, 0])
        flags = (64 if interlaced else 0) | (0x81 if local else 0)
        out += b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, w, h)) + bytes([flags]) + bytes(v for c in local or [] for v in c)
        stream = lzw_naive([4, *index, 5], 2)
        out += bytes([2, len(stream)]) + stream + b"\0"
    return out + b"\x3b"


P = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)]


def test_gif_disposal_and_transparency():
    frames = [
        (0, 0, 2, 2, [1, 1, 1, 1], 1, None, 5, False, None),
        (0, 0, 1, 2, [2, 3], 3, 3, 7, False, None),  # index 3 is clear; restored afterwards
        (1, 1, 1, 1, [3], 2, None, 9, False, None),  # cleared afterwards
        (0, 0, 1, 1, [0], 1, None, 1, False, [(9, 9, 9)] * 4),
    ]
    got = gif.decode(picture(frames, P))
    assert [(f.start_cs, f.delay_cs) for f in got] == [(0, 5), (5, 7), (12, 9), (21, 1)]
    red, green, blue = (list((*c, 255)) for c in P[1:])
    assert got[1].rgba.tolist() == [[green, red], [red, red]]
    assert got[2].rgba.tolist() == [[red, red], [red, blue]]
    assert got[3].rgba.tolist() == [[[9, 9, 9, 255], red], [red, [0, 0, 0, 0]]]
    assert gif.histogram(got[0].rgba, 2) == [0, 4, 4, 0, 4, 0]


def test_gif_interlace_and_damage():
    index = [0, 1, 2, 3, 0, 1, 2, 3, 1]
    order = [*range(0, 9, 8), *range(4, 9, 8), *range(2, 9, 4), *range(1, 9, 2)]
    media = picture([(0, 0, 1, 9, [index[i] for i in order], 0, None, 0, True, None)], P, (1, 9))
    assert gif.decode(media)[0].rgba[:, 0, :3].tolist() == [list(P[i]) for i in index]
    for bad in (b"", b"GIF89a", media[:-8], b"JPEG" + media):
        with pytest.raises(ValueError):
            gif.decode(bad)


@pytest.mark.parametrize("n", [8000, 12_000, 30_000])
def test_gif_codes_without_a_clear_code(n):
    """A full table stays: literal codes, and codes of the table, go on at 12 bits for as long as the stream does."""
    r = random.Random(n)
    literal = [r.randrange(256) for _ in range(n)]
    stream = lzw_naive([256, *literal, 257], 8)
    assert gif.lzw_decode(stream, 8, n) == bytes(literal)
    late = [*literal, *(r.randrange(258, 4096) for _ in range(500))]
    table, before, out = [bytes([i]) for i in range(256)] + [b"", b""], None, b""
    for c in late:
        own = table[c]
        if before is not None and len(table) < 4096:
            table.append(before + own[:1])
        out, before = out + own, own
    assert gif.lzw_decode(lzw_naive([256, *late, 257], 8), 8, len(out)) == out


def test_gif_claims_no_more_than_it_holds():
    media = bytearray(picture([(0, 0, 2, 2, [1, 1, 1, 1], 1, None, 5, False, None)], P))
    media[6:10] = b"\xff\xff\xff\xff"
    with pytest.raises(ValueError, match="canvas"):
        gif.decode(bytes(media))
    frames = bytearray(picture([(0, 0, 2, 2, [1, 1, 1, 1], 1, None, 5, False, None)], P, (60000, 4000)))
    at = frames.index(b"\x2c")
    frames[at + 5 : at + 9] = (60000).to_bytes(2, "little") + (4000).to_bytes(2, "little")
    with pytest.raises(ValueError, match="early"):
        gif.decode(bytes(frames))


def test_gif_tables(spark, tmp_path):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 3000), (5, "abc"), (6, "x" * 192)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in gif.op2_gif(spark, str(tmp_path)).collect()}
    for i, t in rows:
        n, payload = gif.payload_of(t)
        assert len(payload) % 192 == 0 and payload
        assert (got[i].n_bytes, got[i].payload_sha256) == (n, hashlib.sha256(payload).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(payload[-16:])
        media, grey = gif.encode(payload), np.bincount(np.frombuffer(payload, np.uint8) // 32, minlength=8)
        assert (got[i].media_bytes, got[i].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert got[i].feature == "1:4:" + ",".join(map(str, grey))
    assert got[1].media_sha256 == got[5].media_sha256 and got[2].feature == got[3].feature and got[6].payload_bytes == 192
    stored = gif.store_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    media = stored.select(F.col("doc_id").alias("id"), "media").union(spark.createDataFrame([(7, b"bad"), (8, None)], "id long, media binary"))
    frames = gif.frames_table(media).collect()
    assert sum(f.error is not None for f in frames) == 1 and sum(f.id == 4 for f in frames) == 1
    assert sum(frames[0].red) == frames[0].width * frames[0].height


# ---- 6


def test_quality(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdef") for _ in range(5))
    rows, ratings = [], []
    for i in range(600):
        kind = r.choice([0, 1, 2])
        w = [word() for _ in range(r.randrange(20, 60))]
        if kind == 0:
            w[3] = r.choice(["badword", "nasty"])
        if kind == 1:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w)))
        ratings.append((i, kind))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = spark.createDataFrame([x for x in ratings if x[0] < 400] + [(None, 1), (5, None), (99999, 2)], "doc_id long, grade int")
    model = quality.train(docs, train, 3)
    assert (np.diff(model.thresholds) > 0).all()
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "y" * 100_000)], "doc_id long, text string")
    out = quality.score(docs.union(odd).withColumn("grade", F.lit("x")), model, 3).collect()
    assert all(1 >= x._quality.tails[0] >= x._quality.tails[1] >= 0 and x._quality.expected == pytest.approx(sum(x._quality.tails)) for x in out)
    held = [x for x in out if 400 <= x.doc_id < 600]
    right = sum((x._quality.tails[1] >= 0.5) == (ratings[x.doc_id][1] == 2) for x in held)
    assert right / len(held) > 0.95
    none = quality.train(docs, train.limit(0), 3)
    assert none is None and quality.score(docs, none, 3).where(quality.kept()).count() == 600
    assert quality.score(docs.limit(0), model, 3).count() == 0


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(2)
    n, slots = 40, 6
    row, slot, value = np.repeat(np.arange(n), 3), rng.integers(0, slots, 3 * n), rng.normal(size=3 * n)
    grades, at = rng.integers(0, 4, n), [rng.normal(size=slots), np.array([-0.7]), np.array([0.1, -0.4])]
    _, *slopes = quality.loss(row, slot, value, grades, *at, 0.01)
    for which, slope in enumerate(slopes):
        for i in range(len(slope)):
            ends = []
            for step in (1e-6, -1e-6):
                moved = [x.copy() for x in at]
                moved[which][i] += step
                ends.append(quality.loss(row, slot, value, grades, *moved, 0.01)[0])
            assert slope[i] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-6)


def test_quality_with_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "good words" if i % 2 else "bad words") for i in range(60)], "doc_id long, text string")
    odd = docs.selectExpr("*", "1 AS grade", "2 AS _grade", "3 AS _rated", "4 AS _id", "5 AS `a.b`")
    model = quality.train(odd, spark.createDataFrame([(i, 2 * (i % 2)) for i in range(60)], "doc_id long, grade int"), 3)
    out = quality.score(odd, model, 3)
    assert out.columns == [*odd.columns, "_quality"] and {r.doc_id % 2 for r in out.where(quality.kept()).collect()} == {1}


def test_features_are_the_same_for_any_slicing():
    texts = ["Ab, c d##", "", "A A A b", "é 12x"]
    whole = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(whole) + b"\0" * 8, np.uint8)
    row, slot, value = quality.features(data, np.cumsum([0, *map(len, whole)]))
    for i, t in enumerate(whole):
        _, s, v = quality.features(np.frombuffer(t + b"\0" * 8, np.uint8), np.array([0, len(t)]))
        assert s.tolist() == slot[row == i].tolist() and v == pytest.approx(value[row == i])


# ---- 8


def test_neighbours(spark, tmp_path):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    v = centers[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 16))
    v[100:400] = v[7]  # a hot vector
    rows = [(i, x.tolist(), "z") for i, x in enumerate(v)]
    rows += [(900, None, "z"), (920, [0.0] * 16, "z"), (940, [1.0] * 15 + [None], "z"), (960, [float("nan")] * 16, "z"), (980, [float("inf")] * 16, "z"), (None, [1.0] * 16, "z"), (1000, [], "z"), rows[20]]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in imi.op8_imi(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 900, 20))
    hit = total = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(f[1] != q for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        assert all(f[2] == pytest.approx(float(v[q] @ v[f[1]])) for f in found)
        scores = v @ v[q]
        best = [i for i in np.lexsort((np.arange(900), -np.round(scores, 9))) if i != q][:20]
        hit += len(set(best) & {f[1] for f in found})
        total += 20
    assert hit / total >= 0.9


def test_neighbours_of_tied_vectors(spark):
    every = [list(x) for x in itertools.product([0.0, 1.0], repeat=12) if sum(x) == 5]
    random.Random(6).shuffle(every)
    df = spark.createDataFrame(list(enumerate(every)), "vec_id long, embedding array<double>")
    got = {}
    for r in imi.search(df, df.where("vec_id < 20"), least=10_000).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    v = np.array(every)
    for q in range(20):
        best = [i for i in np.lexsort((np.arange(len(v)), -(v @ v[q]))) if i != q][:20]
        assert [i for _, i in sorted(got[q])] == best


def test_recall_by_reach(spark):
    v = np.random.default_rng(8).normal(size=(4000, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")

    def recall(**more):
        found = {(r.query_id, r.vec_id) for r in imi.search(df, df.where("vec_id % 80 = 0"), least=0, **more).collect()}
        return len(found & {(q, i) for q in range(0, 4000, 80) for i in np.argsort(-(v @ v[q]))[1:21]}) / 1000

    assert recall() >= 0.9 and recall(reach=0.03) < 0.9


def test_neighbours_of_several_lengths(spark):
    rows = [(i, [float(i % 7 - 3), 1.0, float(i % 5)][: 2 + i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in imi.search(df, df.where("vec_id % 20 = 1 OR vec_id % 20 = 0")).collect()}
    for q in (0, 1, 20, 21):
        own = [(-sum(a * b for a, b in zip(v, rows[q][1], strict=True)), i) for i, v in rows if len(v) == len(rows[q][1]) and any(v) and i != q]
        assert [got[q, k + 1] for k in range(20)] == [i for _, i in sorted(own)[:20]]


def test_reach_follows_clusters():
    rng = np.random.default_rng(5)
    centers = 4 * rng.normal(size=(40, 16))
    near, flat = centers[rng.integers(0, 40, 3000)] + 0.1 * rng.normal(size=(3000, 16)), rng.normal(size=(3000, 16))
    reach = []
    for v in (near, flat):
        c1, c2 = imi.fit(v[:, :8], 16), imi.fit(v[:, 8:], 16, 8)
        cells = imi.nearest(v[:, :8], c1) * 16 + imi.nearest(v[:, 8:], c2)
        reach.append(imi.probe(v, c1, c2, np.bincount(cells, minlength=256), 20, 0.95))
    assert reach[0] < 0.2 < reach[1] <= 1


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in imi.search(df, df.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert imi.search(df.limit(0), df.limit(0)).count() == 0


def test_traverse_is_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=8), rng.normal(size=8)
    cells = imi.traverse(a, b, np.ones(64, np.int64), 64)
    sums = [a[c // 8] + b[c % 8] for c in cells]
    assert len(set(cells)) == 64 and sums == sorted(sums, reverse=True)


# ---- 9

LIB = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return LIB.SentencePieceProcessor(model_file=pieces.default_path())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["a", "the", "  ", " ", "\n", "▁", "é", "日", "\0", "😀", "aaaa", "    ", "</s>", "<0x0A>", "ing"]), max_size=30).map("".join))
def test_pieces_against_the_library(library, text):
    text = text.encode("utf-8", "ignore").decode()
    own = pieces.model(pieces.default_path())
    ids = library.encode(text, add_bos=True, add_eos=True)
    raw = np.array([1], "<u4").tobytes() + own.encode(text) + np.array([2], "<u4").tobytes()
    assert np.frombuffer(raw, "<u4").tolist() == ids
    assert own.decoded(raw).decode() == own.decode(ids) == library.decode(ids)


def test_pieces_table(spark, library, tmp_path):
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (4, "x" * 20_000), (5, "ab " * 9000), (1, "Hello  world\n")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(0)).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, pieces.op9_sentencepiece(spark, str(tmp_path)).collect()))
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    checked = pieces.encode_texts(spark.createDataFrame(rows, "doc_id long, text string"), check=True).collect()
    assert all(r.lossless and r.n_tokens == len(r.ids) for r in checked)


# ---- 10


@pytest.mark.parametrize("zip64", [False, True])
def test_archives(spark, tmp_path, zip64):
    page = "<html>" + "é" * 60
    rows = [(5, "http://a/", page), (2, "http://b c/", page), (9, None, page), (1, "u", "short"), (3, "u", "short"), (4, "u", None), (6, "u", ""), (None, "u", "x\r\n\r\ny" * 400), (7, "u", "z" * 200_000), (8, "u", page + " ")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    archives = warc.write_archives(df, str(tmp_path / "w"), archive_bytes=2000, zip64=zip64)
    got = {r.page_id: r for r in warc.read_archives(archives).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 2) if i in (5, 9) else ("response", None))
        assert i in (5, 9) or got[i].payload == raw
    for name in os.listdir(tmp_path / "w"):
        if name.endswith(".wacz"):
            with zipfile.ZipFile(tmp_path / "w" / name) as z:
                assert z.testzip() is None and z.namelist() == [warc.MEMBER, warc.INDEX]


def test_archives_of_nothing_and_damage(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none, str(tmp_path / "w"))).count() == 0

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    with pytest.raises(ValueError):
        warc.ZipReader(File(b"no archive" * 9))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "b" * 100)
    with pytest.raises(ValueError):
        warc.ZipReader(File(packed.getvalue()))


# ---- pipeline


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        if name in ("quality", "near_copies"):
            assert 0 < out.count() < before
            before = out.count()
        if name == "passages":
            assert out.count() == before and out.where("n_chars <> length(text)").count() == 0
        docs = out
    assert docs.where("NOT lossless").count() == 0 and docs.count() > 0


ODD = ("grade", "size", "times", "target", "rank", "label", "block", "node", "a.b", "_row", "pid", "_dedup", "_quality", "taken", "key", "keys", "first", "weight", "start", "_c0", "_text", "_id", "h")


def odd_documents(spark, extra=()):
    r = random.Random(8)
    word = lambda: "w" + str(r.randrange(5000))
    long, shared = " ".join(word() for _ in range(30_000)), " ".join(word() for _ in range(40))
    copy = " ".join(word() for _ in range(50))
    rows = [(1, copy, "s1"), (1, copy, "s1"), (2, copy, "s2"), (None, copy + " x", None), (None, copy + " x", None), (1, copy + " y", "s1"), (3, None, "s1"), (4, "", None), (None, None, None), (5, "one", "s3")]
    rows += [(10, f"before {shared} after", "s1"), (11, f"other words then {shared} and more{' more' * 12}", "s2"), (12, long, "s1"), (None, " ".join(word() for _ in range(20)), "s3")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in extra:
        docs = docs.withColumn(c, F.concat(F.lit("z"), F.coalesce(F.length("text"), F.lit(0)).cast("string")))
    return docs


@pytest.mark.parametrize("extra", [(), ODD])
def test_stages_on_odd_rows(spark, tmp_path, extra):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, stages = odd_documents(spark, extra), dict(corpus_pipeline.STAGES)
    key = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.text or "", str(r.source)) for r in rows)
    every = docs.collect()
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, str(tmp_path))
        rows = out.collect()
        assert out.columns == docs.columns
        assert stages[name](spark, docs.limit(0), str(tmp_path)).count() == 0
        for c in extra:  # other columns still belong to their row
            if name != "passages":
                assert all(r[c] == f"z{len(r.text or '')}" for r in rows)
        if name == "quality":
            assert key(rows) == key(every)
        elif name == "near_copies":
            assert len(rows) == len(every) - 5 and sum((r.text or "").count(" ") in (49, 50) for r in rows) == 1
            assert [r.doc_id for r in rows if (r.text or "").startswith(every[0].text)] == [1]
        elif name == "passages":
            assert len(rows) == len(every) and next(r.text for r in rows if r.doc_id == 11) == "other words then and more" + " more" * 12
            assert all(r.n_chars == len(r.text or "") for r in rows)
        else:
            assert {r.text for r in rows} <= {r.text for r in every} and all(r.text for r in rows)
    ids = stages["encoding"](spark, docs, str(tmp_path))
    assert ids.count() == len(every) and ids.where("n_tokens < 2").count() == 0


def test_queries_on_odd_rows(spark, tmp_path):
    """Every query of documents gives a row for each row, with columns of clashing names, and no rows for an empty table."""
    from strandline.llm import catalog

    for sub, odd in (("full", odd_documents(spark, ODD)), ("empty", odd_documents(spark).limit(0))):
        odd.write.parquet(str(tmp_path / sub / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / sub / "labels.parquet"))
        for name, query in catalog.queries().items():
            if name not in ("op8_imi", "op10_warc", "pipeline"):
                assert query(spark, str(tmp_path / sub)).count() == odd.count(), name
