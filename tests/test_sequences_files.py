"""Alignment, repeats, normalisation, metadata, files and streams."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from strandline.operators import metadata, norm
from strandline.operators.align import Scoring, align
from strandline.operators.repeats import Filter, optimize, optimize_repeats, predict, predict_repeats, to_bed12, valid
from strandline.sources import bam, bed, fasta, gff, samplesheets
from strandline.streaming import sessions


@pytest.mark.parametrize("a,b,start,score,rle", [
    ("AAGAA", "AGA", (1, 0), 3, "3="), ("AAAGGGAGGGTTTA", "GGGGGGG", (3, 0), 4, "3=1X3="), ("A" * 16 + "*" * 9 + "A" * 16, "A" * 32, (0, 0), 19, "16=9v16=")])
def test_best_alignment(a, b, start, score, rle):
    found = align(a, b)[0]
    assert ((found.start1, found.start2), found.score, found.rle) == (start, score, rle)
    turned = align(b, a)[0]
    assert turned.score == score and turned.rle.replace("^", "v") == rle


def test_no_alignment():
    assert align("", "A") == [] and align("AAAA", "GGGG") == []


def brute_score(a, b, s=Scoring()):
    n, m, low = len(a), len(b), -(10**6)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    e = [[low] * (m + 1) for _ in range(n + 1)]
    f = [[low] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i][j] = max(h[i][j - 1] + s.gap_open, e[i][j - 1] + s.gap_extend)
            f[i][j] = max(h[i - 1][j] + s.gap_open, f[i - 1][j] + s.gap_extend)
            h[i][j] = max(0, h[i - 1][j - 1] + (s.equal if a[i - 1] == b[j - 1] else s.different), e[i][j], f[i][j])
    return max(map(max, h))


def test_scores_against_brute_force():
    import random

    r = random.Random(3)
    s = Scoring(2, -2, -3, -1)
    for _ in range(60):
        a, b = ("".join(r.choice("ACG") for _ in range(r.randrange(1, 18))) for _ in range(2))
        want, found = brute_score(a, b, s), align(a, b, s)
        assert (found[0].score if found else 0) == want


def test_repeats(spark):
    found = predict("AAUU")
    assert sorted(s for s, _ in found) == [1, 1, 2]
    best = max(predict("AANNUU"))
    assert best == (2, [(0, 2, 4, 6)])
    assert predict("AANNUU", Filter(min_score=3)) == []
    df = spark.createDataFrame([(1, "AANNUU"), (2, None)], "seqid long, seq string")
    rows = predict_repeats(df, keep=Filter(min_score=2))
    assert rows.count() == 1 and rows.select(valid().alias("v")).first().v
    line = bed.bed_lines(to_bed12(rows), 12).first().value.split("\t")
    assert line[1:3] == ["0", "6"] and line[9:] == ["2", "2,2", "0,4"]
    assert optimize_repeats(rows).first().total == 2.0


def test_optimize():
    arm = lambda a, b, n=2: [(a, a + n, b, b + n)]
    reps = [arm(0, 20), arm(4, 12), arm(5, 13), arm(30, 40), arm(34, 37)]
    assert optimize(reps, [1, 1, 3, 2, 2]) == ([0, 2, 3, 4], 8.0)
    assert optimize([], []) == ([], 0.0) and optimize([arm(0, 5)], [0]) == ([], 0.0)


def test_norm(spark):
    values = [("a", "x", 10.0), ("a", "y", 20.0), ("b", "x", 5.0), ("b", "y", 10.0), ("c", "x", 0.0), ("c", "y", 7.0)]
    df = spark.createDataFrame(values, "region string, sample string, value double")
    _, _, f = norm.scaling_factors(df)
    got = {r["sample"]: r.factor for r in f.collect()}
    assert got["y"] / got["x"] == pytest.approx(2.0)
    assert {r["sample"] for r in norm.rename(df, {"x": "z"}).collect()} == {"z", "y"}


def test_bed(spark, tmp_path):
    good = "c1\t10\t30\tn\t5\t-\t10\t30\t0\t2\t5,5,\t0,15,\nc2\t0\t5\tm\t0\t.\t0\t5\t1,2,3\t1\t5\t0\n"
    (tmp_path / "x.bed").write_text(good)
    rows = bed.read_bed(spark, str(tmp_path / "x.bed"), 12)
    first = rows.orderBy("seqid").first()
    assert first.orientation == -1 and [tuple(b) for b in first.blocks] == [(0, 5), (15, 20)] and tuple(first.rgb) == (0, 0, 0)
    bed.write_bed(rows, str(tmp_path / "out"), 12, "gzip")
    assert sorted(map(str, bed.read_bed(spark, str(tmp_path / "out"), 12).collect())) == sorted(map(str, rows.collect()))
    (tmp_path / "x.bed.bgz").write_bytes(gzip.compress(good[:30].encode()) + gzip.compress(good[30:].encode()))
    assert sorted(map(str, bed.read_bed(spark, str(tmp_path / "x.bed.bgz"), 12).collect())) == sorted(map(str, rows.collect()))
    for bad in ("c\t5\t5\n", "c\t5\n", "c d\t1\t5\n"):
        (tmp_path / "bad.bed").write_text(bad)
        with pytest.raises(Exception):
            bed.read_bed(spark, str(tmp_path / "bad.bed"), 3).collect()


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text("> a b\nACGT\r\nAC\n\n>z\nTTTT\n")
    rows = fasta.read_fasta(spark, str(tmp_path / "x.fa"))
    assert {(r.id, r.seq) for r in rows.collect()} == {(" a b", "ACGTAC"), ("z", "TTTT")}
    fasta.write_fasta(rows.where("id = 'z'"), str(tmp_path / "out"), 3)
    assert fasta.read_fasta(spark, str(tmp_path / "out")).first().seq == "TTTT"
    (tmp_path / "i.fa").write_text(">s\nACGTA\nCGTAC\nGT\n")
    (tmp_path / "i.fa.fai").write_text("s\t12\t3\t5\t6\n")
    q = spark.createDataFrame([("s", 3, 11), ("s", 0, 12)], "seqid string, start long, end long")
    index = fasta.read_fai(spark, str(tmp_path / "i.fa.fai"))
    assert {r.seq for r in fasta.fetch(q, index, str(tmp_path / "i.fa")).collect()} == {"TACGTACG", "ACGTACGTACGT"}
    table = spark.createDataFrame([("s", "ACGTACGTACGT")], "id string, seq string")
    assert {r.seq for r in fasta.fetch_from(q, table, 5).collect()} == {"TACGTACG", "ACGTACGTACGT"}
    with pytest.raises(Exception):
        fasta.fetch(spark.createDataFrame([("s", 3, 13)], q.schema), index, str(tmp_path / "i.fa")).collect()


def test_gff(spark, tmp_path):
    (tmp_path / "x.gff").write_text("##gff\nc\tsrc\tgene\t11\t20\t.\t+\t.\tID=g1;Name=n;\nc\tsrc\texon\t11\t15\t.\t+\t.\tID=e1;Parent=g1\nc\tskip\texon\t11\t15\t.\t+\t.\tID=e2\n")
    rows = gff.read_gff(spark, str(tmp_path / "x.gff"), ignore_sources=("skip",))
    assert rows.count() == 2 and rows.where("type = 'gene'").first().start == 10
    assert {(r.type, r.id) for r in gff.by_id(rows).collect()} == {("gene", "g1"), ("exon", "e1")}


def bam_record(name, flags, ref, pos, mapq, cigar, seq, quals, nh):
    codes = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for o, n in cigar)
    four = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(four[::2], four[1::2], strict=True))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flags, len(seq), -1, -1, 0) + name.encode() + b"\0" + codes + packed + bytes(quals) + b"NHC" + bytes([nh]) + b"XYZab\0" + b"HIi" + struct.pack("<i", 1)
    return struct.pack("<i", len(body)) + body


def bam_header(*contigs):
    raw = b"BAM\1" + struct.pack("<ii", 0, len(contigs))
    for name, n in contigs:
        raw += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    return raw


def blocked(raw, size):
    """A blocked gzip file with an empty block at its end, and where its blocks begin, in the file and in the content."""
    out, starts = b"", []
    for at in [*range(0, len(raw), size), len(raw)]:
        starts.append((len(out), at))
        out += gzip.compress(raw[at : at + size])
    return out, starts


def test_bam(spark, tmp_path):
    raw = bam_header(("c1", 1000)) + bam_record("r1", 99, 0, 5, 255, [("M", 3), ("I", 2)], "ACGTN", [1, 2, 3, 4, 5], 2)
    (tmp_path / "x.bam").write_bytes(gzip.compress(raw[:40]) + gzip.compress(raw[40:]))
    row = bam.read_bam(spark, str(tmp_path / "x.bam")).first()
    assert (row.qname, row.contig, row.start, row.mapq, row.seq, row.nh, row.hi) == ("r1", "c1", 5, None, "ACGTN", 2, 1)
    assert [tuple(c) for c in row.cigar] == [("M", 3), ("I", 2)] and row.quals == [1, 2, 3, 4, 5]
    (tmp_path / "cut.bam").write_bytes((tmp_path / "x.bam").read_bytes()[:-9])
    with pytest.raises(Exception, match="ends inside a block"):
        bam.read_bam(spark, str(tmp_path / "cut.bam")).collect()


def indexed_bam(path, seed=3, n=400):
    """A sorted file of two contigs and of unplaced reads, with its index; the reads as (name, flags, contig, start, stop, mapq)."""
    rng = random.Random(seed)
    lengths = [200_000, 60_000]
    placed = sorted((rng.randrange(2), rng.choice([0, 16, 256, 1024]), rng.choice([0, 20, 255])) for _ in range(n))
    starts = sorted((ref, rng.choice([rng.randrange(lengths[ref] - 30_000), 16_384, 16_383])) for ref, _, _ in placed)
    raw, reads, spans = bam_header(("c1", lengths[0]), ("c2", lengths[1]), ("c3", 10)), [], []
    for i, ((ref, start), (_, flags, mapq)) in enumerate(zip(starts, placed, strict=True)):
        cigar = [("S", 2), ("M", 3), ("N", rng.choice([1, 40, 20_000])), ("M", 4)]
        stop = start + sum(k for op, k in cigar if op in "MN")
        record = bam_record(f"r{i}", flags, ref, start, mapq, cigar, "ACGTNACGT", [9] * 9, 1)
        spans.append((ref, start, stop, len(raw), len(raw) + len(record)))
        reads.append((f"r{i}", flags, f"c{ref + 1}", start, stop, mapq))
        raw += record
    for i in range(5):
        raw += bam_record(f"u{i}", 4, -1, -1, 0, [], "AC", [1, 1], 1)
        reads.append((f"u{i}", 4, None, -1, -1, 0))
    data, blocks = blocked(raw, 997)
    path.write_bytes(data)

    def virtual(at):
        place, begin = max(b for b in blocks if b[1] <= at and (b[1] < len(raw) or at == len(raw)))
        return place << 16 | at - begin

    index = b"BAI\1" + struct.pack("<i", 3)
    for ref in range(3):
        bins, linear = {}, {}
        for r, start, stop, a, b in spans:
            if r == ref:
                level = next((first, s) for first, s in reversed(bam.LEVELS) if start >> s == stop - 1 >> s)
                chunks = bins.setdefault(level[0] + (start >> level[1]), [])
                if chunks and chunks[-1][1] == virtual(a):
                    chunks[-1][1] = virtual(b)
                else:
                    chunks.append([virtual(a), virtual(b)])
                for w in range(start >> 14, (stop - 1 >> 14) + 1):
                    linear.setdefault(w, virtual(a))
        bins[bam.STATISTICS] = [[0, 1 << 62], [5, 7]]
        index += struct.pack("<i", len(bins)) + b"".join(struct.pack("<Ii", k, len(c)) + b"".join(struct.pack("<QQ", *x) for x in c) for k, c in bins.items())
        windows = [linear.get(w, 0) for w in range(max(linear, default=-1) + 1)]
        index += struct.pack("<i", len(windows)) + b"".join(struct.pack("<Q", w) for w in windows)
    path.with_name(path.name + ".bai").write_bytes(index)
    return reads, index


def test_indexed_bam(spark, tmp_path):
    path = tmp_path / "x.bam"
    reads, index = indexed_bam(path)
    names = ["c1", "c2", "c3"]

    def got(ranges, regions=None, **filters):
        with open(path, "rb") as file:
            return sorted(r[0] for a, b in ranges for r in bam.records(file, a, b, regions, **filters))

    parsed = bam.read_index(index)
    for size in (1, 2000, 1 << 30):
        assert got(bam.ranges_of(parsed, names, None, size)) == sorted(r[0] for r in reads)
    rng = random.Random(5)
    asked = [("c1", 0, 200_000), ("c1", 16_383, 16_384), ("c1", 16_384, 16_385), ("c2", 0, 1 << 30), ("c3", 0, 10), ("c2", 59_999, 60_000)]
    for _ in range(60):
        start = rng.randrange(190_000)
        asked.append((rng.choice(names[:2]), start, start + rng.choice([1, 100, 20_000])))
    for k, some in enumerate([*([a] for a in asked), asked[6:9], asked[:2] + asked[9:20]]):
        regions = bam.Regions(some)
        expected = sorted(r[0] for r in reads if not r[1] & 4 and any(r[2] == c and r[3] < e and r[4] > s for c, s, e in some))
        ranges = bam.ranges_of(parsed, names, regions, (1, 500, 1 << 30)[k % 3])
        assert got(ranges, regions) == expected == got([(None, None)], regions)
        assert all(b <= c for (_, b), (c, _) in zip(ranges, ranges[1:], strict=False))
    near = bam.ranges_of(parsed, names, bam.Regions([("c2", 100, 200)]), 1 << 30)
    assert sum((b >> 16) - (a >> 16) for a, b in near) < path.stat().st_size / 2
    for lone in (False, True):  # with the index, and without
        if lone:
            (tmp_path / "x.bam.bai").unlink()
        rows = bam.read_bam(spark, str(path), range_bytes=2000)
        assert sorted(r.qname for r in rows.collect()) == sorted(r[0] for r in reads)
        assert (rows.selectExpr("spark_partition_id() p").distinct().count() > 1) is not lone
        rows = bam.read_bam(spark, str(path), regions=[("c1", 20_000, 50_000), ("c2", 5, 900)], exflags=1024, min_mapq=20)
        kept = [r for r in reads if not r[1] & 1028 and r[5] >= 20 and (r[2] == "c1" and r[3] < 50_000 and r[4] > 20_000 or r[2] == "c2" and r[3] < 900 and r[4] > 5)]
        assert sorted((r.qname, r.flags, r.contig, r.start) for r in rows.collect()) == sorted(r[:4] for r in kept) and kept
    with pytest.raises(Exception, match="no contig c9"):
        bam.read_bam(spark, str(path), regions=[("c9", 0, 5)]).collect()


def test_fetch_from_blocked_gzip(spark, tmp_path):
    rng = random.Random(1)
    seqs = {"a": "".join(rng.choices("ACGT", k=505)), "b": "".join(rng.choices("ACGT", k=30))}
    text, fai = "", ""
    for name, seq in seqs.items():
        text += f">{name}\n"
        fai += f"{name}\t{len(seq)}\t{len(text)}\t10\t11\n"
        text += "".join(seq[i : i + 10] + "\n" for i in range(0, len(seq), 10))
    data, starts = blocked(text.encode(), 64)
    (tmp_path / "x.fa.gz").write_bytes(data)
    (tmp_path / "x.fai").write_text(fai)
    index = fasta.read_fai(spark, str(tmp_path / "x.fai"))
    asked = [("a", 0, 505), ("b", 29, 30), ("a", 63, 64), *(("a", s, s + rng.randrange(1, 200)) for s in rng.sample(range(300), 20))]
    queries = spark.createDataFrame(asked, "seqid string, start long, end long")
    with pytest.raises(Exception, match="no .gzi index"):
        fasta.fetch(queries, index, str(tmp_path / "x.fa.gz")).collect()
    (tmp_path / "x.fa.gz.gzi").write_bytes(struct.pack("<Q", len(starts) - 1) + b"".join(struct.pack("<QQ", *s) for s in starts[1:]))
    rows = fasta.fetch(queries, index, str(tmp_path / "x.fa.gz")).collect()
    assert len(rows) == len(asked) and all(r.seq == seqs[r.seqid][r.start : r.end] for r in rows)


def sheet(tmp_path, extra=""):
    cols = [*samplesheets.REQUIRED, "fastq_2", "sample_description"]
    rows = []
    for i, lay in enumerate(["PAIRED", "SINGLE"]):
        v = dict.fromkeys(cols, "v") | {"study_accession": "P1", "sample_accession": f"S{i}", "experiment_accession": f"E{i}", "experiment_title": f"title{i}", "run_accession": f"R{i}", "library_layout": lay, "read_count": "5", "base_count": "50", "fastq_1": f"x/a{i}_1.fq.gz", "fastq_2": f"x/a{i}_2.fq.gz" if lay == "PAIRED" else "", "sample_description": ""}
        rows.append(",".join(v[c] for c in cols))
    (tmp_path / "s.csv").write_text("\n".join([",".join(cols), *rows]) + extra + "\n")
    return str(tmp_path / "s.csv")


def test_projects(spark, tmp_path):
    (project,) = samplesheets.load_samplesheet(spark, sheet(tmp_path), fastq_root="/data")
    assert project.runs.where("ind = 'R0'").first().file2 == "/data/a0_2.fq.gz"
    assert metadata.problems(project).count() == 0
    assert {r.layout for r in metadata.layouts(project).collect()} == {"PE", "SE"}
    kept = metadata.Filters().with_layout("PE")(project)
    assert kept.samples.count() == kept.runs.count() == 1
    assert {(r["sample"], r.strandedness) for r in samplesheets.design(project).collect()} == {("E0+title0", "auto"), ("E1+title1", "auto")}
    assert samplesheets.results(project, "/r").where("experiment = 'E0'").first().inflags == 1
    again = samplesheets.loads(spark, samplesheets.dump(project))
    assert again.runs.count() == 2 and metadata.problems(again).count() == 0
    bad = metadata.Project("P1", project.samples.limit(0), project.libraries, project.experiments, project.runs)
    assert {r.problem for r in metadata.problems(bad).collect()} == {"unknown sample"}
    with pytest.raises(Exception):
        spark.range(1).select(samplesheets.descriptor(F.lit("a"), F.lit("x/y"))).collect()


def test_registry_and_transcripts(spark):
    refs = spark.createDataFrame([("chr1", ["1", "one"]), ("chr2", ["2"])], "name string, aliases array<string>")
    q = spark.createDataFrame([("1",), ("chr2",), ("x",)], "name string")
    assert {r["name"]: r.reference for r in metadata.resolve(q, refs).collect()} == {"1": "chr1", "chr2": "chr2", "x": None}
    assert metadata.get(refs, "1").count() == 0
    assert metadata.merge_registries(refs.where("name = 'chr1'"), refs.where("name = 'chr2'")).count() == 2
    with pytest.raises(Exception):
        metadata.merge_registries(refs, refs).collect()
    genes = spark.createDataFrame([("g", ["t1"]), ("h", [])], "ind string, transcripts array<string>")
    rnas = spark.createDataFrame([("t1", "g"), ("t2", "q"), ("t3", "h")], "ind string, gene string")
    assert {(r.problem, r.ind) for r in metadata.transcriptome_problems(genes, rnas).collect()} == {("unknown gene", "t2"), ("transcripts differ", "h")}


def test_sessions(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{s:02d}", "k") for s in (0, 3, 20)] + [("2024-01-01 01:00:00", "z")]
    spark.createDataFrame(rows, "t string, k string").select(F.to_timestamp("t").alias("t"), "k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "in"))
    q = sessions(stream, "t", "10 seconds", ["k"], "1 minute").writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("sess").where("k = 'k'").collect()) == [1, 2]


def test_assemblies(spark):
    ann = lambda *rows: spark.createDataFrame(list(rows), "assembly string, key string, kind string, path string")
    merged = metadata.merge_annotations(ann(("a", "genes", "gff", "x")), ann(("a", "genes", "gff", "y"), ("b", "genes", "gff", "z"))).collect()
    assert {(r.assembly, r["key"], tuple(r.paths)) for r in merged} == {("a", "genes", ("x", "y")), ("b", "genes", ("z",))}
    with pytest.raises(Exception):
        metadata.merge_annotations(ann(("a", "genes", "gff", "x"), ("a", "genes", "bed", "y"))).collect()
    seqs = spark.createDataFrame([("a", "f1"), ("a", "f2")], "assembly string, path string")
    orgs = spark.createDataFrame([("a", "h"), ("a", "m")], "assembly string, organism string")
    assert tuple(metadata.merge_assemblies([seqs], [orgs, orgs]).first().organisms) == ("h", "m")
    with pytest.raises(Exception):
        metadata.merge_assemblies([seqs.limit(0)], [orgs]).collect()


def test_mates_stream(spark, tmp_path):
    from strandline.streaming import mates

    schema = "qname string, hi int, t timestamp"
    for side, rows in (("a", [("x", 1, 0), ("y", 1, 0)]), ("b", [("x", 1, 5), ("y", 2, 5)])):
        spark.createDataFrame([(q, h, f"2024-01-01 00:00:0{s}") for q, h, s in rows], "qname string, hi int, t string").select("qname", "hi", F.to_timestamp("t").alias("t")).write.parquet(str(tmp_path / side))
    first, second = (spark.readStream.schema(schema).parquet(str(tmp_path / x)) for x in "ab")
    q = mates(first, second, "t", "1 minute").select("a.qname").writeStream.format("memory").queryName("mates").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.qname for r in spark.table("mates").collect()] == ["x"]


def test_ties_of_alignment():
    """Of equal scores gaps of the first sequence go before gaps of the second, and longer gaps before new ones."""
    from strandline.operators.align import Scoring, align

    (found,) = align("CAGGGGCACCGAGCGACGCGAACGAGGC", "ACAGCCCACGCAGACAGCAG", Scoring(2, -3, -2, -1))
    assert found.rle == "2=2v3=2^1v4=1^2=1v1=1v2="


def test_symbol_tables_and_steps():
    from strandline.operators import align as al

    table = al.Scoring(table=(("A", "N", 1), ("C", "C", 3)))
    assert (table.gain("A", "N"), table.gain("N", "A"), table.gain("C", "C"), table.gain("G", "G")) == (1, -2, 3, 1)
    (found,) = al.align("GACG", "GNCG", table)
    assert (found.score, found.rle) == (6, "1=1X2=")
    assert table.compose(-3, -2).gap_open == -3 and table.compose(-3, -2).gain("A", "N") == 1
    (blurred,) = al.align("GACG", "GNCG", table, tell=False)
    assert blurred.rle == "4~" and al.disambiguate(blurred, "GACG", "GNCG", table) == found
    other = al.Found(1, (("=", 1),), 2, 3, 2, 3)
    assert found.intersects(other) and other.intersects(found)
    assert not found.intersects(al.Found(1, (("=", 1),), 2, 3, 1, 2)) and not found.intersects(al.Found(1, (("=", 1),), 9, 10, 2, 3))


def test_arms_of_repeats(spark):
    from pyspark.sql import functions as F

    from strandline.operators import repeats as rp

    arms = [dict(left_start=2, left_end=5, right_start=20, right_end=23), dict(left_start=6, left_end=8, right_start=15, right_end=17)]
    df = spark.createDataFrame([(arms,)], f"segments {rp.SEGMENTS}")
    one = F.col("segments")[0]
    r = df.select(rp.sequence_length().alias("n"), rp.left_bounds().alias("l"), rp.right_bounds().alias("r"), rp.sequence_ranges().alias("s"), rp.segment_length(one).alias("k"), rp.segment_gap(one).alias("g"), rp.segment_bounds(one).alias("b")).first()
    assert (r.n, tuple(r.l), tuple(r.r), r.k, r.g, tuple(r.b)) == (10, (2, 8), (15, 23), 3, 15, (2, 23))
    assert [tuple(x) for x in r.s] == [(2, 5), (6, 8), (15, 17), (20, 23)]


def test_values_by_orientation(spark):
    from pyspark.sql import functions as F

    from strandline.functions.intervals import PerOrientation

    df = spark.createDataFrame([(1,), (-1,), (0,), (None,)], "o int")
    three = PerOrientation(F.lit(10), F.lit(20), F.lit(30)).map(lambda c: c + 1).replaced(-1, F.lit(5))
    two = PerOrientation.with_default(F.lit(7), strands=True)
    got = [tuple(r) for r in df.select("o", three.at(F.col("o")), two.at(F.col("o"))).collect()]
    assert sorted(got, key=repr) == sorted([(1, 11, 7), (-1, 5, 7), (0, 31, None), (None, None, None)], key=repr)


def test_files_of_a_run(tmp_path):
    from strandline.operators.metadata import storage_exists

    (tmp_path / "a").write_text("x")
    there, gone = str(tmp_path / "a"), str(tmp_path / "b")
    cases = [(there, None, True), (there, there, True), (there, gone, False), (gone, None, False), (None, None, False)]
    assert all(storage_exists({"file1": a, "file2": b}) is want for a, b, want in cases)
