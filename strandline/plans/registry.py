"""Registered queries of the engine over the derived interval tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..operators import align, counting, joins, mapping, metadata, norm, peaks, pileup, reads, repeats, segments, setops, sums, tracks
from ..sources import bed, fasta
from . import views

R, E = f"r AS ({views.sql(views.READS)})", f"e AS ({views.sql(views.ELEMENTS)})"
WIDTH = 128
KEYS = ["contig", "orientation"]
SPARK, SQL = {}, {}


def query(name, sql=None):
    def add(f):
        SPARK[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def queries():
    return dict(SPARK)


def oracle_sql():
    return dict(SQL)


def _both(spark, d):
    return views.reads(spark, d), views.elements(spark, d)


MEET = 'r.contig = e.contig AND r.orientation = e.orientation AND r.start < e."end" AND e.start < r."end"'
ROUND = 6

# ---- joins


@query("overlap_join", f"WITH {R}, {E} SELECT aln_id, source, element, r.start, r.\"end\", e.start AS start_r, e.\"end\" AS end_r FROM r JOIN e ON {MEET}")
def _(spark, d):
    r, e = views.reads(spark, d), views.elements(spark, d, by_place=True)
    return joins.overlap_join(r, e, KEYS, "inner", WIDTH).select("aln_id", "source", F.col("element_r").alias("element"), "start", "end", "start_r", "end_r")


@query("overlap_left", f"WITH {R}, {E} SELECT element, aln_id FROM e LEFT JOIN r ON {MEET}")
def _(spark, d):
    r, e = views.reads(spark, d), views.elements(spark, d, by_place=True)
    return joins.overlap_join(e, r, KEYS, "left", WIDTH).select("element", F.col("aln_id_r").alias("aln_id"))


@query("overlap_semi", f"WITH {R}, {E} SELECT aln_id, source FROM r WHERE EXISTS (SELECT 1 FROM e WHERE {MEET})")
def _(spark, d):
    r, e = _both(spark, d)
    return joins.overlap_join(r, e, KEYS, "semi", WIDTH).select("aln_id", "source")


@query("overlap_anti", f"WITH {R}, {E} SELECT aln_id, source FROM r WHERE NOT EXISTS (SELECT 1 FROM e WHERE {MEET})")
def _(spark, d):
    r, e = _both(spark, d)
    return joins.overlap_join(r, e, KEYS, "anti", WIDTH).select("aln_id", "source")


@query("overlap_left_counts", f"WITH {R}, {E} SELECT element, count(aln_id) AS n_hits FROM e LEFT JOIN r ON {MEET} GROUP BY element")
def _(spark, d):
    r, e = _both(spark, d)
    return sums.count_hits(e, r, "element", KEYS, WIDTH)


# ---- sets of intervals

_ISLANDS = """{src}, i1 AS (SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM {t}),
 i2 AS (SELECT *, sum(CASE WHEN prev IS NULL OR start > prev + {d} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS isl FROM i1),
 m AS (SELECT {keys}, min(start) AS start, max("end") AS "end", count(*) AS n_merged FROM i2 GROUP BY {keys}, isl)"""


def islands(t, keys="contig, orientation", d=0, src=None):
    return _ISLANDS.format(src=src or (R if t == "r" else E), keys=keys, t=t, d=d)


@query("interval_merge", f'WITH {islands("e")} SELECT contig, orientation, start, "end", n_merged FROM m')
def _(spark, d):
    return setops.merge(views.elements(spark, d), KEYS, counts=True)


@query("interval_merge_within", f'WITH {islands("e", d=7)} SELECT contig, orientation, start, "end", n_merged FROM m')
def _(spark, d):
    return setops.merge_within(views.elements(spark, d), 7, KEYS, counts=True)


@query("interval_group_within", f'WITH {islands("e", d=7)} SELECT element, m.start AS group_start FROM e JOIN m ON e.contig = m.contig AND e.orientation = m.orientation AND e.start < m."end" AND m.start < e."end"')
def _(spark, d):
    return setops.group_within(views.elements(spark, d), 7, KEYS, WIDTH).select("element", "group_start")


@query("interval_overlap", f'WITH {R}, {E} SELECT r.contig, r.orientation, greatest(r.start, e.start) AS start, least(r."end", e."end") AS "end" FROM r JOIN e ON {MEET}')
def _(spark, d):
    return setops.overlap(views.reads(spark, d, by_place=True), views.elements(spark, d, by_place=True), KEYS, WIDTH, cut=_written)


@query("interval_overlaps", f"WITH {R}, {E} SELECT aln_id, EXISTS (SELECT 1 FROM e WHERE {MEET}) AS overlaps FROM r")
def _(spark, d):
    return setops.overlaps(*_both(spark, d), KEYS, WIDTH).select("aln_id", "overlaps")


@query("interval_subtract", f"""WITH {R}, {islands("e")},
 h AS (SELECT r.aln_id, r.start AS s, r."end" AS e, m.start AS hs, m."end" AS he FROM r JOIN m ON r.contig = m.contig AND r.orientation = m.orientation AND r.start < m."end" AND m.start < r."end"
       UNION ALL SELECT aln_id, start, "end", "end", "end" FROM r),
 g AS (SELECT aln_id, coalesce(max(he) OVER (PARTITION BY aln_id ORDER BY hs, he ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s) AS start, hs AS "end" FROM h)
 SELECT aln_id, start, "end" FROM g WHERE start < "end" """)  # fmt: skip
def _(spark, d):
    return setops.subtract(*_both(spark, d), KEYS, WIDTH).select("aln_id", "start", "end")


@query("task_split", f"""WITH RECURSIVE {islands("e", keys="contig")}, c1 AS (SELECT contig, unnest(range(start, "end", 100)) AS start, "end" AS last FROM m),
 c AS (SELECT contig, start, least(start + 100, last) AS "end" FROM c1),
 x AS (SELECT a.contig, a.start, min(b.start) AS follows FROM c a JOIN c b ON a.contig = b.contig AND b."end" > a.start + 100 GROUP BY 1, 2),
 t AS (SELECT contig, min(start) AS task_start FROM c GROUP BY contig UNION ALL SELECT x.contig, x.follows FROM t JOIN x ON t.contig = x.contig AND t.task_start = x.start)
 SELECT c.contig, max(task_start) AS task_start, c.start, c."end" FROM c JOIN t ON c.contig = t.contig AND task_start <= c.start GROUP BY c.contig, c.start, c."end" """)  # fmt: skip
def _(spark, d):
    return setops.split_tasks(views.elements(spark, d), 100)


@query("resolve_annotation", f"""WITH {E}, p AS (SELECT contig, orientation, start AS p FROM e UNION SELECT contig, orientation, "end" FROM e),
 s AS (SELECT contig, orientation, p AS a, lead(p) OVER (PARTITION BY contig, orientation ORDER BY p) AS b FROM p),
 d AS (SELECT s.contig, s.orientation, a, b, list_sort(list(DISTINCT element)) AS data FROM s JOIN e ON s.contig = e.contig AND s.orientation = e.orientation AND e.start <= a AND b <= e."end" GROUP BY 1, 2, 3, 4),
 f AS (SELECT *, CASE WHEN lag(b) OVER w = a AND lag(data) OVER w = data THEN 0 ELSE 1 END AS fresh FROM d WINDOW w AS (PARTITION BY contig, orientation ORDER BY a)),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY contig, orientation ORDER BY a) AS run FROM f)
 SELECT contig, orientation, min(a) AS start, max(b) AS "end", first(data[1]) AS element FROM g GROUP BY contig, orientation, run""")  # fmt: skip
def _(spark, d):
    first = lambda c: F.slice(c, 1, 1)
    return segments.resolve_annotation(views.elements(spark, d), "element", first, width=WIDTH)


@query("interval_predicates", f"""WITH {R}, p AS (SELECT aln_id, start AS a, "end" AS b, start + partkey % 11 - 5 AS c, start + partkey % 11 - 5 + nh * 3 AS d FROM r)
 SELECT aln_id, b - a AS len, (a <= c AND c < b) AS contains, (a < d AND c < b) AS intersects, (a = d OR b = c) AS touches, (a <= c AND d <= b) AS envelops,
 CASE WHEN greatest(a, c) < least(b, d) THEN greatest(a, c) END AS i_start, CASE WHEN greatest(a, c) < least(b, d) THEN least(b, d) END AS i_end,
 greatest(least(b, d) - greatest(a, c), 0) AS i_len, CASE WHEN a <= d AND c <= b THEN least(a, c) END AS u_start, CASE WHEN a <= d AND c <= b THEN greatest(b, d) END AS u_end,
 a - 2 AS x_start, b + 3 AS x_end, a - 4 AS s_start FROM p""")  # fmt: skip
def _(spark, d):
    p = views.reads(spark, d).select("aln_id", F.col("start").alias("a"), F.col("end").alias("b"), (F.col("start") + F.col("partkey") % 11 - 5).alias("c"), (F.col("start") + F.col("partkey") % 11 - 5 + F.col("nh") * 3).alias("d"))
    q = ("a", "b", "c", "d")
    i, u, x, s = iv.intersection(*q), iv.union(*q), iv.extended("a", "b", F.lit(2), F.lit(3)), iv.shifted("a", "b", F.lit(-4))
    return p.select("aln_id", iv.length("a", "b").alias("len"), iv.contains("a", "b", "c").alias("contains"), iv.intersects(*q).alias("intersects"), iv.touches(*q).alias("touches"), iv.envelops(*q).alias("envelops"), i["start"].alias("i_start"), i["end"].alias("i_end"), iv.intersection_length(*q).alias("i_len"), u["start"].alias("u_start"), u["end"].alias("u_end"), x["start"].alias("x_start"), x["end"].alias("x_end"), s["start"].alias("s_start"))


# ---- segments and counts


@query("hit_segments", f"""WITH {R}, {E}, j AS (SELECT element, e.start AS qs, e."end" AS qe, greatest(r.start, e.start) AS hs, least(r."end", e."end") AS he, nh FROM e JOIN r ON {MEET}),
 p AS (SELECT element, start AS p FROM e UNION SELECT element, "end" FROM e UNION SELECT element, hs FROM j UNION SELECT element, he FROM j),
 s AS (SELECT element, p AS start, lead(p) OVER (PARTITION BY element ORDER BY p) AS "end" FROM p),
 d AS (SELECT s.element, s.start, s."end", coalesce(list_sort(list(DISTINCT nh) FILTER (nh IS NOT NULL)), []) AS data FROM s LEFT JOIN j ON s.element = j.element AND j.hs <= s.start AND s."end" <= j.he WHERE s."end" IS NOT NULL GROUP BY 1, 2, 3),
 f AS (SELECT *, CASE WHEN lag(data) OVER w = data THEN 0 ELSE 1 END AS fresh FROM d WINDOW w AS (PARTITION BY element ORDER BY start)),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY element ORDER BY start) AS run FROM f)
 SELECT element, min(start) AS start, max("end") AS "end", array_to_string(first(data), ',') AS data FROM g GROUP BY element, run""")  # fmt: skip
def _(spark, d):
    r, e = views.reads(spark, d, repeated=True), views.elements(spark, d)
    found = segments.hit_segments(e, r, "nh", ["element", *KEYS], KEYS, WIDTH)
    return found.select("element", "start", "end", F.array_join("data", ",").alias("data"))


ZEROS = "x AS (SELECT DISTINCT source, element FROM (SELECT DISTINCT source FROM r), (SELECT DISTINCT element FROM e))"


#: Weights are added up in units of 1e-15, which is exact in any order, and rounded to 6 digits.
UNITS = "CAST(round({} * 1e15) AS HUGEINT)"
COUNT = "floor(CAST(coalesce(n, 0) AS DOUBLE) / 1e15 * 1e6 + 0.5::DOUBLE) / 1e6 AS count"


def _counts(df):
    return df.select("source", "element", (F.floor(F.col("count") * 1e6 + 0.5) / 1e6).alias("count"))


@query("count_any_overlap", f"WITH {R}, {E}, {ZEROS}, h AS (SELECT DISTINCT source, aln_id, element, 1.0::DOUBLE / nh AS w FROM r JOIN e ON {MEET}), c AS (SELECT source, element, sum({UNITS.format('w')}) AS n FROM h GROUP BY 1, 2) SELECT x.source, x.element, {COUNT} FROM x LEFT JOIN c USING (source, element)")
def _(spark, d):
    return _counts(counting.count(*_both(spark, d), counting.any_overlap, width=WIDTH))


@query("count_overlap_weighted", f"""WITH {R}, {E}, {ZEROS}, j AS (SELECT source, aln_id, nh, r."end" - r.start AS len, greatest(r.start, e.start) AS hs, least(r."end", e."end") AS he, element FROM r JOIN e ON {MEET}),
 p AS (SELECT source, aln_id, hs AS p FROM j UNION SELECT source, aln_id, he FROM j),
 s AS (SELECT source, aln_id, p AS a, lead(p) OVER (PARTITION BY source, aln_id ORDER BY p) AS b FROM p),
 k AS (SELECT s.source, s.aln_id, a, b, nh, len, element, count(*) OVER (PARTITION BY s.source, s.aln_id, a) AS n FROM s JOIN j ON s.source = j.source AND s.aln_id = j.aln_id AND hs <= a AND b <= he),
 c AS (SELECT source, element, sum({UNITS.format('(b - a)::DOUBLE / (len * nh * n)')}) AS n FROM k GROUP BY 1, 2)
 SELECT x.source, x.element, {COUNT} FROM x LEFT JOIN c USING (source, element)""")  # fmt: skip
def _(spark, d):
    return _counts(counting.count(*_both(spark, d), counting.overlap_weighted, width=WIDTH))


@query("count_top_ranked", f"""WITH {R}, {E}, {ZEROS}, h AS (SELECT source, aln_id, element, row_number() OVER (PARTITION BY source, aln_id ORDER BY CASE WHEN e.orientation <> 0 THEN element % 97 END NULLS LAST, element) AS k FROM r JOIN e ON {MEET}),
 c AS (SELECT source, element, count(*)::DOUBLE AS n FROM h WHERE k = 1 GROUP BY 1, 2)
 SELECT x.source, x.element, coalesce(n, 0) AS count FROM x LEFT JOIN c USING (source, element)""")  # fmt: skip
def _(spark, d):
    r, e = _both(spark, d)
    ranks = e.where("orientation <> 0").select("element", (F.col("element") % 97).alias("rank"))
    return _counts(counting.count(r, e, counting.top_ranked(ranks), width=WIDTH))


@query("count_outcomes", f"WITH {R}, {E}, h AS (SELECT source, aln_id, EXISTS (SELECT 1 FROM e WHERE {MEET}) AS hit FROM r) SELECT source, count(*) FILTER (hit) AS resolved, count(*) FILTER (NOT hit) AS discarded FROM h GROUP BY source")
def _(spark, d):
    return counting.outcomes(*_both(spark, d), width=WIDTH)


def _partitions(spark):
    return spark.range(14).select(F.concat(F.lit("c"), (F.col("id") % 5).cast("string")).alias("contig"), (F.col("id") * 1500).alias("start"), (F.col("id") * 1500 + 1200 + F.col("id") * 37).alias("end"))


PARTS = "q AS (SELECT concat('c', i % 5) AS contig, i * 1500 AS start, i * 1500 + 1200 + i * 37 AS \"end\" FROM range(14) t(i))"


@query("count_partitions", f"""WITH {R}, {E}, {PARTS}, h AS (SELECT *, EXISTS (SELECT 1 FROM e WHERE {MEET}) AS hit FROM r)
 SELECT source, q.contig, q.start AS part_start, q."end" AS part_end, count(*) FILTER (hit) AS resolved, count(*) FILTER (NOT hit) AS discarded
 FROM h JOIN q ON h.contig = q.contig AND h.start < q."end" AND q.start < h."end" GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    return counting.partition_metrics(*_both(spark, d), _partitions(spark), WIDTH)


@query("elements_without_partition", f'WITH {E}, {PARTS} SELECT DISTINCT element FROM e WHERE NOT EXISTS (SELECT 1 FROM q WHERE e.contig = q.contig AND e.start < q."end" AND q.start < e."end")')
def _(spark, d):
    return counting.elements_without_partition(views.elements(spark, d), _partitions(spark), WIDTH)


# ---- chains

CHAIN = islands("e", keys="custkey") + """, l AS (SELECT custkey, start, "end", coalesce(sum("end" - start) OVER (PARTITION BY custkey ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM m)"""


def _chains(spark, d):
    e = views.elements(spark, d)
    return e, setops.merge(e, ["custkey"])


@query("chain_map", f"""WITH {CHAIN}, q AS (SELECT element, custkey, start - element % 9 AS s, "end" + element % 5 AS e FROM e),
 h AS (SELECT element, q.custkey, e - s AS want, o + greatest(s, l.start) - l.start AS a, o + least(e, l."end") - l.start AS b FROM q JOIN l ON q.custkey = l.custkey AND s < l."end" AND l.start < e)
 SELECT element, CASE WHEN sum(b - a) = max(want) THEN 'Complete' ELSE 'Truncated' END AS status, CAST(min(a) AS BIGINT) AS start, CAST(max(b) AS BIGINT) AS "end" FROM h GROUP BY element""")  # fmt: skip
def _(spark, d):
    e, chains = _chains(spark, d)
    q = e.select("element", "custkey", (F.col("start") - F.col("element") % 9).alias("start"), (F.col("end") + F.col("element") % 5).alias("end"))
    return mapping.map_intervals(q, chains, "custkey", "element", WIDTH).select("element", "status", "start", "end")


@query("chain_invmap", f"""WITH {CHAIN}, q AS (SELECT DISTINCT custkey, 3 AS s, 3 + custkey % 60 + 1 AS e FROM e),
 h AS (SELECT q.custkey, e - s AS want, l.start + greatest(s, o) - o AS a, l.start + least(e, o + l."end" - l.start) - o AS b FROM q JOIN l ON q.custkey = l.custkey AND s < o + l."end" - l.start AND o < e),
 g AS (SELECT custkey, CASE WHEN sum(b - a) = max(want) THEN 'Complete' ELSE 'Truncated' END AS status, string_agg(concat(CAST(a AS BIGINT), '-', CAST(b AS BIGINT)), ',' ORDER BY a) AS links FROM h GROUP BY custkey)
 SELECT q.custkey, coalesce(status, 'None') AS status, links FROM q LEFT JOIN g USING (custkey)""")  # fmt: skip
def _(spark, d):
    e, chains = _chains(spark, d)
    q = e.select("custkey").distinct().select("custkey", F.col("custkey").alias("query"), F.lit(3).cast("long").alias("start"), (F.lit(3) + F.col("custkey") % 60 + 1).alias("end"))
    found = mapping.invmap_intervals(q, chains, "custkey", "query", WIDTH)
    return found.select("custkey", "status", iv.chain_display("links").alias("links"))


# ---- tracks

def w420():
    """Weights 1 / nh in units of 1 / 420, which are integers."""
    return F.lit(420) / F.col("nh")


def _cov(name, where, keys="contig"):
    return f"""{name}_d AS (SELECT {keys}, p, sum(w) AS d FROM (SELECT {keys}, start AS p, 420 // nh AS w FROM r WHERE {where} UNION ALL SELECT {keys}, "end", -(420 // nh) FROM r WHERE {where}) GROUP BY {keys}, p),
 {name}_s AS (SELECT {keys}, p AS start, lead(p) OVER (PARTITION BY {keys} ORDER BY p) AS "end", CAST(sum(d) OVER (PARTITION BY {keys} ORDER BY p) AS DOUBLE) AS value FROM {name}_d WHERE d <> 0),
 {name} AS (SELECT * FROM {name}_s WHERE "end" IS NOT NULL AND value <> 0)"""


@query("coverage", f"WITH {R}, {_cov('t', 'TRUE', 'contig, orientation')} SELECT contig, orientation, start, \"end\", value FROM t")
def _(spark, d):
    return tracks.coverage(views.reads(spark, d), KEYS, w420())


RLE = """{t}1 AS (SELECT *, CASE WHEN lag("end") OVER w = start AND lag(value) OVER w = value THEN 0 ELSE 1 END AS fresh FROM {t} WINDOW w AS (PARTITION BY {k} ORDER BY start)),
 {t}2 AS (SELECT *, sum(fresh) OVER (PARTITION BY {k} ORDER BY start) AS run FROM {t}1), {t}r AS (SELECT {k}, min(start) AS start, max("end") AS "end", min(value) AS value FROM {t}2 GROUP BY {k}, run)"""


@query("rle_encode", f"WITH v AS (SELECT user_id AS contig, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS start, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS \"end\", CAST(length(event_type) AS BIGINT) AS value FROM events), {RLE.format(t='v', k='contig')} SELECT contig, start, \"end\", value FROM vr")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long")
    runs = e.select(F.col("user_id").alias("contig"), (n - 1).alias("start"), n.alias("end"), F.length("event_type").cast("long").alias("value"))
    return tracks.rle_encode(runs, ["contig"])


def _three(spark, d):
    r = views.reads(spark, d)
    return [tracks.coverage(r.where(f"orientation = {o}"), ["contig"], w420()) for o in (1, -1, 0)]


def _merged(names, value):
    points = " UNION ".join(f'SELECT contig, start AS p FROM {n} UNION SELECT contig, "end" FROM {n}' for n in names)
    joined = " ".join(f'LEFT JOIN {n} ON {n}.contig = z.contig AND {n}.start <= z.start AND z."end" <= {n}."end"' for n in names)
    some = " OR ".join(f"{n}.value IS NOT NULL" for n in names)
    return f"""p AS ({points}), z AS (SELECT contig, p AS start, lead(p) OVER (PARTITION BY contig ORDER BY p) AS "end" FROM p),
 u AS (SELECT z.contig, z.start, z."end", {value} AS value FROM z {joined} WHERE z."end" IS NOT NULL AND ({some})), {RLE.format(t='u', k='contig')}"""


AB = f"{R}, {_cov('a', 'orientation = 1')}, {_cov('b', 'orientation = -1')}"


@query("rle_merge2", f"WITH {AB}, {_merged('ab', 'greatest(coalesce(a.value, b.value), coalesce(b.value, a.value))')} SELECT contig, start, \"end\", value FROM ur")
def _(spark, d):
    a, b, _c = _three(spark, d)
    return tracks.rle_merge2(a, b, lambda x, y: F.greatest(x, y), ["contig"])


@query("rle_merge_k", f"WITH {AB}, {_cov('c', 'orientation = 0')}, {_merged('abc', 'coalesce(a.value, 0) + coalesce(b.value, 0) + coalesce(c.value, 0)')} SELECT contig, start, \"end\", value FROM ur")
def _(spark, d):
    return tracks.rle_merge(_three(spark, d), lambda v: F.aggregate(v, F.lit(0.0), lambda x, y: x + y), ["contig"])


ENRICH = f"{AB}, {_merged('ab', 'CASE WHEN coalesce(a.value, 0) = 0 THEN 0 WHEN coalesce(b.value, 0) = 0 THEN CAST(' + chr(39) + 'inf' + chr(39) + ' AS DOUBLE) ELSE round(a.value * 2 / b.value, 6) END')}"


def _enriched(spark, d):
    a, b, _c = _three(spark, d)
    found = peaks.enrichment(a, b, 2.0, 1.0, ["contig"])
    return tracks.rle_encode(found.withColumn("value", F.round("value", 6)), ["contig"])


@query("enrichment", f"WITH {ENRICH} SELECT contig, start, \"end\", CASE WHEN isinf(value) THEN -1.0 ELSE value END AS value FROM ur")
def _(spark, d):
    return _enriched(spark, d).withColumn("value", F.when(F.col("value") == float("inf"), -1.0).otherwise(F.col("value")))


@query("call_peaks", f"""WITH {R}, {_cov('t', 'TRUE')}, {RLE.format(t='t', k='contig')}, k AS (SELECT * FROM tr WHERE value >= 1500),
 k1 AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY start) AS isl FROM (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY contig ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 4 THEN 0 ELSE 1 END AS fresh FROM k))
 SELECT contig, min(start) AS start, max("end") AS "end", max(value) AS signal, first((start + "end") // 2 ORDER BY value DESC, start) AS summit FROM k1 GROUP BY contig, isl HAVING max("end") - min(start) > 10""")  # fmt: skip
def _(spark, d):
    track = tracks.coverage(views.reads(spark, d), ["contig"], w420())
    return peaks.call_peaks(track, peaks.Cutoff(1500, 4, 10), ["contig"])


def _written(df):
    """df from a table in the shared folder: what is used several times is computed once, and plans stay small."""
    path = f"{_folder(df.sparkSession)}/part"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _rois(spark, d):
    return setops.merge(views.elements(spark, d), KEYS).withColumn("roi_id", F.concat_ws(":", "contig", "orientation", (F.col("start") / 500).cast("long")))


def _sides(spark, d):
    r = views.reads(spark, d)
    return tracks.coverage(r.where("source = 's1'"), KEYS, w420()), tracks.coverage(r.where("source = 's0'"), KEYS, w420())


#: Position by position: s and c are signal and control, rp the regions' positions with their places on the spliced axis.
POSITIONS = f"""{R}, {islands("e")}, w AS (SELECT source, contig, orientation, 420 // nh AS w, unnest(range(start, "end")) AS pos FROM r),
 sc AS (SELECT contig, orientation, pos, CAST(coalesce(sum(w) FILTER (source = 's1'), 0) AS DOUBLE) AS s, CAST(coalesce(sum(w) FILTER (source = 's0'), 0) AS DOUBLE) AS c FROM w GROUP BY ALL),
 u AS (SELECT concat_ws(':', contig, orientation, start // 500) AS roi_id, contig, orientation, unnest(range(start, "end")) AS pos FROM m),
 rp AS (SELECT *, row_number() OVER (PARTITION BY roi_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY roi_id) AS n FROM u)"""


def _smooth(means):
    """Greatest mean of each position of a region with control; `means` over the window l."""
    return f"""v AS (SELECT rp.*, coalesce(c, 0) AS v, sum(coalesce(c, 0)) OVER (PARTITION BY roi_id) AS total FROM rp LEFT JOIN sc USING (contig, orientation, pos)),
 sm AS (SELECT contig, orientation, pos, greatest({means}) AS value FROM v WHERE total > 0 WINDOW l AS (PARTITION BY roi_id ORDER BY i))"""


def _mean(w):
    return f"CASE WHEN n > {w} AND i >= {w // 2} AND i - {w // 2} + {w} <= n THEN avg(v) OVER (PARTITION BY roi_id ORDER BY i ROWS BETWEEN {w // 2} PRECEDING AND {w - w // 2 - 1} FOLLOWING) END"


def _islands_of(source, out, near):
    """Peaks: positions of source at most `near` apart, longer than 5."""
    return f"""{out}1 AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= {near} THEN 0 ELSE 1 END AS fresh FROM {source} WINDOW w AS (PARTITION BY contig, orientation ORDER BY pos)),
 {out}2 AS (SELECT *, sum(fresh) OVER (PARTITION BY contig, orientation ORDER BY pos) AS isl FROM {out}1),
 {out} AS (SELECT contig, orientation, isl, min(pos) AS ps, max(pos) + 1 AS pe FROM {out}2 GROUP BY ALL HAVING max(pos) + 1 - min(pos) > 5)"""


def _recalled(group, mean, fold):
    """From d0(group, roi_id, contig, orientation, pos, d) and peaks pk: what passes the local baseline, as out(roi_id, ...)."""
    return f"""d1 AS (SELECT *, min(d) OVER (PARTITION BY {group}) AS least, {mean} AS mean FROM d0),
 d2 AS (SELECT d1.*, d - least AS v, ps FROM d1 JOIN pk ON d1.contig = pk.contig AND d1.orientation = pk.orientation AND ps <= pos AND pos < pe WHERE mean - least > 1e-6 AND d - least >= (mean - least) * {fold}::DOUBLE),
 d3 AS (SELECT *, CASE WHEN pos = lag(pos) OVER w + 1 THEN 0 ELSE 1 END AS fresh FROM d2 WINDOW w AS (PARTITION BY {group}, ps ORDER BY pos)),
 d4 AS (SELECT *, sum(fresh) OVER (PARTITION BY {group}, ps ORDER BY pos) AS run FROM d3),
 out AS (SELECT roi_id, contig, orientation, min(pos) AS start, max(pos) + 1 AS "end", max(v) AS signal, first(pos ORDER BY v DESC, pos) AS summit FROM d4 GROUP BY {group}, roi_id, contig, orientation, ps, run HAVING count(*) > 1)"""


PEAKS = f"q AS (SELECT contig, orientation, pos FROM sc WHERE s > 0 AND (c = 0 OR s / c >= 1.5::DOUBLE)), {_islands_of('q', 'pk', 5)}"


@query("smooth_control", f"WITH {POSITIONS}, {_smooth('total / n, ' + _mean(16) + ', ' + _mean(64))} SELECT contig, orientation, pos, round(value, 6) AS value FROM sm")
def _(spark, d):
    _s, c = _sides(spark, d)
    rois = _rois(spark, d).withColumnRenamed("roi_id", "chain_id")
    return peaks.smooth(c, rois, peaks.ControlModel((16, 64), True)).withColumn("value", F.round("value", 6))


@query("nms_uniform", f"WITH {POSITIONS}, {PEAKS}, d0 AS (SELECT rp.*, s - c AS d FROM rp JOIN sc USING (contig, orientation, pos)), {_recalled('roi_id', 'avg(d) OVER (PARTITION BY roi_id)', 1.5)} SELECT * FROM out")
def _(spark, d):
    s, c = (_written(t) for t in _sides(spark, d))
    found = _written(peaks.call_peaks(peaks.enrichment(s, c), peaks.Cutoff(1.5, 4, 5)))
    return peaks.nms_uniform(found, _rois(spark, d), s, c, peaks.Nms(1.5))


@query("nms_slop", f"""WITH {POSITIONS}, {PEAKS}, a0 AS (SELECT roi_id, ps, n, min(i) AS a, max(i) + 1 AS b FROM rp JOIN pk ON rp.contig = pk.contig AND rp.orientation = pk.orientation AND ps <= pos AND pos < pe GROUP BY 1, 2, 3),
 a1 AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY roi_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 20 THEN 0 ELSE 1 END AS fresh FROM a0),
 a2 AS (SELECT *, sum(fresh) OVER (PARTITION BY roi_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM a1),
 a3 AS (SELECT roi_id, grp, n, min(a) AS a, max(b) AS b, max(b) - min(a) AS size FROM a2 GROUP BY 1, 2, 3),
 a4 AS (SELECT *, greatest(5, least(200, size // 2)) AS slop FROM a3),
 d0 AS (SELECT grp, size, rp.*, s - c AS d FROM a4 JOIN rp ON a4.roi_id = rp.roi_id AND i >= a - slop AND i < b + slop JOIN sc ON rp.contig = sc.contig AND rp.orientation = sc.orientation AND rp.pos = sc.pos),
 {_recalled('roi_id, grp', 'sum(d) OVER (PARTITION BY roi_id, grp) / size', 1.2)} SELECT * FROM out""")  # fmt: skip
def _(spark, d):
    s, c = (_written(t) for t in _sides(spark, d))
    found = _written(peaks.call_peaks(peaks.enrichment(s, c), peaks.Cutoff(1.5, 4, 5)))
    return peaks.nms_slop(found, _written(_rois(spark, d)), s, c, peaks.Nms(1.2, 20, 0.5, (5, 200)), cut=_written)


@query("harvest", f"""WITH {POSITIONS}, {_smooth(_mean(16))}, t AS (SELECT contig, orientation, pos, coalesce(s, 0) AS s, greatest(coalesce(c, 0), coalesce(value, 0), 1) AS c
  FROM sc FULL JOIN (SELECT * FROM sm WHERE value IS NOT NULL) USING (contig, orientation, pos)),
 k AS (SELECT 'signal' AS kind, contig, orientation, pos FROM sc WHERE s > 0 UNION ALL SELECT 'modelled', contig, orientation, pos FROM sc WHERE s > 0 UNION ALL SELECT 'control', contig, orientation, pos FROM t),
 k1 AS (SELECT *, pos - row_number() OVER (PARTITION BY kind, contig, orientation ORDER BY pos) AS isl FROM k),
 q AS (SELECT contig, orientation, pos, s / c AS value FROM t WHERE s / c >= 2::DOUBLE), {_islands_of('q', 'pk', 5)},
 y AS (SELECT *, pos - row_number() OVER (PARTITION BY contig, orientation, value ORDER BY pos) AS run FROM pk2),
 z AS (SELECT contig, orientation, isl, value, min(pos) AS a, max(pos) + 1 AS b FROM y GROUP BY contig, orientation, isl, value, run),
 o AS (SELECT contig, orientation, isl, max(value) AS signal, first((a + b) // 2 ORDER BY value DESC, a) AS summit FROM z GROUP BY 1, 2, 3),
 d0 AS (SELECT rp.*, s - c AS d FROM rp JOIN t USING (contig, orientation, pos)), {_recalled('roi_id', 'avg(d) OVER (PARTITION BY roi_id)', 1.5)}
 SELECT kind, contig, orientation, min(pos) AS start, max(pos) + 1 AS "end", CAST(NULL AS DOUBLE) AS signal, CAST(NULL AS BIGINT) AS summit FROM k1 GROUP BY kind, contig, orientation, isl
 UNION ALL SELECT 'peaks', contig, orientation, ps, pe, signal, summit FROM pk JOIN o USING (contig, orientation, isl)
 UNION ALL SELECT 'filtered', contig, orientation, start, "end", signal, summit FROM out""")  # fmt: skip
def _(spark, d):
    r = views.reads(spark, d)
    return peaks.harvest(r.where("source = 's1'"), r.where("source = 's0'"), _written(_rois(spark, d)), peaks.ControlModel((16,), False), peaks.Cutoff(2.0, 4, 5), peaks.Nms(1.5), weight=w420(), cut=_written)


# ---- reads

FLAGS = "(orderkey % 2) * 16 + (partkey % 2) * 64 + CASE WHEN suppkey % 5 = 0 THEN 4 ELSE 0 END + CASE WHEN suppkey % 3 = 0 THEN 512 ELSE 0 END + 1"
MAPQ = "CASE WHEN partkey % 4 = 0 THEN NULL ELSE partkey % 61 END"


def _flagged(spark, d):
    return views.reads(spark, d).withColumn("flags", F.expr(FLAGS).cast("int")).withColumn("mapq", F.expr(MAPQ).cast("int"))


@query("flag_filter", f"WITH {R} SELECT aln_id FROM r WHERE ({FLAGS}) & 1 = 1 AND ({FLAGS}) & 516 = 0 AND coalesce({MAPQ}, 255) >= 30")
def _(spark, d):
    return reads.flag_filter(_flagged(spark, d), 1, 516, 30).select("aln_id")


@query("strand_deduction", f"""WITH {R}, f AS (SELECT aln_id, orderkey % 2 = 1 AS rv, partkey % 2 = 1 AS fs FROM r)
 SELECT aln_id, CASE WHEN rv THEN -1 ELSE 1 END AS se_forward, CASE WHEN rv THEN 1 ELSE -1 END AS se_reverse,
 CASE WHEN fs <> rv THEN 1 ELSE -1 END AS pe_forward, CASE WHEN fs <> rv THEN -1 ELSE 1 END AS pe_reverse, 0 AS unstranded FROM f""")  # fmt: skip
def _(spark, d):
    o = lambda *a: reads.orientation("flags", *a).cast("int")
    return _flagged(spark, d).select("aln_id", *(o(k, s).alias(f"{k.lower()}_{s}") for k in ("SE", "PE") for s in ("forward", "reverse")), o("SE", "unstranded").alias("unstranded"))


CIG = "array(struct('S' as op, 2 as len), struct('M' as op, cast(end - start as int) as len), struct('N' as op, cast(partkey % 10 + 1 as int) as len), struct('M' as op, cast(nh as int) as len), struct('I' as op, 3 as len), struct('=' as op, 2 as len), struct('D' as op, 4 as len), struct('X' as op, 1 as len))"


@query("cigar_blocks", f"""WITH {R}, g AS (SELECT aln_id, start AS a0, "end" AS b0, "end" + partkey % 10 + 1 AS a1, "end" + partkey % 10 + 1 + nh AS b1 FROM r)
 SELECT aln_id, concat(a0, '-', b0, ',', a1, '-', b1, ',', b1, '-', b1 + 2, ',', b1 + 6, '-', b1 + 7) AS blocks FROM g""")  # fmt: skip
def _(spark, d):
    r = views.reads(spark, d).withColumn("cigar", F.expr(CIG.replace("end -", "`end` -")))
    return r.select("aln_id", iv.chain_display(reads.cigar_blocks("start", "cigar")).alias("blocks"))


@query("mate_pairs", f"""WITH {R}, s AS (SELECT orderkey AS qname, nh AS hi, partkey % 2 = 1 AS fs, aln_id FROM r)
 SELECT qname, hi, max(aln_id) FILTER (fs) AS first_id, max(aln_id) FILTER (NOT fs) AS second_id FROM s GROUP BY qname, hi HAVING count(*) FILTER (fs) = 1 AND count(*) FILTER (NOT fs) = 1""")  # fmt: skip
def _(spark, d):
    r = _flagged(spark, d).select(F.col("orderkey").alias("qname"), F.col("nh").alias("hi"), "flags", "aln_id")
    return reads.mate_pairs(r).select("qname", "hi", F.col("first.aln_id").alias("first_id"), F.col("second.aln_id").alias("second_id"))


def _bases(spark, d):
    r = views.reads(spark, d)
    n = (F.col("end") - F.col("start")).cast("int")
    cigar = F.expr("array(struct('M' as op, cast(`end` - `start` as int) as len), struct('D' as op, cast(2 as int) as len))")
    return r.select(F.col("source").alias("tag"), F.col("contig").alias("seqid"), "orientation", "start", cigar.alias("cigar"), F.expr("substring(repeat('ACGTTGCANC', 7), cast(partkey % 10 as int) + 1, 60)").alias("seq"), F.transform(F.sequence(F.lit(1), n), lambda i: ((i * 7 + F.col("partkey")) % 40).cast("int")).alias("quals"))


OBS = f"""{R}, o AS (SELECT source AS tag, contig AS seqid, orientation, start + i - 1 AS position, substr(repeat('ACGTTGCANC', 7), CAST(partkey % 10 + i AS BIGINT), 1) AS b, (i * 7 + partkey) % 40 AS q
 FROM (SELECT *, unnest(range(1, "end" - start + 1)) AS i FROM r)
 UNION ALL SELECT source, contig, orientation, "end" + k, 'deletion', 99 FROM r, (SELECT unnest([0, 1]) AS k)),
 n AS (SELECT tag, seqid, orientation, position, count(*) FILTER (b = 'A') AS "A", count(*) FILTER (b = 'C') AS "C", count(*) FILTER (b = 'G') AS "G", count(*) FILTER (b = 'T') AS "T", count(*) FILTER (b = 'N') AS "N", count(*) FILTER (b = 'deletion') AS deletion
 FROM o WHERE q >= 10 GROUP BY 1, 2, 3, 4)"""
COLS = 'tag, seqid, orientation, position, "A", "C", "G", "T", "N", deletion'


@query("pileup_counts", f"WITH {OBS} SELECT {COLS} FROM n")
def _(spark, d):
    return pileup.counts(pileup.explode_bases(_bases(spark, d), 10))


def _sequences(spark):
    return spark.range(7).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("seqid"), F.expr("repeat('ACGTNACGGT', 5000)").alias("seq"))


SITES = f"""{OBS}, t AS (SELECT *, substr('ACGTNACGGT', CAST(position % 10 + 1 AS BIGINT), 1) AS reference, "A" + "C" + "G" + "T" + "N" + deletion AS cov FROM n),
 mm AS (SELECT *, cov - CASE reference WHEN 'A' THEN "A" WHEN 'C' THEN "C" WHEN 'G' THEN "G" WHEN 'T' THEN "T" ELSE "N" END AS mis FROM t)"""


@query("select_mismatches", f"WITH {SITES} SELECT {COLS}, reference FROM mm WHERE mis >= 4 AND mis::DOUBLE / cov >= 0.75")
def _(spark, d):
    return pileup.pileup(_bases(spark, d), _sequences(spark), pileup.select_mismatches(4, 0.75), min_phred=10)


REQUIRED = 'EXISTS (SELECT 1 FROM e WHERE e.contig = seqid AND e.orientation = mm.orientation AND e.start <= position AND position < e."end")'


def _required(spark, d):
    return views.elements(spark, d).select(F.col("contig").alias("seqid"), "orientation", "start", "end")


@query("select_required", f"WITH {SITES}, {E} SELECT {COLS}, reference FROM mm WHERE {REQUIRED}")
def _(spark, d):
    return pileup.pileup(_bases(spark, d), _sequences(spark), pileup.select_required(_required(spark, d)), min_phred=10)


@query("select_required_or_mismatches", f"WITH {SITES}, {E} SELECT {COLS}, reference FROM mm WHERE (mis >= 4 AND mis::DOUBLE / cov >= 0.75) OR {REQUIRED}")
def _(spark, d):
    return pileup.pileup(_bases(spark, d), _sequences(spark), pileup.select_any(pileup.select_mismatches(4, 0.75), pileup.select_required(_required(spark, d))), min_phred=10)


# ---- normalisation and metadata

VALUES = "v AS (SELECT p_type AS region, concat(l_returnflag, l_linestatus) AS sample, count(*)::DOUBLE AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


@query("median_of_ratios", f"""WITH {VALUES}, k AS (SELECT region FROM v GROUP BY region HAVING max(value) >= 3), n AS (SELECT count(DISTINCT sample) AS n FROM v),
 l AS (SELECT region, avg(ln(value)) AS m FROM v JOIN k USING (region) WHERE value > 0 GROUP BY region HAVING count(*) = (SELECT n FROM n)),
 f AS (SELECT sample, exp(quantile_cont(ln(value) - m, 0.5)) AS factor FROM v JOIN l USING (region) GROUP BY sample)
 SELECT region, sample, round(value / factor, 6) AS value FROM v JOIN f USING (sample)""")  # fmt: skip
def _(spark, d):
    t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("lineitem", "part")}
    v = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("region"), F.concat("l_returnflag", "l_linestatus").alias("sample")).agg(F.count("*").cast("double").alias("value"))
    return norm.normalise(v, 3.0).withColumn("value", F.round("value", 6))


def _project(spark, d):
    """Customers as samples, their orders as libraries and experiments, lines as runs; some references dangle and some layouts differ."""
    c, o, li = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("customer", "orders", "lineitem"))
    none = F.lit(None).cast("string")
    samples = c.select(F.concat(F.lit("s"), "c_custkey").alias("ind"), F.array(F.lit("x")).alias("organisms"), F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("meta"), none.alias("description"))
    lib = o.select(F.concat(F.lit("l"), "o_orderkey").alias("ind"), F.concat(F.lit("s"), F.col("o_custkey") + F.when(F.col("o_orderkey") % 50 == 0, 1_000_000).otherwise(0)).alias("sample"), F.lit("reverse").alias("strandedness")).dropDuplicates(["ind"])
    ex = o.select(F.concat(F.lit("e"), "o_orderkey").alias("ind"), F.concat(F.lit("l"), "o_orderkey").alias("library"), F.when(F.col("o_orderkey") % 2 == 0, "PE").otherwise("SE").alias("layout")).dropDuplicates(["ind"])
    kind = F.when(F.col("l_orderkey") % 2 == 0, "PE").otherwise("SE")
    runs = li.select(F.concat_ws("-", F.lit("r"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ind"), F.concat(F.lit("e"), "l_orderkey").alias("experiment"), F.when(F.col("l_partkey") % 100 == 0, "SE").otherwise(kind).alias("kind"), F.lit("a").alias("file1"), F.when(F.when(F.col("l_partkey") % 100 == 0, "SE").otherwise(kind) == "PE", "b").alias("file2"), F.col("l_quantity").cast("long").alias("reads"), F.col("l_quantity").cast("long").alias("bases"))
    return metadata.Project("p", samples, lib, ex, runs)


@query("project_integrity", """WITH li AS (SELECT *, concat_ws('-', 'r', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ind FROM lineitem),
 o AS (SELECT DISTINCT ON (o_orderkey) * FROM orders)
 SELECT 'libraries' AS "table", 'unknown sample' AS problem, count(*) AS n FROM o WHERE o_orderkey % 50 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer) HAVING count(*) > 0
 UNION ALL SELECT 'runs', 'unknown experiment', count(*) FROM li WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o) HAVING count(*) > 0
 UNION ALL SELECT 'runs', 'layout differs from the experiment''s', count(*) FROM li WHERE l_partkey % 100 = 0 AND l_orderkey % 2 = 0 AND l_orderkey IN (SELECT o_orderkey FROM o) HAVING count(*) > 0
 UNION ALL SELECT 'experiments', 'no runs', count(*) FROM o WHERE o_orderkey NOT IN (SELECT l_orderkey FROM li) HAVING count(*) > 0
 UNION ALL SELECT 'project', 'id is not unique', count(*) FROM (SELECT ind FROM li GROUP BY ind HAVING count(*) > 1) HAVING count(*) > 0""")  # fmt: skip
def _(spark, d):
    return metadata.problems(_project(spark, d)).groupBy("table", "problem").agg(F.count("*").alias("n"))


@query("project_filter", """WITH o AS (SELECT DISTINCT ON (o_orderkey) * FROM orders), r AS (SELECT l_orderkey AS k FROM lineitem JOIN o ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3 AND o_orderkey % 2 = 0 AND o_orderkey % 50 <> 0 AND l_quantity > 10)
 SELECT count(*) AS runs, count(DISTINCT k) AS experiments, count(DISTINCT o_custkey) AS samples FROM r JOIN o ON k = o_orderkey""")  # fmt: skip
def _(spark, d):
    keep = metadata.Filters().with_attribute("nation", "3").with_layout("PE").with_run(F.col("reads") > 10)
    p = keep(_project(spark, d))
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(p.runs, "runs").crossJoin(one(p.experiments, "experiments")).crossJoin(one(p.samples, "samples"))


@query("ref_registry_resolve", "WITH f AS (SELECT n_name AS name, [concat('n', n_nationkey), lower(n_name)] AS a FROM nation), q AS (SELECT concat('n', c_nationkey + c_custkey % 3) AS asked, c_custkey FROM customer) SELECT c_custkey, asked, f.name AS reference FROM q LEFT JOIN f ON list_contains(a, asked)")
def _(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    refs = n.select(F.col("n_name").alias("name"), F.array(F.concat(F.lit("n"), "n_nationkey"), F.lower("n_name")).alias("aliases"))
    c = spark.read.parquet(f"{d}/customer.parquet")
    return metadata.resolve(c.select("c_custkey", F.concat(F.lit("n"), (F.col("c_nationkey") + F.col("c_custkey") % 3).cast("string")).alias("asked")), refs, "asked")


@query("introns_tss", f"""WITH {islands("e", keys="custkey")}, i AS (SELECT custkey, "end" AS start, lead(start) OVER (PARTITION BY custkey ORDER BY start) AS "end" FROM m)
 SELECT custkey, start, "end", CASE WHEN custkey % 2 = 1 THEN start ELSE "end" END AS tss, CASE WHEN custkey % 2 = 1 THEN "end" ELSE start END AS tes FROM i WHERE "end" IS NOT NULL""")  # fmt: skip
def _(spark, d):
    _e, chains = _chains(spark, d)
    found = metadata.introns(chains, "custkey").withColumn("strand", F.when(F.col("custkey") % 2 == 1, 1).otherwise(-1))
    return found.select("custkey", "start", "end", metadata.tss().alias("tss"), metadata.tes().alias("tes"))


# ---- sequences and files

SEQ = "regexp_replace(translate(upper(coalesce(text, '')), 'T', 'U'), '[^ACGU]', '', 'g')"


def _rna(spark, d):
    """Letters of each whole text that are bases, with T as U."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").alias("seqid"), F.regexp_replace(F.translate(F.upper(F.coalesce("text", F.lit(""))), "T", "U"), "[^ACGU]", "").alias("seq"))


def _names(spark, d):
    """Names of parts: short sequences, all of them."""
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(F.col("p_partkey").alias("seqid"), F.upper(F.regexp_replace(F.concat("p_name", "p_type"), "[^A-Za-z]", "")).alias("seq1"), F.upper(F.regexp_replace(F.concat("p_type", "p_brand"), "[^A-Za-z]", "")).alias("seq2"))


@query("sw_best")
def _(spark, d):
    return align.align_pairs(_names(spark, d), scoring=align.Scoring())


@query("sw_all_optimal")
def _(spark, d):
    return align.align_pairs(_names(spark, d), best=False, min_score=4)


@query("inverted_repeats")
def _(spark, d):
    return repeats.predict_repeats(_rna(spark, d), repeats.Filter(min_score=3, min_matches=3))


@query("repeat_optimize")
def _(spark, d):
    return repeats.best_repeats(_rna(spark, d), repeats.Filter(min_score=3, min_matches=3))


@query("bed12_lines", f"""WITH {E} SELECT concat_ws(chr(9), contig, start, "end", concat('e', element), element % 1001, CASE orientation WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '.' END, start, "end", '0,0,0', 1, "end" - start, 0) AS value FROM e""")
def _(spark, d):
    e = views.elements(spark, d).select(F.col("contig").alias("seqid"), "start", "end", F.concat(F.lit("e"), "element").alias("name"), (F.col("element") % 1001).cast("int").alias("score"), F.col("orientation").cast("byte").alias("orientation"))
    return bed.bed_lines(bed.to_bed(e, 12), 12)


@query("bed12_roundtrip", f"""WITH {E} SELECT contig AS seqid, start, "end", concat('e', element) AS name, element % 1001 AS score, orientation FROM e""")
def _(spark, d):
    e = views.elements(spark, d).select(F.col("contig").alias("seqid"), "start", "end", F.concat(F.lit("e"), "element").alias("name"), (F.col("element") % 1001).cast("int").alias("score"), F.col("orientation").cast("byte").alias("orientation"))
    path = f"{_folder(spark)}/bed12"
    bed.write_bed(bed.to_bed(e, 12), path, 12)
    return bed.read_bed(spark, path, 12).select("seqid", "start", "end", "name", F.col("score").cast("long").alias("score"), F.col("orientation").cast("int").alias("orientation"))


def _folder(spark):
    """A folder of this run in the shared one."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="strandline-")
    return f"{root}/{uuid.uuid4().hex}"


@query("fasta_fetch", "WITH q AS (SELECT p_partkey AS seqid, upper(regexp_replace(concat(p_name, p_type), '[^A-Za-z]', '', 'g')) AS seq FROM part) SELECT seqid, 2 AS start, length(seq) - 3 AS \"end\", substr(seq, 3, length(seq) - 5) AS seq FROM q WHERE length(seq) > 8")
def _(spark, d):
    s = _names(spark, d).where(F.length("seq1") > 8)
    q = s.select("seqid", F.lit(2).cast("long").alias("start"), (F.length("seq1") - 3).cast("long").alias("end"))
    return fasta.fetch_from(q, s.select(F.col("seqid").alias("id"), F.col("seq1").alias("seq")), 8)


@query("fasta_lengths", "SELECT doc_id AS id, length(" + SEQ + ") AS length FROM documents")
def _(spark, d):
    return fasta.lengths(_rna(spark, d).select(F.col("seqid").alias("id"), "seq"))


@query("fasta_roundtrip", "WITH q AS (SELECT CAST(doc_id AS VARCHAR) AS id, " + SEQ + " AS seq FROM documents) SELECT id, length(seq) AS length, md5(seq) AS digest FROM q WHERE seq <> ''")
def _(spark, d):
    path = f"{_folder(spark)}/fasta"
    fasta.write_fasta(_rna(spark, d).where("seq <> ''").select(F.col("seqid").cast("string").alias("id"), "seq"), path)
    return fasta.read_fasta(spark, path).select("id", F.length("seq").cast("long").alias("length"), F.md5("seq").alias("digest"))
