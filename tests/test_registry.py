"""Queries of the engine, one or two of each kind, against their SQL on the smallest tables."""

import os

import pytest

from strandline.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return round(v, 5)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", ["count_any_overlap", "count_overlap_weighted", "interval_subtract", "overlap_left", "hit_segments", "coverage", "rle_merge2", "chain_invmap", "pileup_counts", "median_of_ratios", "project_integrity", "bed12_roundtrip", "task_split", "resolve_annotation", "smooth_control", "nms_uniform", "nms_slop", "harvest"])
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in got.collect()), key=repr)
    out = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in out.fetchall()), key=repr)
    assert rows == want


def test_llm_is_not_imported():
    import subprocess
    import sys

    code = "import sys, strandline.plans.registry; assert not any(m.startswith('strandline.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
