import math

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from tracemill.operators import stats
from tracemill.operators.stats import F


def test_robust_z_of_any_baseline(spark):
    nan = float("nan")
    rows = [(0, 1.0, 2.0), (1, None, 2.0), (2, nan, 2.0), (3, 1.0, None), (4, 1.0, nan), (5, 1.0, 0.0), (6, 1.0, -1.0), (7, -4e6, 0.5)]
    df = spark.createDataFrame(rows, "i int, median double, mad double").select("i", stats.robust_z(F.lit(1.0), F.col("median"), F.col("mad")).alias("z"))
    want = [0.0, 1 / 2.9652, 1 / 2.9652, 0.0, 0.0, 0.0, 0.0, 4_000_001 / 0.7413]
    assert [r.z for r in df.orderBy("i").collect()] == pytest.approx(want, rel=1e-12)


def test_every_baseline_has_a_z(spark):
    got = {r.stat_id: r.z for r in entry.queries()["robust_z_stats"](spark, SF).collect()}
    known = lambda v: v if v is not None and not math.isnan(v) else 0.0
    rows = duckdb.sql(f"select stat_id, median, mad from '{SF}/baseline_stats.parquet'").fetchall()
    want = {i: 0.0 if known(mad) <= 0 else (1.0 - known(med)) / (1.4826 * known(mad)) for i, med, mad in rows}
    assert got == pytest.approx(want, rel=1e-12) and len(got) == len(rows)


def test_documents_without_source_are_a_group(spark):
    for name in ("median_mad_by_source", "presence_intensity", "topk_excerpts", "nearest_rank_quantiles"):
        assert any(r[0] is None for r in entry.queries()[name](spark, SF).collect())
