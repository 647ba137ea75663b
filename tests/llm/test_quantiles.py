import numpy as np
import pytest

from tracemill.llm import quantiles as Q


@pytest.mark.parametrize("kind", ["normal", "ties", "pareto", "sorted", "two"])
def test_digest_error_and_merge(kind):
    rng = np.random.default_rng(4)
    x = {"normal": rng.normal(size=60_000), "ties": rng.integers(0, 5, 60_000).astype(float), "pareto": rng.pareto(0.7, 60_000), "sorted": np.arange(60_000.0), "two": np.repeat([1.0, 9.0], 30_000)}[kind]
    parts = [Q.compress(p, np.ones(len(p))) for p in np.array_split(x, 37)]
    m, w = Q.compress(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    assert w.sum() == len(x) and len(m) <= 2 * Q.DELTA
    for q in (0.001, 0.01, 0.25, 0.5, 0.9, 0.999):
        e = Q.quantile(m, w, x.min(), x.max(), np.array([q]))[0]
        lo, hi = (x < e).mean(), (x <= e).mean()
        assert max(lo - q, q - hi, 0) < Q.BOUND, (kind, q)


def frame(spark, rows):
    return spark.createDataFrame(rows, "value double, g string, estimates int, dimension string")


def test_percentiles_certified(spark):
    rng = np.random.default_rng(1)
    rows = [(float(v), "ab"[i % 3 == 0], 1, "x") for i, v in enumerate(rng.lognormal(size=9000))] + [(None, "a", 1, "x"), (float("nan"), "a", 1, "x"), (float("inf"), "c", 1, "x"), (7.0, None, 1, "x"), (7.0, None, 1, "x"), (3.0, "one", 1, "x")]
    out = Q.percentiles(frame(spark, rows).repartition(5), ["g"]).collect()
    assert all(r.certified for r in out) and {r.group_key for r in out} == {"a", "b", None, "one"}
    for g in "ab":
        x = np.sort([r[0] for r in rows if r[1] == g and r[0] is not None and np.isfinite(r[0])])
        for r in (r for r in out if r.group_key == g):
            assert r.n == len(x) and r.rank_low == (x < r.estimate).sum() and r.rank_high == (x <= r.estimate).sum()
    assert {r.estimate for r in out if r.group_key is None} == {7.0} and {r.estimate for r in out if r.group_key == "one"} == {3.0}
    assert Q.percentiles(frame(spark, []), ["g"]).count() == 0


def test_days_merge_and_mad(spark):
    rng = np.random.default_rng(2)
    rows = [(float(v), "k", f"d{i % 5}") for i, v in enumerate(rng.normal(10, 3, 5000))]
    df = spark.createDataFrame(rows, "value double, k string, day string")
    days = Q.daily_digests(df, "day", "k")
    assert days.count() == 5
    merged = Q.percentiles(df, ["k"], (0.5,), built=Q.merge_digests(days.drop("day"))).first()
    assert merged.certified and abs(merged.estimate - 10) < 0.3
    x = np.array([r[0] for r in rows])
    m = Q.mad(df, "k").first()
    assert abs(m.mad - np.median(np.abs(x - np.median(x)))) < 0.05


def test_each_block_once(spark):
    df = spark.sql("select * from values (1L, 5, 'f', 'c', date'2026-01-01', timestamp'2026-01-01'), (1L, 5, 'f', 'c', date'2026-01-01', timestamp'2026-01-02'), (2L, -1, 'f', 'c', null, null), (3L, null, 'f', 'c', null, null), (null, 4, null, null, null, null) as t(block_id, length_words, file_path, corpus, obs_date, loaded_at)")
    assert sorted(r.value for r in Q.block_lengths(df).collect()) == [4.0, 5.0]
