import numpy as np

from tracemill.llm import consensus as C


def simulated(n_units=600, seed=3):
    rng = np.random.default_rng(seed)
    truth = rng.choice(4, n_units, p=[0.4, 0.3, 0.2, 0.1])
    kinds = C.prototypes()
    raters = {"good1": 0, "good2": 0, "fair": 1, "fair2": 1, "high": 2, "low": 3, "reversed": 5, "spam1": 6, "spam2": 6, "spam3": 6, "rare": 0}
    rows = []
    for u, t in enumerate(truth):
        for name, kind in raters.items():
            if rng.random() < (0.02 if name == "rare" else 0.5):
                rows.append((f"u{u}", name, int(rng.choice(4, p=kinds[kind][t]))))
    return truth, rows


def test_truth_is_found_beyond_majority(spark):
    truth, rows = simulated()
    labels = spark.createDataFrame(rows, "unit string, rater string, label int")
    f = C.fit(labels)
    got = {r.unit: r.label for r in f.units.collect()}
    assert set(got) == {r[0] for r in rows}
    acc = np.mean([got[u] == truth[int(u[1:])] for u in got])
    vote = {}
    for u, _, x in rows:
        vote.setdefault(u, []).append(x)
    majority = np.mean([np.bincount(v).argmax() == truth[int(u[1:])] for u, v in vote.items()])
    assert acc > 0.85 and acc > majority + 0.1
    rel = {r.rater: r for r in f.raters.collect()}
    assert rel["good1"].accuracy > 0.85 and rel["spam1"].information_bits < 0.15 and rel["high"].bias > 0.4 and rel["low"].bias < -0.3
    assert rel["rare"].accuracy > rel["spam1"].accuracy
    joined = C.fit(labels, rounds=8, max_broadcast=0)
    again = {r.unit: r.label for r in joined.units.collect()}
    assert np.mean([again[u] == got[u] for u in got]) > 0.97 and joined.raters.count() == len(rel)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "unit string, rater string, label int")
    assert C.fit(empty).units.count() == 0 and C.fit(empty).raters.count() == 0
    one = C.fit(spark.createDataFrame([("u", "r", 3)], "unit string, rater string, label int"))
    assert one.units.first().label == 3
    assert C.agreement(empty).first().n_units == 0


def test_labels_of_all_sources(spark):
    a = spark.createDataFrame([("p", "s", 0, 2, True, 1), ("p", "s", 0, 1, False, 3), ("p", "s", 0, 3, True, 0), ("p", "s", 1, 1, True, 9), (None, "s", 1, 1, True, 1), ("q", None, 1, 1, True, 1), ("q", "s", 1, 1, None, 1)], "pass_id string, session_id string, block_index int, attempt int, valid boolean, score int")
    p = spark.createDataFrame([("s", 0, 2), ("s", 0, 2), ("s", 2, None)], "session_id string, block_index int, score int")
    h = spark.createDataFrame([("s", 0, "h", 1), ("s", 0, "h", 1), ("s", 3, "h", 4)], "session_id string, block_index int, rater_id string, relabel_score int")
    got = {(r.session_id, r.block_index, r.rater, r.label) for r in C.score_labels(a, p, h).collect()}
    assert got == {("s", 0, "p", 1), ("s", 0, "v1-pass1", 2), ("s", 0, "h", 1)}


def test_alpha(spark):
    rows = [("u1", "a", 0), ("u1", "b", 0), ("u2", "a", 1), ("u2", "b", 2), ("u3", "a", 3), ("u3", "b", 3), ("u4", "a", 1)]
    r = C.agreement(spark.createDataFrame(rows, "unit string, rater string, label int")).first()
    x = [0, 0, 1, 2, 3, 3]
    do = (0 + 2 + 0) / 6
    de = sum(a != b for i, a in enumerate(x) for j, b in enumerate(x) if i != j) / (6 * 5)
    assert abs(r.alpha_nominal - (1 - do / de)) < 1e-9 and r.n_units == 3


def test_both_paths_stop_alike(spark):
    r = np.random.default_rng(4)
    rows = [(f"u{i}", f"r{j}", int(np.clip(i % 4 + r.choice([-1, 0, 0, 0, 1]), 0, 3))) for i in range(60) for j in r.choice(9, 3, replace=False)]
    labels = spark.createDataFrame(rows, "unit string, rater string, label int")
    a, b = C.fit(labels, rounds=6, tolerance=0.1), C.fit(labels, rounds=6, tolerance=0.1, max_broadcast=0)
    assert 1 < a.rounds == b.rounds < 6
    x, y = ({u.unit: u.posterior for u in f.units.collect()} for f in (a, b))
    assert x.keys() == y.keys() and all(np.allclose(x[u], y[u], atol=1e-6) for u in x)
