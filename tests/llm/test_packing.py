import random
from collections import Counter

import pytest

from tracemill.llm import packing as P


def check(rows, sizes, windows):
    for name, cap in windows.items():
        mine = [r for r in rows if r.window_name == name]
        fill = Counter()
        parts = {}
        for r in mine:
            if r.window_id is not None:
                fill[r.window_id] += r.n_tokens
            parts.setdefault(r.item_id, []).append((r.start_token, r.n_tokens))
        assert max(fill.values(), default=0) <= cap
        want = Counter()
        for i, n in sizes:
            want[i] += n or 0
        assert {i: sum(n for _, n in p) for i, p in parts.items()} == dict(want)
        for i, n in sizes:
            if (n or 0) <= cap:
                assert len(parts[i]) == sum(1 for j, _ in sizes if j == i)
            else:
                assert sorted(x for _, x in parts[i])[1:] == [cap] * (len(parts[i]) - 1) or len(parts[i]) == 1
        total = sum(fill.values())
        yield name, len(fill), -(-total // cap)


def test_whole_and_full(spark, monkeypatch):
    monkeypatch.setattr(P, "MERGE_ROWS", 40)
    r = random.Random(2)
    sizes = [(i, int(r.paretovariate(0.8) * 20)) for i in range(3000)] + [(5000, 0), (5001, None), (5002, 7000), (5003, 512)]
    df = spark.createDataFrame(sizes, "item_id long, n_tokens long").repartition(6)
    windows = {"s": 512, "l": 2048}
    rows = P.pack(df, windows).collect()
    for name, used, least in check(rows, sizes, windows):
        assert used <= least * 1.03 + 2, name
    rep = {r.window_name: r for r in P.fill_report(P.pack(df, windows)).collect()}
    assert rep["s"].fill > 0.95 and rep["s"].n_items == 3004


def test_empty_and_bad(spark):
    df = spark.createDataFrame([], "item_id long, n_tokens long, window_name string")
    assert P.pack(df, {"w": 10}).count() == 0
    with pytest.raises(ValueError):
        list(P.pack_partition(iter([]), {"w": 0}, 0))
    same = spark.createDataFrame([(1, 5)] * 4, "item_id long, n_tokens long")
    assert P.pack(same, {"w": 10}).count() == 4


def test_open_windows():
    w = P.OpenWindows(10, "x", limit=2)
    assert [w.place(n) for n in (6, 7, 4, 3, 9)] == [0, 1, 0, 1, 2]
    assert sorted(w.closed) == [0, 1]
