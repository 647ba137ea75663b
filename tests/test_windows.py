"""Windows and detectors against a walk over lists, with buckets so small that every edge is met."""

import random

from pyspark.sql import functions as F

from tracemill.operators import behaviour, scoring, stats, windows
from tracemill.operators import attribution, joins, sampling, units


def events(n=400, seed=3):
    r = random.Random(seed)
    rows, at = [], {}
    for i in range(n):
        s = r.choice("aaab")
        k = at[s] = at.get(s, -1) + 1
        rows.append((i, s, k // 50, k, r.choice(["view", "edit", "run", "error"]), r.choice("xyz"), r.choice(["c 1", "c 12", "d 1", None]), r.random() < 0.4))
    return rows


SCHEMA = "event_id int, session string, segment_id int, event_index long, kind string, path string, command string, errored boolean"


def test_halo_windows_equal_brute_force(spark, monkeypatch):
    rows = events()
    real = windows.with_halo
    small = lambda e, reach, bucket=16: real(e, reach, bucket)
    monkeypatch.setattr(windows, "with_halo", small)
    monkeypatch.setattr(behaviour, "with_halo", small)
    df = spark.createDataFrame(rows, SCHEMA)
    keys = ["session", "segment_id"]
    same = lambda a, b: a[1:3] == b[1:3]
    near = lambda a, lo, hi: [b for b in rows if same(a, b) and lo <= b[3] - a[3] <= hi]
    got = {r.event_id for r in windows.bursts(df.filter("kind = 'view'"), [*keys, "path"]).filter("burst").collect()}
    assert got == {a[0] for a in rows if a[4] == "view" and sum(b[4] == "view" and b[5] == a[5] for b in near(a, -5, 5)) > 1}
    got = {r.event_id: r.coupled for r in windows.coupling(df, keys, F.col("kind") == "run").collect()}
    assert got == {a[0]: any(b[4] == "run" for b in near(a, -3, 3)) for a in rows}
    got = {r.event_id: (r.nearest_path, r.nearest_distance) for r in windows.nearest_path(df, keys, F.when(F.col("kind") == "edit", F.col("path"))).collect()}
    for a in rows:
        c = sorted((abs(b[3] - a[3]), b[3], b[5]) for b in near(a, -3, 3) if b[4] == "edit" and b[3] != a[3])
        assert got[a[0]] == ((c[0][2], c[0][0]) if c else (None, None))
    fail = behaviour.edit_failures(df, keys, F.col("kind") == "edit", F.col("kind") == "view", F.col("errored"))
    assert {r.event_id for r in fail.collect()} == {a[0] for a in rows if a[4] == "edit" and (a[7] or any(b[4] == "view" and b[5] == a[5] for b in near(a, 1, 3)))}
    retry = behaviour.bash_retries(df.filter("command is not null"), keys)
    got = {r.event_id: r.retry_index for r in retry.collect()}
    want = {}
    for a in rows:
        if a[6] and a[7]:
            c = [b[3] for b in near(a, 1, 3) if b[6] and b[6].split()[0] == a[6].split()[0] and not (b[6].startswith(a[6]) and len(b[6]) > len(a[6]))]
            if c:
                want[a[0]] = min(c)
    assert got == want
    ref = behaviour.grep_reformulations(df.withColumn("scope", F.col("path")).withColumn("pattern", F.col("command")), keys)
    assert {r.event_id for r in ref.collect()} == {a[0] for a in rows if any(b[5] == a[5] and b[6] != a[6] for b in near(a, 1, 3))}


def test_ordinals_and_carry(spark):
    df = spark.sql("select id as event_id, case when id % 3 = 0 then 'hot' else 'b' end as s, timestamp_seconds(id * 86400 * 3) as ts, id % 7 = 0 as b, case when id % 5 = 0 then id end as v from range(100)")
    rows = sorted(windows.ordinals(df, "s", "ts", "event_id", F.col("b"), slice_seconds=86_400 * 10).collect(), key=lambda r: (r.s, r.event_id))
    for s in ("hot", "b"):
        mine = [r for r in rows if r.s == s]
        assert [r.event_index for r in mine] == list(range(len(mine)))
        seg = 0
        for r in mine:
            seg += r.b
            assert r.segment_id == seg
    ix = windows.ordinals(df, "s", "ts", "event_id", F.col("b"))
    got = {r.event_id: r.open for r in windows.carry_forward(ix, "s", F.col("v"), "open").collect()}
    for s in (0, 1):
        last = None
        for i in (i for i in range(100) if (i % 3 == 0) == (s == 0)):
            last = i if i % 5 == 0 else last
            assert got[i] == last


def test_stats(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", None)], "g string, v double")
    got = {r.g: (r.median, r.mad, r.n) for r in stats.median_mad(df, ["g"], "v").collect()}
    assert got == {"a": (2.0, 1.0, 3), "b": (0.0, 0.0, 0)}
    pairs = spark.createDataFrame([(0, 0), (1, 1), (2, 3), (3, 2), (1, 0)], "a int, b int")
    k = stats.kappa_of(pairs.groupBy().agg(*stats.weighted_kappa(pairs, "a", "b", [0, 1, 2, 3])), [0, 1, 2, 3], []).first()
    n = [(0, 0), (1, 1), (2, 3), (3, 2), (1, 0)]
    obs = sum((x - y) ** 2 for x, y in n) / 5
    exp = sum((x - y) ** 2 for x, _ in n for _, y in n) / 25
    assert abs(k.kappa - (1 - obs / exp)) < 1e-9
    b = stats.bootstrap_kappa(pairs, "a", "b", 2000).first()
    assert b.low <= b.kappa <= b.high and abs(b.kappa - k.kappa) < 1e-9
    assert stats.kappa_of(pairs.filter("a = 1 and b = 1").groupBy().agg(*stats.weighted_kappa(pairs, "a", "b", [0, 1])), [0, 1], []).first().kappa is None
    assert df.agg(stats.guarded_corr("v", "v").alias("r")).first().r > 0.99
    assert df.filter("v = 1").agg(stats.guarded_corr("v", "v").alias("r")).first().r == 0


def test_units(spark):
    rows = [("s", 0, False, "a"), ("s", 1, False, " "), ("s", 2, False, "bé"), ("s", 3, True, None), ("s", 4, True, None), ("s", 5, False, "Exit due to x"), ("s", 6, False, "end")]
    df = spark.createDataFrame(rows, "k string, o int, act boolean, t string")
    got = {r.unit: r for r in units.recovered(units.anchor(df, "k", "o", F.col("act"), "t", harness_prefixes=("Exit due to",))).collect()}
    assert got[0].unit_text == "a\n\nbé" and got[0].recovered == ["a", "bé"] and got[0].emission_kind == "free-standing"
    assert got[2].emission_kind == "terminal" and got[2].unit_text == "end" and 1 not in got
    same = units.anchor(df.withColumn("c", F.lit(1)), "k", "o", F.col("act"), "t", "c").filter("unit = 0").first()
    assert same.emission_kind == "in-step"


def test_attribution_and_ignore(spark):
    ev = spark.createDataFrame([("s", "/w/src/a.py"), ("s", "/w/lib/b.py"), ("s", "/w/x/b.py"), ("s", "/w/only.md")], "session_id string, path string")
    bl = spark.createDataFrame([("s", 1, "see src/a.py and b.py"), ("s", 2, "only.md, then a.py"), ("s", 3, "nothing"), ("t", 4, "src/a.py"), ("s", 5, None)], "session_id string, block_id int, text string")
    prox = spark.createDataFrame([(3, ["/w/z.py", "/w/y.py"]), (4, [])], "block_id int, nearest_paths array<string>")
    got = {r.block_id: (r.tier, r.file_paths) for r in attribution.attribute(bl, ev, proximity=prox).collect()}
    assert got == {1: ("exact_path", ["/w/src/a.py"]), 2: ("unique_basename", ["/w/only.md", "/w/src/a.py"]), 3: ("temporal_proximity", ["/w/z.py", "/w/y.py"]), 4: (None, None), 5: (None, None)}
    paths = spark.createDataFrame([("a/b.log",), ("logs/x.txt",), ("keep.log",), ("src/gen/z.py",), ("deep/src/gen/z.py",), ("docs/a/b/c.md",)], "p string")
    out = [r.p for r in paths.filter(attribution.user_ignored(F.col("p"), ["*.log", "!keep.log", "logs/", "/src/gen", "docs/**/c.md", "", "# x"])).collect()]
    assert out == ["a/b.log", "logs/x.txt", "src/gen/z.py", "docs/a/b/c.md"]


def test_joins_sampling_scoring(spark):
    b = spark.createDataFrame([("s", 1, "tool_use", "Read", "u", None), ("s", 2, "tool_result", None, "u", "r1"), ("s", 3, "tool_use", "Edit", "u", None), ("s", 4, "tool_result", None, "u", "r2"), ("s", 5, "tool_result", None, "u", "r3"), ("s", 6, "tool_use", "Bash", "v", None)], "session_id string, position int, block_type string, tool_name string, tool_use_id string, block_text string")
    got = {(r.tool_name, r.result_text) for r in joins.tool_calls(b).collect()}
    assert got == {("Read", "r1"), ("Edit", "r3"), ("Bash", None)}
    df = spark.range(1000).withColumn("g", F.col("id") % 2)
    assert {r.g: r["count"] for r in sampling.stratified(df, "g", "id", 7).groupBy("g").count().collect()} == {0: 7, 1: 7}
    assert [r.id for r in sampling.systematic(spark.range(101), "id", 50).orderBy("id").collect()] == list(range(0, 101, 3))
    sc = spark.createDataFrame([(f"f{i}", x) for i, x in enumerate([0.9, 0.4, 0.3] + [0.2] * 9)], "path string, score double")
    assert tuple(scoring.corpus_mode(sc).first()) == ("healthy", 12, 12, 1)
    assert scoring.corpus_mode(sc.filter("score > 5")).first().mode == "empty"
