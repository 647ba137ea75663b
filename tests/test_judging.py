import json

import pytest
from pyspark.sql import functions as F

from tracemill.functions import display
from tracemill.operators import census, judging


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def attempts(spark):
    a = [(1, "a", 1, "s", 0, 1, False, None), (2, "a", 1, "s", 0, 2, True, 2), (3, "a", 2, "s", 1, 1, False, None), (4, "a", 3, "s", 2, 1, False, None), (5, "a", 3, "s", 2, 2, False, None), (6, "a", 4, "t", 0, 1, True, 3), (7, "b", 1, "s", 0, 1, True, 0), (7, "b", 1, "s", 0, 1, True, 0)]
    return spark.createDataFrame([(*r, None) for r in a], "ledger_id long, pass_id string, sheet_position long, session_id string, block_index int, attempt int, valid boolean, score int, reason string")


def test_pass_scores_and_metrics(spark, attempts):
    got = rows(judging.pass_scores(attempts).select("pass_id", "session_id", "block_index", "sheet_position", "score"), "pass_id", "sheet_position")
    assert got == [("a", "s", 0, 1, 2), ("a", "s", 2, 3, None), ("a", "t", 0, 4, 3), ("b", "s", 0, 1, 0)]
    ref = spark.createDataFrame([("s", 0, 2), ("t", 0, 1), ("u", 9, 3)], "session_id string, block_index int, score int")
    m = {r.pass_id: r for r in judging.pass_metrics(attempts, ref).collect()}
    assert (m["a"].n_units, m["a"].n_complete, m["a"].n_scored, m["a"].mean_score, m["a"].n_pairs, m["a"].exact, m["a"].mean_difference) == (4, 3, 2, 2.5, 2, 0.5, 1.0)
    assert (m["b"].n_pairs, m["b"].exact) == (1, 0.0) and judging.pass_metrics(attempts.limit(0), ref).count() == 0


def test_bands_and_drop_rule(spark):
    df = spark.createDataFrame([(0.6,), (0.59,), (0.4,), (0.1,), (-1.0,), (None,)], "k double")
    assert [r.b for r in df.select(judging.band(F.col("k")).alias("b")).collect()] == ["substantial", "moderate", "moderate", "low", "low", None]
    n = spark.createDataFrame([(1, 10), (2, 10), (0, 0)], "f int, n int")
    assert [r.o for r in n.select(judging.over_threshold(F.col("f"), F.col("n")).alias("o")).collect()] == [False, True, False]


def test_histogram_and_files(spark):
    s = spark.createDataFrame([("a", "s", 0, 1), ("a", "s", 1, 3), ("b", "s", 0, None)], "pass_id string, session_id string, block_index int, score int")
    assert rows(judging.score_histogram(s, "pass_id"), "pass_id") == [("a", 0, 1, 0, 1, 2), ("b", 0, 0, 0, 0, 0)]
    p = spark.createDataFrame([("s", 0, "x"), ("s", 0, "x"), ("s", 0, "y"), ("s", 1, "x")], "session_id string, block_index int, path string")
    assert rows(judging.scores_by_file(s, p), "path") == [("x", 2, 2.0), ("y", 1, 1.0)]


def test_bootstrap_difference(spark):
    v = spark.createDataFrame([("a", float(i % 3)) for i in range(300)] + [("b", float(i % 2)) for i in range(300)] + [("c", 9.0), ("a", None)], "g string, v double")
    r = judging.bootstrap_difference(v, "g", "v", "a", "b", resamples=4000).first()
    assert r.difference == pytest.approx(0.5) and r.low < 0.5 < r.high and 0.35 < r.low and r.high < 0.65
    assert judging.bootstrap_difference(v.limit(0), "g", "v", "a", "b").first().difference is None


def test_sessions_pools_and_draws(spark, tmp_path):
    d = spark.createDataFrame([("s1", 0.5), ("s2", 0.5), ("s3", 0.1), ("s4", 0.0), ("s5", None)], "session_id string, density double")
    assert rows(judging.hot_calm(d, "session_id", "density", 2, 3), "kind", "rank") == [("s4", 0.0, "calm", 1), ("s3", 0.1, "calm", 2), ("s1", 0.5, "hot", 1), ("s2", 0.5, "hot", 2)]
    b = spark.createDataFrame([("c", f"s{i % 7}", i, i % 3 == 0, None) for i in range(70)] * 2 + [("c", None, 1, True, True)], "corpus string, session_id string, block_index int, marked boolean, attached boolean")
    pool = judging.pool(b, spark.createDataFrame([("s0",)], "session_id string"))
    assert pool.count() == 60
    got = judging.draw(pool, random=10, oversample=5, reserve=3, relabel=4).collect()
    by = {k: [r for r in got if r.stratum == k] for k in ("random", "oversample", "random_reserve", "oversample_reserve")}
    assert [len(by[k]) for k in by] == [10, 5, 3, 3] and sorted(r.sheet_position for r in by["random"] + by["oversample"]) == list(range(1, 16))
    assert sum(r.relabelled for r in got) == 4 and len({(r.session_id, r.block_index) for r in by["random"] + by["oversample"]}) == 15
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, judging.draw(pool.repartition(3), 10, 5, 3, 4).collect()), key=str)
    text = b.filter("session_id is not null").select("session_id", "block_index", F.concat_ws("/", "session_id", "block_index").alias("text")).distinct()
    wanted = spark.createDataFrame(by["random"])
    sheet = judging.blocks_of(text, wanted)
    assert all(r.text == f"{r.session_id}/{r.block_index}" for r in sheet.collect())
    with pytest.raises(Exception, match="no block for"):
        judging.blocks_of(text, spark.createDataFrame([("zz", 1)], "session_id string, block_index int")).collect()
    h = judging.sheet_hash(sheet, "sheet_position", "text").first()
    assert h.n == 10 and h == judging.sheet_hash(sheet.repartition(3), "sheet_position", "text").first()
    assert judging.write_sheet(sheet, str(tmp_path / "sheet"), ["sheet_position", "text"], ["sheet_position"]) == 10
    a = judging.anchor_units(text, spark.createDataFrame([("s1",), ("s2",), ("none",)], "session_id string"), least=5)
    assert [r.sheet_position for r in a.orderBy("session_id", "block_index").collect()] == list(range(1, 21))
    agents = spark.createDataFrame([("f", f"a{i % 4}", f"k{i}") for i in range(40)] + [("g", "b", "x")], "family string, agent string, key string")
    drawn = judging.draw_by_agent(agents, "family", "agent", "key", {"f": 3, "g": 2}, 7).collect()
    assert sorted((r.family, r["rank"]) for r in drawn) == [("f", 1), ("f", 2), ("f", 3), ("g", 1)] and len({r.agent for r in drawn}) == 4


def test_manifests_and_prompts(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("a")
    h = rows(judging.file_hashes(spark, str(tmp_path / "x")))
    assert len(h) == 1 and len(h[0][1]) == 64
    m = spark.createDataFrame([(f"{h[0][1]}  d/a b.txt",), ("# note",), ("",), ("junk",)], "value string")
    assert rows(judging.read_hashes(m)) == [("d/a b.txt", h[0][1]), ("junk", None)]
    assert judging.update_manifest(str(tmp_path), {"a": 1}) == {"a": 1} and judging.update_manifest(str(tmp_path), {"b": 2}) == {"a": 1, "b": 2}
    assert len(judging.write_seal(str(tmp_path / "seal"), {"draw": 18}, {"pool": 60}, [str(tmp_path / "x" / "a.txt")])) == 64 and "seed draw 18" in (tmp_path / "seal").read_text()
    assert judging.split_prompt("a\n---\nb", "---") == ("a", "b")
    with pytest.raises(ValueError):
        judging.split_prompt("a", "---")
    assert [r.prompt for r in judging.prompts(spark.createDataFrame([("{x}",), (None,)], "text string"), "<", ">").collect()] == ["<{x}>", "<>"]
    c = spark.createDataFrame([("a", 1, 5, "late"), ("a", 2, 3, "early")], "p string, n int, t int, note string")
    assert rows(judging.merge_counters(c, "p", ["n"], "t", "note")) == [("a", 3, 3, ["early", "late"])]


def test_census(spark):
    e = spark.createDataFrame([("t", i, p, a) for i, (p, a) in enumerate([("x.py", "open x.py"), (None, "cat y.py"), ("x.py", "ls"), ("y.py", "end"), ("q", "x.py")])], "k string, i long, p string, a string")
    assert [r.beside for r in census.named_beside(e, "k", "i", F.col("p"), F.col("a")).orderBy("i").collect()] == ["neither", "no_name", "neither", "neither", "neither"]
    e = spark.createDataFrame([("t", 0, None, "y.py"), ("t", 1, "y.py", "-"), ("t", 2, "y.py", "y.py"), ("t", 3, "", "y.py")], "k string, i long, p string, a string")
    assert [r.beside for r in census.named_beside(e, "k", "i", F.col("p"), F.col("a")).orderBy("i").collect()] == ["no_name", "both", "next", "no_name"]
    s = spark.createDataFrame([(["a", "c"], ["a", "b", "c"]), (["c", "a"], ["a", "b", "c"]), ([], ["a"]), (["a"], []), (["a", "a"], ["a", "a"])], "p array<string>, w array<string>")
    assert [r[0] for r in s.select(census.ordered_containment(F.col("p"), F.col("w"))).collect()] == [True, False, True, False, True]
    a, b = (spark.createDataFrame(x, "k int, v string, w int") for x in ([(1, "a", 1), (2, None, 2), (3, "x", 1)], [(1, "a", 5), (2, None, 2), (4, "y", 0)]))
    assert rows(census.column_differences(a, b, ["k"], ["v", "w"]), "column") == [("v", 2, 0), ("w", 2, 1)]
    assert rows(census.same_rows(a, b)) == [(2, 2, False)] and rows(census.same_rows(a, a.unionByName(a))) == [(0, 0, True)]
    u = spark.createDataFrame([("t1", 1, "terminal"), ("t1", 2, "in-step"), ("t2", 1, "free-standing")], "t string, n_fragments int, emission_kind string")
    assert rows(census.fragment_multiplicity(u), "n_fragments") == [(1, 2), (2, 1)]
    assert rows(census.presence(u, spark.createDataFrame([("t1",), ("t2",), ("t3",)], "t string"), "t")) == [(3, 2, 3, 2 / 3, 1.5)]
    r = {(x.grp, x.total): (x.n_units, x.n_terminal, x.n_free) for x in census.unit_rates(u, F.col("t")).collect()}
    assert r == {("t1", 0): (2, 1, 0), ("t2", 0): (1, 0, 1), (None, 1): (3, 1, 1)}
    t = spark.createDataFrame([("g", "a"), ("g", "a"), ("g", "b"), ("h", None)], "g string, t string")
    assert [(x.g, x.n, x["rank"]) for x in census.duplicates(t, "g", "t").collect()] == [("g", 2, 1)]
    assert ("TOTAL", "TOTAL", 4) in rows(census.census(t, "g", "t")) and ("g", "TOTAL", 3) in rows(census.census(t, "g", "t")) and ("h", None, 1) in rows(census.census(t, "g", "t"))
    f = spark.createDataFrame([("```\nx\n```",), ("```\n<think>a</think></think>",), (None,)], "t string")
    assert rows(census.fence_census(f, "t")) == [(2, 2, 1, 1, 2, 1)]
    assert rows(census.key_sets(spark.createDataFrame([('{"b": 1, "a": 2}',), ("[1]",), (None,)], "p string"), "p"), F.col("keys").desc_nulls_last()) == [("a,b", 1), (None, 2)]


def test_display(spark, tmp_path):
    p = spark.createDataFrame([("/Users/x/ai-map/src/a.py",), ("/home/y/b",), ("/proj/c",)], "path string")
    root = display.strip_roots(p, "-Users-x-ai-map").first().root
    assert root == "/Users/x/ai-map" and display.strip_roots(p, "-Users-x-ai").first().root is None and display.strip_roots(p, "-").first().root is None
    assert [r[0] for r in p.select(display.display_path(F.col("path"), F.lit(root))).collect()] == ["src/a.py", "~/b", "/proj/c"]
    assert [r[0] for r in p.limit(1).select(display.codebase_name(F.lit(None).cast("string"), "-a-b-map")).collect()] == ["map"]
    text = "see /Users/bob/x and /home/al wait"
    h = spark.createDataFrame([(text, [(0, 3, "see"), (text.index("wait"), len(text), "wait")])], "t string, h array<struct<start:int,end:int,marker:string>>")
    r = h.select(display.redacted(F.col("t"), F.col("h")).alias("r")).first().r
    assert r.text == "see ~/x and ~ wait" and [r.text[x.start : x.end] for x in r.highlights] == ["see", "wait"]
    s = spark.createDataFrame([("abcdef12-3", "One"), ("ffff0000-1", "abcdef12 two")], "session_id string, title string")
    assert [(x.session_id, x.matched_by) for x in display.match_session(s, "ABCDEF12").collect()] == [("abcdef12-3", "uuid")]
    assert [(x.session_id, x.matched_by) for x in display.match_session(s, "TWO").collect()] == [("ffff0000-1", "title")] and display.match_session(s, "nope").count() == 0
    n = spark.createDataFrame([(1.234, 1, 8), (0.5, 0, 0), (None, 1, 3)], "x double, p int, w int")
    assert [tuple(r) for r in n.select(display.shown_number(F.col("x")), display.percentage(F.col("p"), F.col("w"))).collect()] == [("1.23", "12.5 %"), ("0.500", "–"), ("–", "33.3 %")]
    assert display.markdown_table(s, ["session_id", "title"], ["session_id"]).splitlines()[2] == "| abcdef12-3 | One |"
    j = spark.createDataFrame([('{"a": "xxxxx", "b": [1, {"c": "yyyy"}]}',), ("{",), (None,)], "j string")
    assert [r[0] and json.loads(r[0]) for r in j.select(display.shortened_json(F.col("j"), 3)).collect()] == [{"a": "xxx…", "b": [1, {"c": "yyy…"}]}, None, None]
    assert [r[0] for r in j.select(display.json_arguments(F.col("j"))["a"]).collect()] == ["xxxxx", None, None]
    t = spark.createDataFrame([("One. Two!  Three 3.5 is it? tail",), ("",), (None,)], "t string").select("t", display.sentences(F.col("t")).alias("s"))
    r = t.select("t", "s", display.sentence_of(F.col("s"), F.lit(12)).alias("n"), display.sentence_of(F.col("s"), F.lit(4)).alias("gap")).collect()
    assert [x.text for x in r[0].s] == ["One.", "Two!", "Three 3.5 is it?", "tail"] and all(r[0].t[x.start : x.end] == x.text for x in r[0].s) and r[0].n == 2 and r[0].gap is None and r[1].s == []
    (tmp_path / "home" / "-a-b").mkdir(parents=True)
    assert display.sessions_folder("/a/b/c", str(tmp_path / "home")).name == "-a-b"
    with pytest.raises(FileNotFoundError):
        display.sessions_folder("/q", str(tmp_path / "home"))
    (tmp_path / ".skip").write_text("")
    assert display.ignore_file(str(tmp_path / "home"), ".skip") == tmp_path / ".skip" and display.ignore_file("/", ".none-such") is None
