import math
import random
import re
import json

from pyspark.sql import functions as F

from tracemill.functions import complexity, judge, shell, text
from tracemill.operators import report, units
from tracemill.sources import session_log, trajectory
from tracemill.streaming import sessions


def line(**k):
    return json.dumps(k)


def test_session_files(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text("\n".join([line(type="user", sessionId="S1", message={"content": "hi"}), "", "{broken", "[1]", line(type="wat"), line(type="ai-title", aiTitle="T1"), line(type="ai-title", aiTitle="T2"), line(type="last-prompt", lastPrompt="P")]))
    (tmp_path / "a.jsonl").write_text(line(type="system", subtype="compact_boundary"))
    ev, rejects = session_log.events(session_log.read_lines(spark, str(tmp_path)))
    got = [(r.session_id, r.event_index, r.type) for r in ev.orderBy("file_name", "event_index").collect()]
    assert got == [("a", 0, "system"), ("S1", 0, "user"), ("S1", 1, "ai-title"), ("S1", 2, "ai-title"), ("S1", 3, "last-prompt")]
    assert sorted(r.reason for r in rejects.collect()) == ["malformed", "malformed", "unknown_type"]
    assert {r.session_id: r.title for r in session_log.titles(ev).collect()} == {"a": None, "S1": "T2"}
    again, _ = session_log.events(session_log.read_lines(spark, str(tmp_path), splittable=True))
    assert [(r.session_id, r.event_index, r.type) for r in again.orderBy("file_name", "event_index").collect()] == got
    assert session_log.listing(spark, str(tmp_path), 12).count() == 2


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.jsonl").write_text("\n".join(line(type="user", sessionId="s", timestamp=f"2026-01-01T{h}:00:00Z") for h in ("10", "11")) + "\n" + line(type="nope"))
    q = sessions.activity(sessions.read_session_stream(spark, str(src))).writeStream.format("memory").queryName("act").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("act").count() == 2
    u = tmp_path / "units"
    spark.createDataFrame([("u1", "x"), ("u2", "y")], "unit_id string, text string").write.parquet(str(u))
    score = lambda df: df.select("unit_id", F.lit(1).alias("attempt"), (F.col("unit_id") == "u1").alias("valid"), F.lit(2).alias("score"))
    for n in range(3):
        st = spark.readStream.schema("unit_id string, text string").parquet(str(u))
        sessions.scoring_pass(st, score, str(tmp_path / "ledger"), str(tmp_path / f"ck{n}")).awaitTermination(60)
    got = {r.unit_id: r["count"] for r in spark.read.parquet(str(tmp_path / "ledger")).groupBy("unit_id").count().collect()}
    assert got == {"u1": 1, "u2": 2}


def test_trajectories(spark, tmp_path):
    (tmp_path / "a__b-1.traj").write_text(json.dumps({"trajectory": [{"thought": "t0", "action": "open f.py"}, {"thought": "t1", "action": " "}]}))
    (tmp_path / "a__b-1.json").write_text("{}")
    (tmp_path / "readme.json").write_text("{}")
    files, bad = trajectory.discover(spark, str(tmp_path))
    assert [r.stem for r in files.collect()] == ["a__b-1"] and sorted(r.reason for r in bad.collect()) == ["duplicate_stem", "not_an_instance"]
    ev = trajectory.events(files, "thought")
    assert [(r.kind, r.text) for r in ev.orderBy("container", "sub").collect()] == [("emission", "t0"), ("action", None), ("emission", "t1")]
    u = units.anchor(ev.withColumn("o", F.struct("container", "sub")), "stem", "o", F.col("kind") == "action", "text", "container")
    assert {(r.unit, r.emission_kind) for r in u.collect()} == {(0, "in-step"), (1, "terminal")}
    call = [{"function": {"name": "bash", "arguments": "{}"}}]
    bodies = {
        "epam": [{"z": {"author_name": "Thoughts", "message": "m"}, "a": {"author_name": "Tool", "input_text": "{'p': 1}"}}],
        "sage": {"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": "THOUGHT: why\n```bash\nls\n```"}]},
        "trae": [{"role": "assistant", "content": "<think>a</think>b</think> <function=run>x</function> <function=open>"}],
        "sonar": [{"role": "assistant", "blocks": [{"block_type": "thinking", "content": "c"}], "additional_kwargs": {"tool_calls": call}}],
        "think_tool": [{"role": "assistant", "content": "", "tool_calls": [{"function": {"name": "think", "arguments": '{"thought": "d"}'}}, *call]}],
    }
    want = {"epam": "m", "sage": " why\n", "trae": "a</think>b", "sonar": "c", "think_tool": "d"}
    for family, body in bodies.items():
        df = spark.createDataFrame([("s", json.dumps(body))], "stem string, body string")
        rows = trajectory.events(df, family).orderBy("container", "sub").collect()
        assert [(r.kind, r.text) for r in rows] == [("emission", want[family]), ("action", None)], family
        assert df.filter(trajectory.shape_matches(family, F.col("body"))).count() == 1
        assert df.withColumn("body", F.lit("{")).filter(trajectory.shape_matches(family, F.col("body"))).count() == 0


def test_paths_of_commands():
    paths = lambda line: shell.paths_of(line)
    # readers give all operands but numbers, whatever folder they were started from
    assert paths("cd notes && cd deep; less intro.md appendix.md") == ["intro.md", "appendix.md"]
    assert paths("/usr/bin/tail --lines 7 --bytes 9 run/out.txt 12") == ["run/out.txt"]
    # a search's first operand is its pattern unless an option brings it
    assert paths("rg -t toml version conf lib") == ["conf", "lib"]
    assert paths("rg --regexp version conf") == ["conf"]
    assert paths("grep -A 3 'two words' 'my file.txt'") == ["my file.txt"]
    assert paths("awk -F , -f sums.awk table.csv") == ["table.csv"] and paths("awk 'NR>1 && $2' table.csv") == ["table.csv"]
    assert paths("sed --expression s/x/y/ -n one.ini two.ini") == ["one.ini", "two.ini"] and paths("grep alone") == []
    # an interpreter gives its script only
    assert paths("LANG=C TZ=UTC python3 -X dev tool.py data.csv") == ["tool.py"]
    assert paths("python3 -m tool data.py") == paths("python3 -c 'import tool' x.py") == paths("python3 tool") == []
    # files written follow; other descriptors and inputs don't count
    assert paths("date >>log.txt 2> errors.txt < in.txt") == ["log.txt"] and paths("cat a.md > 'b c.md'; cat a.md") == ["a.md", "b c.md"] and paths("cat x 2>&1 | tee y") == ["x"]
    assert paths("cat -- -odd.txt plain.txt .") == ["plain.txt"] and paths('cat "a\\"b.md"') == ['a"b.md']
    assert paths("cat it's.md other.md") == ["it's.md", "other.md"]
    assert paths("") == paths(None) == paths(" ;; | ") == paths("make all") == []


def test_shell_and_functions(spark):
    df = spark.createDataFrame([("refusal", None), (None, 'x {"score": 2, "justification": "j"} y'), (None, '{"a"} {"score": "3"}'), (None, '{"score": 2.0}'), (None, '{"score": true}'), (None, "{}"), (None, "none")], "stop string, t string")
    got = [r.o for r in df.select(judge.outcome(judge.answer_parts("t"), F.col("stop")).alias("o")).collect()]
    assert got == ["refusal", "valid", "valid", "score_invalid", "score_invalid", "score_missing", "no_json_object"]
    t = spark.createDataFrame([(1, "Wait, no. hmmm\n```\nwait\n```\nawait\u00a0HOWEVER it is"), (2, None), (3, "")], "i int, text string")
    s = {r.i: (r.length_words, r.marker_count) for r in text.signals(t).collect()}
    assert s == {1: (7, 3), 2: (None, None), 3: (0, 0)}
    pos = [(r.nth, r.word_index, r.marker) for r in text.marker_positions(t, "i").orderBy("nth").collect()]
    assert pos == [(0, 0, "wait"), (1, 2, "hmm"), (2, 7, "however")]
    p = spark.createDataFrame([("a/../b", "/w"), ("/x/./y", None), ("r", None)], "p string, c string")
    assert [r.q for r in p.select(complexity.canonical_path(F.col("p"), F.col("c")).alias("q")).collect()] == ["/w/b", "/x/y", "r"]
    src = spark.createDataFrame([("a.py", "# c\ndef f(x):\n    if x and x > 1:\n        return 1\n\nclass A:\n    pass\n")], "path string, content string")
    m = complexity.measures(src).withColumn("c", complexity.cyclomatic("content")).first()
    assert (m.loc, m.code_lines, m.n_functions, m.n_classes, m.c["max"]) == (7, 5, 1, 1, 3)
    ages = spark.createDataFrame([(5.0,), (60.0,), (7200.0,)], "s double").select(text.relative_time(F.col("s")).alias("a"))
    assert [r.a for r in ages.collect()] == ["just now", "1 minute ago", "2 hours ago"]


def test_lines_functions_and_volume(spark):
    files = [("a.js", "const f = (x) => x;\nfoo => bar\nfunction g(a) {\n}\nexport class K {\n// c"), ("b.go", "type A struct {}\n// struct\r\nfunc (a A) f() {}\r\n"), (".py", "def f(): pass"), ("c.rs", None), ("d.py", "a = 1 + 2\n")]
    got = [(r.loc, r.code_lines, r.n_functions, r.n_classes) for r in complexity.measures(spark.createDataFrame(files, "path string, content string")).collect()]
    assert got == [(6, 5, 2, 1), (3, 2, 1, 1), (1, 1, 0, 0), (None, None, 0, 0), (1, 1, 0, 0)]
    assert complexity.halstead_of("def f(x):\n    return x + 1 if x > 1 else -x\n") == (3, 5, 3, 2, 8 * math.log2(5))
    assert complexity.halstead_of("x = (") is None and complexity.halstead_of("") == (0, 0, 0, 0, 0.0)


def brute_excerpts(t, gap=200, margin=50):
    fences = [(m.start(), m.end()) for m in re.finditer(r"^```[\s\S]*?^```", t, re.M)]
    marks = [m for m in re.finditer(r"\b(?:" + "|".join(sorted(text.MARKERS, key=len, reverse=True)) + ")", t, re.I) if not any(a <= m.start() < b for a, b in fences)]
    words = [m.span() for m in re.finditer(r"\S+", t)]
    at = [max((i for i, (a, _) in enumerate(words) if a <= m.start()), default=0) for m in marks]
    groups = []
    for i, w in enumerate(at):
        if not groups or w - at[groups[-1][-1]] > gap:
            groups.append([])
        groups[-1].append(i)
    out = []
    for k, g in enumerate(groups):
        a, b = words[max(0, at[g[0]] - margin)][0], words[min(len(words) - 1, at[g[-1]] + margin)][1]
        out.append((k, len(groups), t[a:b], [(marks[i].start() - a, marks[i].end() - a, marks[i].group()) for i in g]))
    return out


def test_excerpts_equal_brute_force(spark):
    r = random.Random(3)
    bits = ["Wait", "no,no,", "however", "hold on", "un-actually", "hmm", "x", "word\u00a0y", "\n", "\x1c", "é", "😀", "wait.wait", "```"]
    texts = ["", "plain", "```\n" + "wait " * 300 + "\n```", "Wait now\n```\n" + "code " * 300 + "\n```\nhmm so"]
    for _ in range(150):
        parts = []
        for _ in range(r.randint(1, 6)):
            parts.append(r.choice([" ", "\n"]).join(r.choices(bits, k=r.randint(1, 6))) + " f" * r.choice([0, 0, 40, 120, 240]))
        texts.append(r.choice([" ", "\n", "\n```\n"]).join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {}
    for row in text.excerpts(df, "i").collect():
        got.setdefault(row.i, []).append((row.cluster_index, row.cluster_count, row.text, [tuple(h) for h in row.highlights]))
    assert {i: sorted(x, key=lambda e: e[0]) for i, x in got.items()} == {i: b for i, t in enumerate(texts) if (b := brute_excerpts(t))}
    assert len(got[3]) == 2


def test_report(spark, tmp_path):
    sc = spark.createDataFrame([("a</script>", 1.0)], "path string, score double")
    page = report.page(report.report_json(sc, spark.createDataFrame([("s", "robust_z", 1.0, 1.0, 3, True)], report._BASE)), "<script>__REPORT__</script>")
    assert page.count("</script>") == 1
    base = spark.createDataFrame([("s", "robust_z", 1.0, 1.0, 3, True)], report._BASE)
    report.save_baselines(base, str(tmp_path / "b"))
    assert report.load_baselines(spark, str(tmp_path / "b")).count() == 1 and report.load_baselines(spark, str(tmp_path / "none")) is None
    r = report.squarify([6, 6, 4, 3, 2, 2, 1], 0, 0, 6, 4)
    assert abs(sum(w * h for _, _, w, h in r) - 24) < 1e-9 and all(x >= 0 and y >= 0 and x + w <= 6 + 1e-9 and y + h <= 4 + 1e-9 for x, y, w, h in r)


def test_shell_commands_of_all_turns(spark):
    use = lambda c: {"type": "tool_use", "name": "Bash", "input": {"command": c}}
    turn = lambda *items: {"content": list(items)}
    records = [
        {"type": "assistant", "message": turn(use("top"), {"type": "text", "text": "x"}, {"type": "tool_use", "input": {"path": "p"}})},
        {"type": "progress", "data": {"type": "agent_progress", "message": {"message": turn(use("agent"))}}},
        {"type": "assistant", "message": json.dumps(turn(use("text")))},
        {"type": "user", "message": turn({"type": "tool_result", "content": [use("nested"), {"type": "tool_result", "content": [use("deep")]}]})},
        {"type": "progress", "data": {"type": "other", "message": {"message": turn(use("no turn"))}}},
        {"type": "assistant", "message": turn({"type": "tool_use", "input": json.dumps({"command": "input as text"})}, {"type": "text", "input": {"command": "no tool"}})},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, None), (10, "{")], "record_id long, payload string")
    assert {tuple(r) for r in session_log.shell_commands(df).collect()} == {(0, "top"), (1, "agent"), (2, "text"), (3, "nested"), (3, "deep"), (5, "input as text")}


def test_whole_report(spark, tmp_path):
    sc = spark.range(1203).selectExpr("concat('p', id) as path", "cast(id as double) as score")
    base = spark.range(1100).selectExpr("concat('s', id) as signal", "'robust_z' as kind", "1.0D as median", "1.0D as mad", "3L as n", "true as low_confidence")
    got = json.loads(report.report_json(sc, base))
    assert got["meta"]["n_files"] == 1203 and len(got["files"]) == got["meta"]["n_shown"] == 1000 and len(got["baselines"]) == 1100
    report.write_report(sc, base, str(tmp_path))
    files = spark.read.json(f"{tmp_path}/files").collect()
    assert {r.path for r in files} == {f"p{i}" for i in range(1203)} and spark.read.json(f"{tmp_path}/baselines").count() == 1100
    assert spark.read.json(f"{tmp_path}/meta").first().n_files == 1203


def test_actions_and_arguments(spark):
    assert shell.action_of("cd /w && str_replace_editor view src/a.py --range 1") == ("str_replace_editor", ["src/a.py"])
    assert shell.action_of("str_replace_editor undo") == ("str_replace_editor", []) and shell.action_of("cat x.md; head -n 2 y.md") == ("bash", ["x.md", "y.md"]) and shell.action_of(None) == ("bash", [])
    df = spark.createDataFrame([("bash", '{"command": "cat a.md"}', "cat b.md"), ("str_replace_editor", '{"path": "c.py", "command": "view"}', None), ("think", '{"path": "d.py"}', ""), ("bash", '{"command": 5}', "x"), ("bash", "{", "x"), (None, None, "x")], "t string, a string, s string")
    got = [(r.p, r.c.tool, r.c.paths) for r in df.select(shell.paths_of_arguments("t", "a").alias("p"), shell.actions("s").alias("c")).collect()]
    assert got == [(["a.md"], "bash", ["b.md"]), (["c.py"], "bash", []), ([], "bash", []), ([], "bash", []), ([], "bash", []), ([], "bash", [])]
