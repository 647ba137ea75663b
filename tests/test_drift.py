import datetime
import json
import random
from collections import Counter

from tracemill.operators import drift as D


def frame(spark, files, stream="s"):
    rows, n = [], 0
    for day, (name, payloads) in enumerate(files):
        for p in payloads:
            rows.append((n, stream, name, datetime.datetime(2026, 1, 1 + day), p if p is None or isinstance(p, str) else json.dumps(p), "x", 1))
            n += 1
    return spark.createDataFrame(rows, "record_id long, export_stream string, export_file string, exported_at timestamp, payload string, field string, kind int")


KINDS = ("user", "assistant", "system")


def test_changes(spark):
    base = [{"type": KINDS[i % 3], "n": {"words": 10 + i}, "flag": i % 2 == 0, "cwd": f"/p{i % 2}", "uuid": f"{i:032x}"} for i in range(30)]
    second = [{"kind": r["type"], "n_words": str(r["n"]["words"]), "flag": "yes" if r["flag"] else "no", "cwd": r["cwd"], "uuid": r["uuid"], "Extra": [1]} for r in base]
    third = [{k: v for k, v in r.items() if k != "cwd"} | {"isNew": True} for r in second]
    got = {tuple(r) for r in D.found(frame(spark, [("f1", base), ("f2", second), ("f3", third)])).collect()}
    assert got == {
        ("f2", "renamed", "kind", "type"), ("f2", "renamed", "n_words", "n.words"), ("f2", "retyped", "n_words", "n.words"), ("f2", "retyped", "flag", ""), ("f2", "added", "Extra", ""), ("f3", "removed", "cwd", ""), ("f3", "added", "isNew", ""),
    }


def test_odd_rows(spark):
    files = [("a", [{"x": 1}, {"x": None}, None, "", "broken", "[]", {"x": {}}]), ("b", [{"x": 1}, {"x": 1}]), ("c", [None]), ("d", [{"y": "z" * 200_000}])]
    got = {tuple(r) for r in D.found(frame(spark, files)).collect()}
    assert got == {("c", "removed", "x", ""), ("d", "added", "y", "")}
    assert D.found(frame(spark, [])).count() == 0
    assert D.found(frame(spark, files[:2], None)).count() == 0


def test_ingest_and_replay(spark):
    files = [("a", [{"n": 1, "t": "x"}, {"n": "bad", "t": "y"}]), ("b", [{"n": 2, "t": "x", "tags": ["p", "q"], "big": {"deep": 1.5}}])]
    df = D.ingest(frame(spark, files), {"n": "bigint", "t": "string"})
    rows = {r.record_id: r for r in df.collect()}
    assert [rows[i].n for i in range(3)] == [1, None, 2]
    assert json.loads(rows[1].rescued)["n"]["text"] == "bad" and rows[0].rescued is None
    again = {r.record_id: r for r in D.replay(df, {"tags": "array<string>", "big.deep": "double"}).collect()}
    assert again[2].tags == ["p", "q"] and again[2].big_deep == 1.5 and again[2].rescued is None
    assert json.loads(again[1].rescued)["n"]["text"] == "bad"


def test_likeness():
    assert D.name_likeness("sessionId", "session_id") == 1 and D.name_likeness("blockIndex", "blkIdx") > 0.8 and D.name_likeness("cwd", "tags") == 0
    assert D.match_renames({"flag": [("true", 5), ("false", 5)]}, {"other": [("true", 5), ("false", 5)]}) == []


def test_renames_of_unlike_sizes_and_long_values(spark):
    few = [{"note": f"alpha {i} beta"} for i in range(600)]
    many = [{"remark": f"alpha {i} beta"} for i in range(6000)]
    assert {tuple(r) for r in D.found(frame(spark, [("f1", few), ("f2", many)])).collect()} == {("f2", "renamed", "remark", "note")}
    same = "word " * 60  # values that differ after 300 characters only
    old, new = ([{name: f"{same} {i} beta"} for i in range(30)] for name in ("abc", "xyz"))
    other = [{"qrs": f"{same} tail {i} end"} for i in range(30)]
    assert {tuple(r) for r in D.found(frame(spark, [("f1", old), ("f2", new)])).collect()} == {("f2", "renamed", "xyz", "abc")}
    assert {tuple(r) for r in D.found(frame(spark, [("f1", old), ("f2", other)])).collect()} == {("f2", "removed", "abc", ""), ("f2", "added", "qrs", "")}


def test_pairs_equal_lists(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choices("abcdef", k=n))
    make = {"t": lambda: word(2), "u": lambda: f"{word(3)}-{word(3)}-{word(3)}", "n": lambda: r.gauss(5, 2), "b": lambda: r.random() < 0.3, "s": lambda: str(r.randint(0, 30)), "l": lambda: [word(1), word(1)]}
    one = [{f"{k}0": f() for k, f in make.items()} for _ in range(150)]
    two = [{f"{k}1": f() for k, f in make.items()} for _ in range(400)]
    df = frame(spark, [("f1", one), ("f2", two)])
    side = spark.createDataFrame([("s", "f2", "f1", f, "removed") for f in one[0]] + [("s", "f2", "f2", f, "added") for f in two[0]], "export_stream string, export_file string, source string, field string, side string")
    values = lambda rows, f: list(Counter(D._shown(v) for x in rows for v in (x[f] if isinstance(x[f], list) else [x[f]])).items())
    want = {(a, b): D.data_likeness(values(one, a), values(two, b)) for a in one[0] for b in two[0]}
    for most in (100, 3):
        got = {(p.old, p.new): D.judged(p.asDict()) for p in D.pair_likeness(df, side, most).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 for k in want)


def ingested(spark, rows, target):
    df = spark.createDataFrame([(i, "s", f, datetime.datetime(2026, 1, k), p) for i, (k, f, p) in enumerate(rows)], "record_id long, export_stream string, export_file string, exported_at timestamp, payload string")
    changes = spark.createDataFrame([("s", "f2", "renamed", "b", "a"), ("s", "f3", "renamed", "c", "b"), ("s", "f3", "added", "a", ""), ("s", "f4", "renamed", "d", "a")], "export_stream string, export_file string, change_kind string, field_name string, old_field_name string")
    return [(r, json.loads(r.rescued) if r.rescued else {}) for r in D.ingest(df, target, changes).orderBy("record_id").collect()]


def test_two_fields_of_one_first_name(spark):
    rows = [(1, "f1", '{"a": 1}'), (2, "f2", '{"b": 2}'), (3, "f3", '{"c": 3, "a": 4}'), (4, "f4", '{"c": 5, "d": 6}')]
    got = ingested(spark, rows, {"a": "bigint"})
    assert [r.a for r, _ in got] == [1, 2, 4, 5]
    assert [{k: v["text"] for k, v in x.items()} for _, x in got] == [{}, {}, {"c": "3"}, {"d": "6"}]


def test_nothing_is_lost(spark):
    got = ingested(spark, [(1, "f1", "{broken"), (1, "f1", '{"x.y": 1, "x": {"y": 2}}'), (1, "f1", None), (1, "f1", "[1]")], {"a": "bigint"})
    assert [{k: v["text"] for k, v in x.items()} for _, x in got] == [{"": "{broken"}, {"x.y": "1", "x.y#2": "2"}, {}, {"": "[1]"}]
