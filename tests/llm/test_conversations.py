import math
import random
from datetime import datetime, timezone

from tracemill.llm import conversations as C

SCHEMA = "row_id long, session_id string, msg_uuid string, parent_uuid string, msg_role string, msg_timestamp string, msg_text string, model string, slice int, depth string"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, None, 1, "x") for i, r in enumerate(rows)], SCHEMA)


def ts(sec, ms=0):
    return datetime.fromtimestamp(1_770_000_000 + sec, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S") + f".{ms:03d}Z"


def got(spark, rows, **k):
    return {(r.session_id, r.turn, r.msg_uuid) for r in C.conversations(frame(spark, rows), **k).collect()}


def test_rules(spark):
    ok = lambda s: [(s, "u", None, "Human", ts(0), "hi"), (s, "a", "u", " AI ", ts(0), "yo")]
    rows = [
        *ok(" S1"), ("s1 ", "u", None, "USER", ts(0), ""), ("S1", "b", "a", "tool", "1770000000500", "​"), ("s1", "c", "b", "sys", ts(1), "note"), ("s1", "d", "c", "user", "2026-02-02T03:40:09+01:00", "q"), ("s1", "e", "d", "model", ts(9, 5), "r"),
        *ok("norole"), ("norole", "x", None, "wat", ts(3), "t"),
        *ok("noid"), ("noid", " ", None, "user", ts(3), "t"),
        *ok("notime"), ("notime", "x", None, "user", "2026-02-30T00:00:00Z", "t"),
        *ok("orphan"), ("orphan", "x", "gone", "tool", ts(3), "t"),
        *ok("future"), ("future", "x", "y", "tool", ts(3), "t"), ("future", "y", None, "tool", ts(4), "t"),
        *ok("self"), ("self", "x", "x", "tool", ts(3), "t"),
        *ok("circle"), ("circle", "x", "y", "tool", ts(3), "t"), ("circle", "y", "x", "tool", ts(3), "t"),
        *ok("unanswered"), ("unanswered", "x", None, "user", ts(3), "t"),
        ("starts", "a", None, "assistant", ts(0), "x"), ("starts", "u", None, "user", ts(1), "x"), ("starts", "b", None, "assistant", ts(2), "x"),
        ("silent", "a", None, "system", ts(0), "x"), ("hidden", "u", None, "user", ts(0), "﻿"), ("hidden", "a", "u", "assistant", ts(1), "x"),
        (None, "u", None, "user", ts(0), "x"), (None, None, None, None, None, None),
    ]
    assert got(spark, rows) == {("s1", i, m) for i, m in enumerate("uacde")}
    assert got(spark, []) == set()


def brute(rows):
    by = {}
    for s, u, p, r, t, x in rows:
        by.setdefault(s, []).append((u, p, r, t, x))
    out = set()
    for s, rs in by.items():
        ms = {}
        for u, p, r, t, x in rs:
            m = ms.setdefault(u, [p, r, t, False])
            m[3] |= bool(x.strip())
        depth = {}

        def d(u, ms=ms, depth=depth):
            p = ms[u][0]
            if u not in depth:
                depth[u] = 1 + d(p) if p in ms and ms[p][2] == ms[u][2] else 0
            return depth[u]

        if any(p is not None and (p not in ms or ms[p][2] > t) for u, (p, r, t, _) in ms.items()):
            continue
        turns = [u for u in sorted(ms, key=lambda u: (ms[u][2], d(u), u)) if ms[u][3]]
        talk = [ms[u][1] for u in turns if ms[u][1] in ("user", "assistant")]
        if not talk or talk[0] != "user" or any(a == "user" and (talk[i + 1 : i + 2] or [""])[0] != "assistant" for i, a in enumerate(talk)):
            continue
        out |= {(s, i, u) for i, u in enumerate(turns)}
    return out


def test_random_sessions_equal_brute_force(spark):
    r = random.Random(5)
    rows = []
    for s in range(60):
        n, t, prev = r.randint(1, 12), 0, None
        for i in range(n):
            t += r.choice([0, 0, 1, 50_000])
            u = f"m{i:02d}{r.randint(0, 9)}"
            role = ("user", "assistant")[i % 2] if r.random() < 0.9 else r.choice(["tool", "user"])
            p = prev if r.random() < 0.9 else r.choice([None, "lost"])
            row = (f"s{s}", u, p, role, ts(t), r.choice(["x", "y", "z", " "]))
            rows += [row] * r.choice([1, 1, 2])
            prev = u
    r.shuffle(rows)
    want = brute(rows)
    assert want and got(spark, rows, slice_rows=3) == want == got(spark, rows)


def test_segments(spark):
    rows = []
    for i, t in enumerate([0, 10, 20, 30, 100_000, 100_010, 300_000, 300_005]):
        rows.append(("s", f"m{i}", None, ("user", "assistant")[i % 2], ts(t), "x"))
    for size in (3, 10**6):
        df = C.conversations(frame(spark, rows), slice_rows=size, gap_seconds=3600)
        assert [r.segment for r in df.orderBy("turn").collect()] == [0, 0, 0, 0, 1, 1, 2, 2]
    full = C.with_texts(C.conversations(frame(spark, rows)), frame(spark, rows)).collect()
    assert len(full) == 8 and {r.msg_text for r in full} == {"x"}


def resumed(n, rest):
    """n sessions of ten messages, pauses of 2, 7 and 61 s, each resumed after ``rest`` seconds."""
    rows = []
    for s in range(n):
        t = 0
        for i in range(10):
            t += rest if i == 6 else (2, 7, 61)[(i + s) % 3]
            rows.append((f"s{s}", f"m{i}", None, ("user", "assistant")[i % 2], ts(t), "x"))
    return rows


def test_calibrated_segments(spark):
    for rest in (3700, 9 * 3600):  # inside a slice, and over its edge
        got = C.conversations(frame(spark, resumed(20, rest))).collect()
        assert len(got) == 200 and all(r.segment == (r.turn >= 6) for r in got)
    stray = [("far", "a", None, "user", ts(0), "x"), ("far", "b", None, "assistant", ts(9 * 10**8), "x")]
    got = C.conversations(frame(spark, resumed(20, 9 * 3600) + stray)).collect()
    assert sum(r.segment for r in got) == 81
    assert {r.segment for r in C.conversations(frame(spark, resumed(20, 7))).collect()} == {0}
    assert C.conversations(frame(spark, [])).count() == 0


def test_pauses_over_slice_edges(spark):
    rows = [("s", i // 2, ts_) for i, ts_ in enumerate([0, 10, 50_000, 50_010, 50_030])]
    turns = spark.createDataFrame([(s, k, t * 10**6) for s, k, t in rows], "s string, slice int, instant long")
    turns = turns.withColumn("pause", C.F.col("instant") - C.F.lag("instant").over(C.Window.partitionBy("s", "slice").orderBy("instant")))
    assert sorted(r.pause // 10**6 for r in C.pauses(turns).collect()) == [10, 10, 20, 49_990]


def test_segments_do_not_depend_on_slices(spark):
    rows = resumed(20, 9 * 3600)
    rows += [("hot", f"h{i:03d}", None, ("user", "assistant")[i % 2], ts(40 * i + (i // 50) * 90_000), "x") for i in range(300)]
    whole, cut = ({(r.session_id, r.turn, r.segment, r.msg_uuid) for r in C.conversations(frame(spark, rows), slice_rows=n).collect()} for n in (10**6, 7))
    assert whole == cut and len(whole) == 500 and {s for i, _, s, _ in whole if i == "hot"} == set(range(6))
    assert {r.segment for r in C.conversations(frame(spark, rows), gap_seconds=math.inf, slice_rows=7).collect()} == {0}


def test_packed_keys_come_back(spark):
    texts = ["cb85e361-b923-4886-9d2f-0123456789ab", "CB85e361-b923-4886-9d2f-0123456789ab", "", "a", "exactly 16 bytes", "é" * 8, "0" * 17]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.packed(C.F.col("t")).alias("k"))
    rows = df.select("t", "k", C.unpacked(C.F.col("k")).alias("b")).collect()
    assert [r.b for r in rows] == texts and len({bytes(r.k) for r in rows}) == len(texts) and len(rows[0].k) == 16


def test_valley():
    assert C.valley({0: 500, 1: 400, 8: 3, 16: 500, 90: 1}) == 9 and C.valley({0: 500, 1: 400, 2: 90}) is None and C.valley({}) is None
