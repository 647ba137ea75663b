"""The scan against a plain reading of the same records, session by session."""

import json
import re
import statistics
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from pathlib import PurePosixPath

import pytest

from tracemill.functions import text
from tracemill.operators import scan
from tracemill.operators.scan import F
from tracemill.operators.schema import EVENT_TYPES

STOP = r"\s'\"`;|&<>$()[\]{}*?:"
ENDS = "|".join(sorted(text.SUFFIXES, key=lambda s: (-len(s), s)))
TOKEN = re.compile(rf"(?<!\w)(?:/|\./|\.\./)[^{STOP}]*|[^{STOP}]+\.(?:{ENDS})\b")
MARK = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(text.MARKERS, key=len, reverse=True))) + ")", re.I)
FENCE = re.compile(r"^```[\s\S]*?^```", re.M)


def tokens(t):
    return [w for w in (x.rstrip(",;:") for x in TOKEN.findall(t)) if w and not w.startswith("//")]


def texts_of(content):
    if isinstance(content, str):
        return [content]
    return [y["text"] if isinstance(y, dict) else y for y in content or [] if isinstance(y, str) or (isinstance(y, dict) and isinstance(y.get("text"), str))]


def found_in(content):
    out = []
    for t in texts_of(content):
        for line in (x.strip() for x in t.splitlines()):
            if line and line != "--":
                m = re.match(r"([^\s:]\S*?)[-:]\d+[-:]", line)
                out += [m[1]] if m else tokens(line) or ([line] if "/" in line and " " not in line else [])
    return out


def paths_of(name, given, result, cwd):
    if name in scan.NAMES_FILE:
        raw = [given.get("file_path")]
    elif name in scan.SEARCHES:
        raw = [given.get("path"), *found_in(result)]
    elif name == "Bash":
        raw = [p for k in ("command", "description") for p in tokens(given.get(k) or "") if not p.startswith(scan.SYSTEM_PREFIXES)]
        raw = [p for p in raw if not [s for s in p.split("/") if s] or any(c.isalpha() for c in [s for s in p.split("/") if s][-1])]
    else:
        raw = []
    out = []
    for p in raw:
        if not p:
            continue
        if p.startswith("/") or cwd:
            parts = []
            for s in PurePosixPath(cwd or "/", p).parts[1:]:
                parts = parts[:-1] if s == ".." else [*parts, s]
            p = "/" + "/".join(parts)
        if p not in out:
            out.append(p)
    return out


class Plain:
    """Everything the scan gives, by loops over lists."""

    def __init__(self, records):
        self.sessions = defaultdict(list)
        for name, _, o, _ in sorted(records, key=lambda r: (r[0], r[3], r[1])):
            if not isinstance(o, dict) or o.get("type") not in EVENT_TYPES:
                continue
            content = None
            if o["type"] in ("assistant", "user") and isinstance(o.get("message"), dict):
                content = o["message"].get("content")
            elif o["type"] == "progress" and isinstance(o.get("data"), dict) and o["data"].get("type") == "agent_progress":
                m = o["data"].get("message")
                m = m.get("message") if isinstance(m, dict) else None
                content = m.get("content") if isinstance(m, dict) else None
            blocks = [dict(b, pos=i) for i, b in enumerate(content) if isinstance(b, dict) and b.get("type") in scan.BLOCK_TYPES] if isinstance(content, list) else []
            self.sessions[name].append({"type": o["type"], "stop": o["type"] == "system" and o.get("subtype") == "compact_boundary", "cwd": o.get("cwd"), "blocks": blocks})
        for events in self.sessions.values():
            self.resolve(events)

    @staticmethod
    def resolve(events):
        open_ = {}
        for e in events:
            for b in e["blocks"]:
                if b["type"] == "tool_use":
                    b["input"] = b["input"] if isinstance(b.get("input"), dict) else {}
                    b["cwd"], b["result"] = e["cwd"], None
                    if b.get("id"):
                        open_[b["id"]] = b
                elif b["type"] == "tool_result" and b.get("tool_use_id") in open_:
                    open_[b["tool_use_id"]]["result"] = b.get("content")
        for e in events:
            for b in e["blocks"]:
                if b["type"] == "tool_use":
                    b["paths"] = paths_of(b.get("name"), b["input"], b["result"], b["cwd"])

    @staticmethod
    def window(events, i, n):
        low = high = i
        while low > max(0, i - n) and not events[low - 1]["stop"]:
            low -= 1
        while high < min(len(events) - 1, i + n) and not events[high + 1]["stop"]:
            high += 1
        return low, high

    def uses(self, events, *names):
        return [(i, b) for i, e in enumerate(events) for b in e["blocks"] if b["type"] == "tool_use" and (not names or b.get("name") in names)]

    def leaks(self):
        out = Counter()
        for s, events in self.sessions.items():
            for i, b in self.uses(events, "Edit"):
                again = any(set(r["paths"]) & set(b["paths"]) for j, r in self.uses(events, "Read") if i < j <= self.window(events, i, 3)[1])
                head = "\n".join(texts_of(b["result"]))[:100].lower()
                for p in b["paths"]:
                    out[s, p, "edit_failures"] += bool(b.get("id")) and (again or any(m in head for m in scan.EDIT_ERRORS))
                    out[s, p, "read_after_edit"] += again
            for names, kind in (("Grep", "grep_reformulations"), ("Bash", "bash_retries")):
                mine = self.uses(events, names)
                for k, (i, a) in enumerate(mine):
                    for j, b in mine[k + 1 :]:
                        if not i < j <= self.window(events, i, 3)[1]:
                            continue
                        x, y = a["input"], b["input"]
                        if names == "Grep":
                            if x.get("path") == y.get("path") and x.get("pattern") != y.get("pattern"):
                                out.update((s, p, kind) for p in a["paths"])
                                break
                        else:
                            c, d = x.get("command") or "", y.get("command") or ""
                            failed = any(m in "\n".join(texts_of(a["result"])).lower() for m in scan.SHELL_ERRORS)
                            if failed and c.split()[:1] and c.split()[:1] == d.split()[:1] and not (d.startswith(c) and d != c):
                                out.update((s, p, kind) for p in dict.fromkeys(a["paths"] + b["paths"]))
                                break
        return +out

    def bursts(self, name):
        out = Counter()
        for s, events in self.sessions.items():
            at = defaultdict(list)
            for i, b in self.uses(events, name):
                for p in b["paths"]:
                    at[p].append(i)
            for p, xs in at.items():
                for k, i in enumerate(xs):
                    low, high = self.window(events, i, 5)
                    out[s, p] += any(low <= j <= high for m, j in enumerate(xs) if m != k)
        return +out

    def thinking(self):
        for s, events in self.sessions.items():
            known = sorted({p for _, b in self.uses(events) for p in b["paths"]})
            for i, e in enumerate(events):
                for b in e["blocks"]:
                    if b["type"] != "thinking" or not b.get("thinking"):
                        continue
                    t = b["thinking"]
                    low, high = self.window(events, i, 3)
                    exact = []
                    for p in known:
                        parts = p.split("/")
                        ends = [x for x in [p, *("/".join(parts[k:]) for k in range(1, len(parts) - 1))] if "/" in x]
                        if ends and re.search(rf"(?<![\w-])(?:{'|'.join(map(re.escape, ends))})(?![\w-])", t):
                            exact.append(p)
                    unique = []
                    for m in re.finditer(rf"\b[\w\-.]+\.(?:{ENDS})\b", t):
                        hits = [p for p in known if p.rpartition("/")[2] == m.group()]
                        unique += hits if len(hits) == 1 and hits[0] not in unique else []
                    tier, files, distance = ("exact_path", exact, None) if exact else ("unique_basename", unique, None) if unique else ("temporal_proximity", [], None)
                    for d in range(1, 4) if not files else ():
                        for j in (i - d, i + d):
                            if low <= j <= high and not files:
                                files = next((x["paths"] for x in events[j]["blocks"] if x["type"] == "tool_use" and x["paths"]), [])
                                distance = d if files else None
                    bare = FENCE.sub("", t)
                    regions = [m.span() for m in FENCE.finditer(t)]
                    marks = [m for m in MARK.finditer(t) if not any(a <= m.start() < z for a, z in regions)]
                    spans = [m.span() for m in re.finditer(r"\S+", t)]
                    at = [max((k for k, (a, _) in enumerate(spans) if a <= m.start()), default=0) for m in marks]
                    clusters = 1 + sum(y - x > 200 for x, y in zip(at, at[1:], strict=False)) if marks else 0
                    words = max(1, len(bare.split()))
                    yield {"session": s, "event": i, "pos": b["pos"], "type": e["type"], "text": t, "tier": tier, "files": files, "distance": distance, "words": len(bare.split()), "q": bare.count("?") / words * 100, "m": len(marks) / words * 100, "clusters": clusters, "coupled": any(x["type"] == "tool_use" for k in range(low, high + 1) for x in events[k]["blocks"])}


def stat(values):
    med = statistics.median(values) if values else 0.0
    return med, statistics.median([abs(v - med) for v in values]) if values else 0.0, len(values)


def baselines(plain, blocks, sessions):
    said = Counter()
    for s in sessions:
        for e in plain.sessions[s]:
            said[s] += sum(len(b.get("text") or "") for b in e["blocks"] if b["type"] == "text") if e["type"] == "assistant" else 0
    mine = [b for b in blocks if b["session"] in sessions]
    leaks = Counter()
    for (s, _, _), n in plain.leaks().items():
        leaks[s] += n
    per = defaultdict(list)
    for b in mine:
        per[b["session"]].append(b["coupled"])
    out = {
        "block_length_words": [b["words"] for b in mine], "question_rate_per_100w": [b["q"] for b in mine], "tool_use_coupling_rate": [sum(x) / len(x) for x in per.values()],
        "reasoning_to_output_ratio": [sum(len(b["text"]) for b in mine if b["session"] == s and b["type"] == "assistant") / max(said[s], 1) for s in sessions], "leakage_events_per_session": [leaks[s] for s in sessions],
    }
    for k, tool in (("reread_bursts_per_file", "Read"), ("edit_churn_per_file", "Edit")):
        n = Counter()
        for (s, p), v in plain.bursts(tool).items():
            n[p] += v if s in sessions else 0
        out[k] = list((+n).values())
    return {k: stat(v) for k, v in out.items()}


def made_up(n=14, seed=4):
    """Sessions whose tools fail, retry and read again more often than real ones do."""
    import random

    r = random.Random(seed)
    files = ["src/a.py", "src/b.py", "lib/a.py", "/etc/hosts", "docs/x y.md", "./Makefile"]
    rows, rid = [], 0
    for s in range(n):
        at, ids = datetime(2026, 1, 1), []
        for k in range(r.randint(20, 90)):
            at += timedelta(seconds=r.randint(1, 9))
            blocks = []
            for _ in range(r.randint(0, 4)):
                kind = r.random()
                if kind < 0.6:
                    name = r.choice(["Read", "Edit", "Edit", "Write", "Bash", "Bash", "Grep", "Grep", "Glob", "Agent"])
                    given = {"file_path": r.choice(files)} if name in scan.NAMES_FILE else {"path": r.choice(["src", None]), "pattern": r.choice("ab")} if name in scan.SEARCHES else {"command": r.choice(["pytest src/a.py", "pytest src/a.py -x", "cat /usr/bin/x lib/a.py", " ", "make"]), "description": "run"}
                    ids.append(f"t{s}-{k}-{len(ids)}")
                    blocks.append({"type": "tool_use", "name": name, "id": ids[-1], "input": given})
                elif kind < 0.8 and ids:
                    content = r.choice(["String not found", "ok", "Traceback: failed", "src/b.py:12: x\nlib/a.py-3-y\n--\nother/z", [{"text": "src/a.py:1:"}, "Error", 5]])
                    blocks.append({"type": "tool_result", "tool_use_id": r.choice(ids[-4:]), "content": content})
                elif kind < 0.95:
                    t = r.choice(["Wait, src/a.py is wrong", "see a.py", "no,no, hmm?", "b.py? However it is", "```\nwait\n```\nactually fine", "nothing", "Wait " + "w " * 210 + "hmm", "edit docs/x y.md"])
                    blocks.append({"type": "thinking", "thinking": t})
                else:
                    blocks.append({"type": "text", "text": "spoken"})
            o = {"type": "assistant", "cwd": "/p", "message": {"content": blocks, "model": "m"}}
            if r.random() < 0.2:
                o = {"type": "progress", "cwd": "/p", "data": {"type": "agent_progress", "message": {"type": "assistant", "message": {"content": blocks}}}}
            elif r.random() < 0.08:
                o = {"type": "system", "subtype": "compact_boundary"}
            rows.append((f"s{s}.jsonl", rid, o | {"timestamp": at.strftime("%Y-%m-%dT%H:%M:%SZ")}))
            rid += 1
    run = lambda k, c: {"type": "tool_use", "name": "Bash", "id": f"h{k}", "input": {"command": c}}
    turns = [[run(0, "pytest src/a.py")], [{"type": "tool_result", "tool_use_id": "h0", "content": "1 failed"}, run(1, "pytest src/a.py -x")], [run(2, "pytest  lib/a.py src/a.py"), run(3, "pytest src/b.py")]]
    for k, blocks in enumerate(turns):
        rows.append(("hand.jsonl", rid + k, {"type": "assistant", "cwd": "/p", "message": {"content": blocks}, "timestamp": f"2026-01-01T00:00:0{k}Z"}))
    return rows


@pytest.fixture(scope="module")
def both(spark):
    rows = made_up()
    df = spark.createDataFrame([(f, i, json.dumps(o)) for f, i, o in rows] + [("s0.jsonl", 9999, "{broken"), ("s0.jsonl", 9998, None), ("s0.jsonl", 9997, '{"type": "other"}')], "file_name string, record_id long, payload string")
    return scan.Scan(df), Plain([(f, i, o, o["timestamp"]) for f, i, o in rows])


def test_uses_and_their_paths(both):
    s, plain = both
    got = {(r.session, r.event_index, r.pos): r.paths for r in s.uses.collect()}
    assert got == {(n, i, b["pos"]): b["paths"] for n, events in plain.sessions.items() for i, b in plain.uses(events)}
    usage = {(r.path, t): r[t.lower()] for r in scan.tool_usage(s.uses).collect() for t in scan.TOOLS if r[t.lower()]}
    assert usage == Counter((p, b["name"]) for events in plain.sessions.values() for _, b in plain.uses(events, *scan.TOOLS) for p in b["paths"])


def test_behaviour(both):
    s, plain = both
    got = Counter((r.session, r.path, r.kind) for r in s.leaks.collect())
    assert got == plain.leaks() and {k for _, _, k in got} == set(scan.LEAKS)
    for k, tool in (("reread_bursts", "Read"), ("edit_churn", "Edit")):
        assert {(r.session, r.path): r.n for r in s.bursts[k].collect()} == plain.bursts(tool)


def test_thinking(both):
    s, plain = both
    got = {(r.session, r.event_index, r.pos): (r.tier, r.file_paths or [], r.proximity_distance, r.length_words, round(r.question_rate_per_100w, 6), round(r.markers_per_100w, 6), r.cluster_count, r.tool_use_coupling) for r in s.blocks.collect()}
    want = {(b["session"], b["event"], b["pos"]): (b["tier"], b["files"], b["distance"], b["words"], round(b["q"], 6), round(b["m"], 6), b["clusters"], b["coupled"]) for b in plain.thinking()}
    assert got == want and {t[0] for t in want.values()} == {"exact_path", "unique_basename", "temporal_proximity"}


def test_baselines(both):
    s, plain = both
    blocks, names = list(plain.thinking()), sorted(plain.sessions)
    got = {r.signal: (r.median, r.mad, r.n) for r in s.corpus_baselines().filter("kind = 'robust_z'").collect()}
    want = baselines(plain, blocks, names)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k
    count = Counter(b["session"] for b in blocks)
    large = {n for n in names if count[n] >= 12}
    mine = defaultdict(dict)
    for r in s.session_baselines(12).filter("kind = 'robust_z'").collect():
        mine[r.session][r.signal] = (r.median, r.mad, r.n)
    assert set(mine) == large and large and large != set(names)
    for n in large:
        for k, v in baselines(plain, blocks, [n]).items():
            assert mine[n].get(k, (0.0, 0.0, 0)) == pytest.approx(v, abs=1e-9), (n, k)


def test_scores(both):
    s, plain = both
    blocks, names = list(plain.thinking()), sorted(plain.sessions)
    base = baselines(plain, blocks, names)
    z = lambda v, k: (v - base[k][0]) / (1.4826 * base[k][1]) if base[k][1] > 0 else 0.0
    share, positive, rate, tangle, coupled = (Counter() for _ in range(5))
    for b in blocks:
        for p in b["files"]:
            w = 1 / len(b["files"])
            share[p] += w
            tangle[p] += 1
            coupled[p] += b["coupled"]
            positive[p] += w * (b["m"] > 0)
            rate[p] += w * b["m"]
    bursts = {k: Counter() for k in ("Read", "Edit")}
    for k, c in bursts.items():
        for (_, p), n in plain.bursts(k).items():
            c[p] += n
    leaks = Counter()
    for (_, p, _), n in plain.leaks().items():
        leaks[p] += n
    got = {r.path: r for r in s.file_scores().collect()}
    assert set(got) == set(share) | set(bursts["Read"]) | set(bursts["Edit"]) | set(leaks)
    for p, r in got.items():
        markers = (positive[p] / share[p]) * (rate[p] / positive[p]) if positive[p] else 0.0
        assert r.markers == pytest.approx(markers) and r.tangle_count == tangle[p]
        assert r.score == pytest.approx(0.25 * markers + 0.25 / 3 * (z(bursts["Read"][p], "reread_bursts_per_file") + z(bursts["Edit"][p], "edit_churn_per_file"))), p
        assert r.thinking_resolution_rate == pytest.approx(coupled[p] / tangle[p] if tangle[p] else 0.0)


def test_report(both, spark):
    s, plain = both
    rows = {r.path: r for r in s.report_files().collect()}
    assert rows and all(r.edit or r.write for r in rows.values()) and "/p/src/a.py" in rows and rows["/p/src/a.py"].directory == "/p/src/"
    there = s.report_files(spark.createDataFrame([("/p/lib/a.py", 50)], "path string, loc int")).filter("path = '/p/lib/a.py'").first()
    assert there.normalized_by_loc == pytest.approx(there.score / 50)
    top = s.excerpts_by_file(2).filter(F.col("path") == "/p/src/a.py").orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2] and top[0].marker_count >= top[1].marker_count


def test_titles_and_top_components(both, spark):
    rows = [("a", 1, {"type": "ai-title", "aiTitle": "old", "timestamp": "2026-01-01T00:00:00Z"}), ("a", 0, {"type": "ai-title", "aiTitle": "new", "timestamp": "2026-01-02T00:00:00Z"}), ("a", 2, {"type": "ai-title", "aiTitle": " ", "timestamp": "2026-01-03T00:00:00Z"}),
            ("b", 3, {"type": "last-prompt", "lastPrompt": "# " + "x" * 70 + "\ny"}), ("c", 4, {"type": "user"}), ("d", 5, {"type": "user", "aiTitle": "no"})]
    df = spark.createDataFrame([(f, i, json.dumps(o)) for f, i, o in rows], "file_name string, record_id long, payload string")
    assert {(r.session, r.title) for r in scan.Scan(df).titles().collect()} == {("a", "new"), ("b", "x" * 59 + "…"), ("c", "(untitled)"), ("d", "(untitled)")}
    s, _ = both
    full = {r.path: r for r in s.file_scores().collect()}
    for r in s.top_components().collect():
        give = {k: full[r.path][f"{k}_contribution"] for k in scan.SIGNALS}
        assert abs(give[r.signal]) == max(map(abs, give.values())) and r.signal == next(k for k in scan.SIGNALS if abs(give[k]) == abs(give[r.signal]))


def test_no_records(spark):
    s = scan.Scan(spark.createDataFrame([], "record_id long, file_name string, payload string, session string, type int"))
    assert s.file_scores().count() == 0 and s.session_baselines().count() == 0 and s.excerpts_by_file().count() == 0
    assert {(r.signal, r.n) for r in s.corpus_baselines().collect()} == {(k, 0) for k in scan.BASELINES}
