import random
import re

from tracemill.functions import text as T
from tracemill.functions.text import F
from tracemill.operators import attribution, scoring

STOPS = r"\s'\"`;|&<>$()[\]{}*?:"
SCAN = re.compile(rf"(?<![\w])(?:/|\./|\.\./)[^{STOPS}]*|[^{STOPS}]+\.(?:{'|'.join(sorted(T.SUFFIXES, key=lambda x: (-len(x), x)))})\b")


def brute(text):
    words = [w.rstrip(",;:") for w in SCAN.findall(text)]
    return [w for w in words if w and not w.startswith("//")]


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.p for r in df.select("i", T.path_scan(F.col("t")).alias("p")).orderBy("i").collect()]


def test_rooted_paths_of_any_ending(spark):
    texts = ["see /srv/app/Makefile, ./Dockerfile and ../x/Main.java; ~/reports$ src/a.py", "and/or https://host/p.py a.py,b.py a.py-/x .py", "", None]
    assert scanned(spark, texts) == [["/srv/app/Makefile", "./Dockerfile", "../x/Main.java", "/reports", "src/a.py"], brute(texts[1]), [], None]


def test_scan_equals_one_pattern(spark):
    r = random.Random(11)
    parts = ["/", "./", "../", ".", "a", "b_", "é", "-", ",", "~", ".py", ".json", ".js", ".java", " ", ":", "\n", "$", "//", "\u0085", " ", "1", "\x1c", "@"]
    texts = ["".join(r.choices(parts, k=r.randint(1, 14))) for _ in range(4000)]
    assert scanned(spark, texts) == [brute(t) for t in texts]


def test_tier_one_of_a_path_without_ending(spark):
    ev = spark.createDataFrame([("s", "/srv/app/Makefile")], "session_id string, path string")
    bl = spark.createDataFrame([("s", 1, "look at /srv/app/Makefile"), ("s", 2, "nothing")], "session_id string, block_id int, text string")
    assert {r.block_id: r.tier for r in attribution.attribute(bl, ev).collect()} == {1: "exact_path", 2: None}


def test_tiers_equal_brute_force(spark):
    r = random.Random(23)
    paths = ["/p/src/a.py", "/p/lib/a.py", "/p/docker/Dockerfile", "b/c.py", "/root.md", "one.md", "/p/my dir/file name.txt", "/p/x-y/my-a.py", "/p/é/b_c.py", "/p/src/deep/a.py"]
    bits = ["src/a.py", "lib/a.py", "docker/Dockerfile", "b/c.py", "/root.md", "one.md", "my dir/file name.txt", "x-y/my-a.py", "é/b_c.py", "deep/a.py", "-", "old", " ", "(", ")", ".", ",", "\n", "a.py", "_", "/", "my-a.py", "see"]
    texts = ["".join(r.choices(bits, k=r.randint(1, 7))) for _ in range(1500)]
    got = {x.block_id: (x.tier, x.file_paths) for x in attribution.attribute(spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "session_id string, block_id int, text string"), spark.createDataFrame([("s", p) for p in paths], "session_id string, path string")).collect()}
    name = re.compile(rf"\b[\w\-.]+\.(?:{'|'.join(sorted(T.SUFFIXES, key=lambda x: (-len(x), x)))})\b")
    for i, t in enumerate(texts):
        exact = []
        for p in sorted(paths):
            parts = p.split("/")
            ends = [e for e in [p, *("/".join(parts[k:]) for k in range(1, len(parts) - 1))] if "/" in e]
            if ends and re.search(rf"(?<![\w-])(?:{'|'.join(map(re.escape, ends))})(?![\w-])", t):
                exact.append(p)
        unique = list(dict.fromkeys(h[0] for m in name.finditer(t) if len(h := [p for p in paths if p.rpartition("/")[2] == m.group()]) == 1))
        assert got[i] == (("exact_path", exact) if exact else ("unique_basename", unique) if unique else (None, None)), t


def test_noise(spark):
    names = ["a/package-lock.json", "pnpm-lock.yaml", "x/poetry.lock", "a.min.js", "vendor/a.py", "src/dist/b.py", "generated", "src/a.py", "lock.json", "map.py", "a.js.map"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r.p for r in df.filter(scoring.noisy(F.col("p"))).collect()] == names[:7] + names[10:]
