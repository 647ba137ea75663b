"""Attribution of reasoning text to files: exact path, unique basename, nearest event; and the rules of ignore files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text as T


def session_paths(events: DataFrame, session: str, path: str) -> DataFrame:
    """(session, path, base, key, odd): every path of a session once.

    Whatever longer end of a path a text names, it names parent/basename too; ``key`` is what of that has no white space around its slash
    (all of it, unless the path is ``odd``), and null for a bare name.
    """
    p = events.select(session, F.col(path).alias("path")).filter("path is not null and path <> ''").distinct()
    parts = F.split("path", "/")
    parent, base = F.element_at(parts, -2), F.element_at(parts, -1)
    p = p.withColumn("base", base).withColumn("tail", F.when(F.size(parts) > 1, F.concat_ws("/", parent, base)))
    p = p.withColumn("odd", F.coalesce(F.col("tail").rlike(r"(?U)\s"), F.lit(False)))
    bare = F.concat_ws("/", F.regexp_extract(parent, r"(?U)\S*\z", 0), F.regexp_extract(base, r"(?U)\A\S*", 0))
    return p.withColumn("key", F.when(F.col("tail").isNotNull(), F.when(F.col("odd"), bare).otherwise(F.col("tail"))))


def slash_keys(text: Column) -> Column:
    """What could be parent/basename at each slash of a text: from any place after a boundary to any place before one, nothing white between.

    A boundary is where no word character and no hyphen stands on the other side, so 'b/c.py-old' gives b/c and b/c.py-old, not b/c.py.
    """
    runs = F.filter(F.split(text, r"(?U)\s+"), lambda r: r.contains("/"))

    def of_run(run: Column) -> Column:
        parts = F.split(run, "/")

        def at(i: Column) -> Column:
            # pieces that begin after (end before) a character that is neither of a word nor a hyphen
            left, right = F.split(F.element_at(parts, i), r"(?U)(?<=[^\w-])"), F.split(F.element_at(parts, i + 1), r"(?U)(?=[^\w-])")
            starts = F.transform(F.sequence(F.lit(1), F.size(left)), lambda k: F.array_join(F.slice(left, k, F.size(left)), ""))
            ends = F.transform(F.sequence(F.lit(1), F.size(right)), lambda k: F.array_join(F.slice(right, F.lit(1), k), ""))
            return F.flatten(F.transform(starts, lambda s: F.transform(ends, lambda e: F.concat(s, F.lit("/"), e))))

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), at))

    return F.array_distinct(F.flatten(F.transform(runs, of_run)))


#: A bare file name in a text.
BASENAME = r"(?U)\b\w[\w.-]*\.(?:" + "|".join(sorted(T.SUFFIXES, key=lambda s: (-len(s), s))) + r")\b"


def attribute(blocks: DataFrame, events: DataFrame, session: str = "session_id", block: str = "block_id", text: str = "text", path: str = "path", proximity: DataFrame | None = None) -> DataFrame:
    """(session, block, tier, confidence, file_paths): tier 1 exact path, else 2 unique basename, else 3 the nearest event's paths.

    A text names a path exactly if an end of it with a slash stands between boundaries (see ``slash_keys``): texts and paths meet by
    equality of such keys, so no pattern is built per row and nothing is crossed; only paths with white space are then searched
    for in the texts that bear their key. A basename counts if one path of the session bears it. ``proximity`` brings (block, nearest_paths).
    Blocks without session or text, and those that no tier reaches, have nulls.
    """
    paths = session_paths(events, session, path)
    keys = blocks.select(session, block, F.explode(slash_keys(F.col(text))).alias("key"))
    exact = keys.join(paths.filter("key is not null").select(session, "key", "path", "tail", "odd"), [session, "key"])
    there = F.regexp_like(F.col(text), F.concat(F.lit("(?U)(?<![\\w-])\\Q"), F.col("tail"), F.lit("\\E(?![\\w-])")))
    odd = exact.filter("odd").select(session, block, "path", "tail").distinct().join(blocks.select(block, text), block).filter(there)
    t1 = exact.filter("not odd").select(session, block, "path").unionByName(odd.select(session, block, "path")).groupBy(session, block).agg(F.sort_array(F.collect_set("path")).alias("p1"))
    names = blocks.select(session, block, F.posexplode(F.regexp_extract_all(text, F.lit(BASENAME), F.lit(0))).alias("nth", "base"))
    unique = paths.groupBy(session, "base").agg(F.count("*").alias("n"), F.max("path").alias("path")).filter("n = 1")
    hit = names.join(unique.select(session, "base", "path"), [session, "base"]).groupBy(session, block, "path").agg(F.min("nth").alias("nth"))
    t2 = hit.groupBy(session, block).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "path"))), lambda x: x["path"]).alias("p2"))
    out = blocks.select(session, block).join(t1, [session, block], "left").join(t2, [session, block], "left")
    out = out.join(proximity.select(block, F.col("nearest_paths").alias("p3")).filter("size(p3) > 0"), block, "left") if proximity is not None else out.withColumn("p3", F.lit(None).cast("array<string>"))
    tier = F.when(F.col("p1").isNotNull(), "exact_path").when(F.col("p2").isNotNull(), "unique_basename").when(F.col("p3").isNotNull(), "temporal_proximity")
    sure = F.when(F.col("p1").isNotNull(), "high").when(F.col("p2").isNotNull(), "medium").when(F.col("p3").isNotNull(), "low")
    return out.select(session, block, tier.alias("tier"), sure.alias("confidence"), F.coalesce("p1", "p2", "p3").alias("file_paths"))


def _rule(pattern: str) -> tuple[str, bool] | None:
    """(regular expression, whether it re-includes) of one line of an ignore file."""
    line = pattern.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    keep = line.startswith("!")
    line = line[1:] if keep else line.removeprefix("\\")
    folder = line.endswith("/")
    body = line.strip("/")
    anchored = "/" in body or line.startswith("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + body[i] if not body[i].isalnum() and body[i] not in "_-[]^/" else body[i]), i + 1
    return f"{'^' if anchored else '(?:^|/)'}{out}{'/' if folder else '(?:/|$)'}", keep


def user_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether an ignore file's lines leave a path out: the last line that matches decides, '!' takes it back."""
    verdict = F.lit(False)
    for p in patterns:
        rule = _rule(p)
        if rule:
            verdict = F.when(path.rlike(rule[0]), F.lit(not rule[1])).otherwise(verdict)
    return verdict
