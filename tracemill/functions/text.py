"""Text functions: words, code fences, markers, signals, clusters, paths, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marker phrases (fixed values).
MARKERS = ("actually", "wait", "hmm", "no,", "let me reconsider", "on second thought", "scratch that", "hold on", "reconsidering", "i was wrong", "let me think", "now i'm realizing", "however")
CLUSTER_GAP, EXCERPT_MARGIN = 200, 50
#: File name endings that make a word a path (fixed values).
SUFFIXES = ("py", "js", "ts", "jsx", "tsx", "md", "yaml", "yml", "toml", "json", "sh", "sql", "html", "css", "rs", "go")


def _phrases(markers: tuple[str, ...]) -> str:
    return "|".join(sorted(markers, key=lambda m: (-len(m), m)))


def marker_pattern(markers: tuple[str, ...] = MARKERS) -> str:
    """Longest phrase first; a boundary before the phrase only, so longer words that begin with it count."""
    return f"(?i)(?<![\\p{{L}}\\p{{N}}_])(?:{_phrases(markers)})"


def marker_pattern_without_lookaround(markers: tuple[str, ...] = MARKERS) -> str:
    """The same for engines without lookaround: it takes the character before along, so texts need their commas doubled first."""
    return f"(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{_phrases(markers)})"


_ENDINGS = "|".join(sorted(SUFFIXES, key=lambda s: (-len(s), s)))


_FENCE = r"(?md)^```[\s\S]*?^```"


def strip_fences(text: Column) -> Column:
    return F.regexp_replace(text, _FENCE, "")


def mask_fences(text: Column) -> Column:
    """The text with every character of its fenced blocks that is no white space made a backquote: the same words and places, but no markers."""
    inside = F.transform(F.regexp_extract_all(text, F.lit(f"({_FENCE})")), lambda f: F.regexp_replace(f, r"(?U)[^\s\x{1C}-\x{1F}]", "`"))
    outside = F.split(text, _FENCE)
    return F.when(text.contains("```"), F.array_join(F.flatten(F.zip_with(outside, inside, lambda o, i: F.array(o, F.coalesce(i, F.lit(""))))), "")).otherwise(text)


def word_count(text: Column) -> Column:
    """Runs without white space. The separators x1C to x1F, which the engine's own class lacks, are made spaces first."""
    return F.regexp_count(F.translate(text, "\x1c\x1d\x1e\x1f", "    "), F.lit(r"(?U)\S+"))


def marker_count(text: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    return F.regexp_count(text, F.lit(marker_pattern(markers)))


def signals(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add length_words, length_chars, question_rate_per_100w, marker_count, markers_per_100w, all of them from outside of fences."""
    bare = documents.withColumn("_bare", strip_fences(F.col(text))).withColumn("length_words", word_count(F.col("_bare")).cast("long"))
    words = F.greatest(F.col("length_words"), F.lit(1))
    out = bare.withColumn("length_chars", F.length("_bare").cast("long")).withColumn("marker_count", marker_count(mask_fences(F.col(text))).cast("long"))
    return out.withColumn("question_rate_per_100w", F.regexp_count("_bare", F.lit(r"\?")) * 100.0 / words).withColumn("markers_per_100w", F.col("marker_count") * 100.0 / words).drop("_bare")


def marker_positions(documents: DataFrame, key: str, text: str = "text", markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """(key, nth, word_index, start, end, marker) of every marker outside of fences, in words (from 0) and code points of the whole text.

    One row a marker, in JVM code: the text is cut at the markers; what lies before a marker is the running sum of the pieces'
    words and lengths. A marker inside of a word has that word's index.
    """
    whole = documents.select(key, mask_fences(F.col(text)).alias("t"))
    p = marker_pattern(markers)
    cut = whole.select(key, F.regexp_extract_all("t", F.lit(f"({p})"), F.lit(1)).alias("m"), F.split(F.regexp_replace("t", f"({p})", "\u0001$1"), "\u0001").alias("s")).filter(F.size("m") > 0)
    pieces = cut.select(key, "m", F.posexplode("s").alias("nth", "piece"))
    lead = pieces.select(
        key, (F.col("nth") - 1).alias("nth"), F.try_element_at("m", F.when(F.col("nth") > 0, F.col("nth")).otherwise(10**6)).alias("marker"), F.length("piece").alias("size"), word_count(F.col("piece")).alias("words"),
        F.col("piece").rlike(r"(?U)^[\s\x{1C}-\x{1F}]").alias("opens"), F.col("piece").rlike(r"(?U)[^\s\x{1C}-\x{1F}]\z").alias("closes"),
    )
    w = Window.partitionBy(key).orderBy("nth")
    # a piece that begins inside a word joins the last word of the piece before
    joined = lead.withColumn("glued", (~F.col("opens")) & F.coalesce(F.lag("closes").over(w), F.lit(False)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    total = joined.withColumn("before", F.coalesce(F.sum(F.col("words") - F.col("glued").cast("int")).over(before), F.lit(0))).withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return total.filter("nth >= 0").select(key, F.col("nth").cast("long").alias("nth"), (F.col("before") - F.col("glued").cast("int")).cast("long").alias("word_index"), "start", (F.col("start") + F.length("marker")).alias("end"), F.lower("marker").alias("marker"))


def clusters(positions: DataFrame, key: str, gap: int = CLUSTER_GAP) -> DataFrame:
    """Add cluster_index: a marker more than ``gap`` words after the last begins a new cluster."""
    w = Window.partitionBy(key).orderBy("nth")
    new = F.coalesce((F.col("word_index") - F.lag("word_index").over(w) > gap).cast("long"), F.lit(0))
    return positions.withColumn("_new", new).withColumn("cluster_index", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def excerpts(documents: DataFrame, key: str, text: str = "text", gap: int = CLUSTER_GAP, margin: int = EXCERPT_MARGIN) -> DataFrame:
    """(key, cluster_index, cluster_count, text, highlights): each cluster of markers with ``margin`` words on both sides, from the whole text.

    highlights are structs of start, end and marker, relative to the excerpt, in order. A text without markers gives no rows. The word spans are
    found by cutting the text, so that all of it stays in JVM code.
    """
    c = clusters(marker_positions(documents, key, text), key, gap).groupBy(key, "cluster_index").agg(
        F.min("word_index").alias("first"), F.max("word_index").alias("last"), F.array_sort(F.collect_list(F.struct("start", "end", "marker"))).alias("hits")
    )
    c = c.withColumn("cluster_count", F.count("*").over(Window.partitionBy(key)))
    spaced = F.translate(F.col(text), "\x1c\x1d\x1e\x1f", "    ")
    j = c.join(documents.select(key, F.col(text).alias("_t"), spaced.alias("_s")), key)
    low = F.greatest(F.col("first") - margin, F.lit(0)).cast("int")
    # every word with the white space before it
    j = j.withColumn("_w", F.regexp_extract_all("_s", F.lit(r"(?U)\s*\S+"), F.lit(0)))
    part = lambda at, n: F.array_join(F.slice("_w", at, n), "")
    body = part(low + 1, (F.col("last") - low + margin + 1).cast("int"))
    j = j.withColumn("_body", F.regexp_replace(body, r"(?U)\A\s+", "")).withColumn("_at", F.length(part(F.lit(1), low)) + F.length(body) - F.length("_body"))
    lit = F.transform("hits", lambda h: F.struct((h["start"] - F.col("_at")).alias("start"), (h["end"] - F.col("_at")).alias("end"), F.substr(F.col("_t"), (h["start"] + 1).cast("int"), (h["end"] - h["start"]).cast("int")).alias("marker")))
    return j.select(key, "cluster_index", "cluster_count", F.substr("_t", F.col("_at") + 1, F.length("_body")).alias("text"), lit.alias("highlights"))


def cluster_weight(cluster_count: Column) -> Column:
    """A block's weight by its number of clusters: 1 + 0.2 for each beyond the first."""
    return F.lit(1.0) + 0.2 * F.greatest(cluster_count - 1, F.lit(0))


#: What ends a run of the whole scan, inside of a character class, and how a rooted path begins in it (fixed values).
SCAN_STOPS = r"\s\x{1C}-\x{1F}'\"`;|&<>$()\[\]{}*?:"
_ROOTED = r"(?:/|\./|\.\./)"


def path_scan(text: Column) -> Column:
    """Path-like words in order by the whole scan: rooted ones (/, ./ or ../, not within a word) whatever their ending, and those with a known ending.

    A run that begins rooted is one word; else it is taken up to its last known ending, and what follows, or a run without one, from
    its first rooted place. Runs are cut first, so the cost stays linear. Trailing ,;: go; the tails of addresses (//) are no paths.
    """
    runs = F.filter(F.split(text, f"(?U)[{SCAN_STOPS}]+"), lambda w: w.contains("/") | w.contains("."))
    rooted = lambda w: w.rlike(f"^{_ROOTED}")
    ended = F.transform(runs, lambda w: F.struct(w.alias("run"), F.when(rooted(w), w).otherwise(F.regexp_extract(w, r"(?Us)^(.+\.(?:" + _ENDINGS + r"))\b", 1)).alias("head")))
    rest = lambda r: F.substr(r["run"], F.length(r["head"]) + 1)
    inner = lambda r: F.when(r["head"] == "", F.regexp_extract(r["run"], r"(?Us)(?<!\w)" + _ROOTED + ".*", 0)).otherwise(F.regexp_extract(rest(r), r"(?Us)^.+?(?<!\w)(" + _ROOTED + ".*)$", 1))
    words = F.flatten(F.transform(ended, lambda r: F.array(r["head"], inner(r))))
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[,;:]+$", "")), lambda w: (w != "") & ~w.startswith("//"))


def redact_home(text: Column) -> Column:
    return F.regexp_replace(text, r"/(?:Users|home)/[^/\s]+", "~")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def relative_time(seconds: Column) -> Column:
    """Age as words: 'just now' under a minute, then whole minutes, then whole hours (there are no days)."""
    unit = F.when(seconds < 3600, "minute").otherwise("hour")
    n = F.floor(seconds / F.when(seconds < 3600, 60).otherwise(3600))
    return F.when(seconds < 60, "just now").otherwise(F.concat(n.cast("string"), F.lit(" "), unit, F.when(n == 1, "").otherwise("s"), F.lit(" ago")))


def fallback_title(prompt: Column, most: int = 60) -> Column:
    """First line of a prompt without a leading '# ', cut to ``most`` characters with an ellipsis."""
    line = F.regexp_replace(F.trim(F.split_part(F.regexp_replace(prompt, r"^\s+", ""), F.lit("\n"), F.lit(1))), "^# +", "")
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)
