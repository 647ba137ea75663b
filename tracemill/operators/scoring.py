"""File scores: shares of attributed blocks, presence times intensity, robust z of behaviour counts, ranking and corpus mode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.stats import robust_z

#: Weights of the signals that count (fixed values); the others are reported with weight 0.
WEIGHTS = {"markers": 0.25, "reread_bursts": 0.25 / 3, "edit_churn": 0.25 / 3}
RATIO_CAP = 100.0
#: Score floor, least files for a map, cliff ratio, ranks looked at, dominance share, tail share (fixed values).
FLOOR, LEAST_FILES, CLIFF, TOP, DOMINANCE, TAIL = 0.10, 10, 2.0, 3, 0.30, 0.25
#: Paths never reported: directories, endings and names (fixed values).
IGNORED_DIRS = (".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", ".next", ".cache", ".claude")
IGNORED_NAMES = r"(\.pyc$|^\.env$|^\.env\.|^\.DS_Store$)"


def ignored(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED_DIRS))) | F.element_at(parts, -1).rlike(IGNORED_NAMES)


#: Endings, names and directories of generated or vendored files (fixed values).
NOISE_ENDINGS = (".lock", ".min.js", ".min.css", ".snap", ".map")
NOISE_NAMES = ("package-lock.json", "pnpm-lock.yaml")
NOISE_DIRS = ("vendor", "dist", "generated")


def noisy(path: Column) -> Column:
    """Lock files, minified or generated files, and all below folders of such."""
    parts = F.split(path, "/")
    name = F.element_at(F.filter(parts, lambda p: p != ""), -1)
    ends = reduce(lambda a, b: a | b, (name.endswith(e) for e in NOISE_ENDINGS))
    return F.coalesce(ends | name.isin(*NOISE_NAMES), F.lit(False)) | F.arrays_overlap(parts, F.array(*map(F.lit, NOISE_DIRS)))


def block_aggregate(blocks: DataFrame, paths: str = "paths") -> DataFrame:
    """Per path: tangle_count (undiluted), weighted sums with share 1/N of a block's N paths, presence and intensity of markers."""
    n = F.size(F.array_distinct(paths))
    e = blocks.withColumn("share", F.try_divide(F.lit(1.0), n)).withColumn("path", F.explode(F.array_distinct(paths))).filter("path <> ''")
    pos = F.col("marker_count") > 0
    agg = e.groupBy("path").agg(
        F.count("*").alias("tangle_count"), F.sum("share").alias("weight"), F.sum(F.when(pos, F.col("share")).otherwise(0.0)).alias("positive_weight"), F.sum(F.when(pos, F.col("share") * F.col("markers_per_100w")).otherwise(0.0)).alias("positive_intensity"), F.sum(F.col("share") * F.col("length_words")).alias("weighted_words"), F.count_if("coupled").alias("coupled_count")
    )
    presence = F.coalesce(F.try_divide("positive_weight", "weight"), F.lit(0.0))
    intensity = F.coalesce(F.try_divide("positive_intensity", "positive_weight"), F.lit(0.0))
    return agg.withColumn("markers", presence * intensity).withColumn("mean_words", F.try_divide("weighted_words", "weight")).withColumn("resolution_rate", F.coalesce(F.try_divide("coupled_count", "tangle_count"), F.lit(0.0)))


def file_scores(aggregate: DataFrame, counts: dict[str, DataFrame], baselines: dict[str, tuple[float, float]] | DataFrame) -> DataFrame:
    """Full outer join of the block aggregate and per-path counts (columns path, n); markers count raw, the others as robust z.

    ``baselines`` has one row with <signal>_median and <signal>_mad; being one row, it is broadcast.
    """
    out = aggregate.select("path", "tangle_count", "markers", "resolution_rate")
    for name, c in counts.items():
        out = out.join(c.select("path", F.col("n").alias(name)), "path", "full_outer")
    out = out.na.fill(0, ["tangle_count", *counts]).na.fill(0.0, ["markers", "resolution_rate"])
    out = out.join(F.broadcast(baselines.limit(1)), F.lit(True), "left")
    z = {n: robust_z(F.col(n).cast("double"), F.coalesce(f"{n}_median", F.lit(0.0)), F.coalesce(f"{n}_mad", F.lit(0.0))) for n in counts}
    score = F.col("markers") * WEIGHTS["markers"] + sum((z[n] * WEIGHTS.get(n, 0.0) for n in counts), F.lit(0.0))
    return out.select("path", "tangle_count", "markers", "resolution_rate", *counts, score.alias("score"))


def ranked(scores: DataFrame, most: int = 20) -> DataFrame:
    return scores.orderBy(F.desc("score"), "path").limit(most)


def corpus_mode(scores: DataFrame) -> DataFrame:
    """One row: mode (empty, calm, healthy), files, meaningful files, standouts (leading files before a cliff, else dominant ones).

    Only the four leading files and two sums are needed, so no global window is built.
    """
    s = scores.select("path", "score")
    total = s.agg(F.count("*").alias("n_files"), F.count_if(F.col("score") >= FLOOR).alias("n_meaningful"), F.sum(F.when(F.col("score") >= FLOOR, F.col("score")).otherwise(0.0)).alias("total_score"))
    lead = s.filter(F.col("score") >= FLOOR).orderBy(F.desc("score"), "path").limit(TOP + 1).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "path"))).alias("top"))
    j = total.join(F.broadcast(lead), F.lit(True))
    at = lambda i: -F.try_element_at("top", F.lit(i))["neg"]
    cliff = F.coalesce(*(F.when(F.try_divide(at(i), at(i + 1)) >= CLIFF, F.lit(i)) for i in range(1, TOP + 1)))
    dom = [F.coalesce(F.try_divide(at(i), F.col("total_score")) >= DOMINANCE, F.lit(False)) for i in range(1, TOP + 1)]
    prefix = F.when(~dom[0], 0).when(~dom[1], 1).when(~dom[2], 2).otherwise(3)
    mode = F.when(F.col("n_meaningful") == 0, "empty").when(F.col("n_meaningful") < LEAST_FILES, "calm").otherwise("healthy")
    return j.select(mode.alias("mode"), "n_files", "n_meaningful", F.when(mode == "healthy", F.coalesce(cliff, prefix)).otherwise(0).cast("long").alias("n_standouts"))


def top_per_group(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The leading rows of each group: salted ranks first, so a hot group is cut down in parts before one task ranks it."""
    salted = Window.partitionBy(key, "_salt").orderBy(*order)
    cut = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(32))).withColumn("_r", F.row_number().over(salted)).filter(F.col("_r") <= most)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).filter(F.col("rank") <= most).drop("_salt", "_r")


def capped_ratio(over: Column, under: Column, cap: float = RATIO_CAP) -> Column:
    return F.least(over / F.greatest(under, F.lit(1)), F.lit(cap))


def colour_bin(share: Column) -> Column:
    return F.least(F.lit(5), F.greatest(F.lit(0), F.floor(share * 6))).cast("long")
