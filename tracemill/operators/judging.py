"""Judge runs: scores of the ledger, metrics of passes, bands, two-sample bootstrap, pools, draws, sheets and their seals."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators import joins, stats
from tracemill.operators.sampling import stratified
from tracemill.operators.windows import running

#: Least kappa of the bands (fixed values); a rate above which a folder is dropped.
BANDS = (("substantial", 0.6), ("moderate", 0.4))
DROP_RATE = 0.10
UNIT = ["session_id", "block_index"]


def pass_scores(attempts: DataFrame) -> DataFrame:
    """(pass_id, session_id, block_index, sheet_position, score) of complete units; the others are left out.

    A unit is complete if an attempt is valid or there are two; its score is the first valid attempt's, null if none is.
    """
    place = attempts.groupBy("pass_id", *UNIT).agg(F.min("sheet_position").alias("sheet_position"))
    final = joins.final_attempts(attempts, ["pass_id", *UNIT]).filter("complete")
    on = _same(["pass_id", *UNIT])
    return final.join(_marked(place, ["pass_id", *UNIT], "sheet_position"), on).select("pass_id", *UNIT, "sheet_position", F.when(F.col("score").between(0, 3), F.col("score")).alias("score"))


def _same(keys: list[str]) -> Column:
    return stats._same(keys)


def _marked(df: DataFrame, keys: list[str], *rest: str) -> DataFrame:
    return stats._marked(df, keys, *rest)


def pass_metrics(attempts: DataFrame, reference: DataFrame, categories: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """Per pass: units, complete ones, scored ones, mean score, and agreement with ``reference`` (session_id, block_index, score): units
    in both, exact agreement, mean absolute difference, quadratic-weighted kappa and its band."""
    s = pass_scores(attempts)
    units = attempts.groupBy("pass_id").agg(F.countDistinct(F.struct(*UNIT)).alias("n_units"))
    mine = s.groupBy("pass_id").agg(F.count("*").alias("n_complete"), F.count("score").alias("n_scored"), F.avg("score").alias("mean_score"))
    pairs = s.filter("score is not null").join(reference.select(*UNIT, F.col("score").alias("_ref")).dropna(), UNIT)
    same = pairs.groupBy("pass_id").agg(*stats.weighted_kappa(pairs, "score", "_ref", list(categories)), F.avg((F.col("score") == F.col("_ref")).cast("double")).alias("exact"), F.avg(F.abs(F.col("score") - F.col("_ref"))).alias("mean_difference"))
    k = stats.kappa_of(same, list(categories), ["pass_id", "exact", "mean_difference"]).withColumnRenamed("n", "n_pairs")
    out = units.join(mine, "pass_id", "left").join(k.drop("observed", "expected"), "pass_id", "left")
    return out.na.fill(0, ["n_complete", "n_scored", "n_pairs"]).withColumn("band", band(F.col("kappa")))


def band(kappa: Column) -> Column:
    """The case that a kappa falls in; null for none."""
    out = F.when(kappa >= BANDS[0][1], BANDS[0][0])
    for name, least in BANDS[1:]:
        out = out.when(kappa >= least, name)
    return out.when(kappa.isNotNull(), "low")


def score_histogram(scores: DataFrame, group: str, score: str = "score", categories: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """Counts of each score per group, zeros filled, and their total."""
    return scores.groupBy(group).agg(*(F.count_if(F.col(score) == c).alias(f"n_{c}") for c in categories), F.count(score).alias("n"))


def scores_by_file(scores: DataFrame, unit_paths: DataFrame) -> DataFrame:
    """(path, n_units, mean_score): a unit of several files counts for each. ``unit_paths``: session_id, block_index, path."""
    return scores.filter("score is not null").join(unit_paths.select(*UNIT, "path").distinct(), UNIT).groupBy("path").agg(F.count("*").alias("n_units"), F.avg("score").alias("mean_score"))


def over_threshold(failed: Column, total: Column, most: float = DROP_RATE) -> Column:
    """Strictly more than that share; nothing of nothing is none."""
    return F.coalesce(F.try_divide(failed, total) > most, F.lit(False))


def bootstrap_difference(values: DataFrame, group: str, value: str, first: str, second: str, resamples: int = 10_000, seed: int = 26, blocks: int = 16) -> DataFrame:
    """Mean of ``first`` minus mean of ``second`` with its percentile interval: difference, low, high.

    Each group is resampled by itself. Values are counted first, so a resample is a multinomial draw from the few distinct ones and costs the
    same for any number of rows.
    """
    table = values.filter(F.col(group).isin(first, second)).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")).filter("v is not null")
    cells = table.groupBy().agg(F.sort_array(F.collect_list(F.struct("g", "v", "n"))).alias("cells"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cells_, block in zip(pdf["cells"], pdf["block"], strict=True):
                sides = [[np.array([c[k] for c in cells_ if c["g"] == g]) for k in ("v", "n")] for g in (first, second)]
                if not all(len(v) for v, _ in sides):
                    continue
                rng = np.random.default_rng([seed, int(block)])
                size = -(-resamples // blocks)
                means = [(rng.multinomial(n.sum(), n / n.sum(), size=size) @ v) / n.sum() for v, n in sides]
                point = [float(v @ n) / n.sum() for v, n in sides]
                yield pd.DataFrame({"point": np.full(size, point[0] - point[1]), "d": means[0] - means[1]})

    spread = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.mapInPandas(draw, "point double, d double").agg(F.max("point").alias("difference"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"))


def hot_calm(density: DataFrame, session: str, value: str, hot: int, calm: int) -> DataFrame:
    """The ``hot`` sessions of most density and, of the rest, the ``calm`` ones of least; ties go by session. (session, density, kind, rank)"""
    top = density.filter(F.col(value).isNotNull()).orderBy(F.desc(value), session).limit(hot).withColumn("kind", F.lit("hot"))
    rest = density.filter(F.col(value).isNotNull()).join(top.select(session), session, "left_anti").orderBy(value, session).limit(calm).withColumn("kind", F.lit("calm"))
    both = top.unionByName(rest)  # at most hot + calm rows
    order = F.when(F.col("kind") == "hot", -F.col(value)).otherwise(F.col(value))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(order, session)).cast("long")).select(session, value, "kind", "rank")


def pool(blocks: DataFrame, excluded: DataFrame | None = None, corpus: str = "corpus", marked: str = "marked", attached: str = "attached") -> DataFrame:
    """The units that may be drawn: (corpus, session_id, block_index, marked, attached), each once, without those of excluded sessions."""
    p = blocks.select(corpus, *UNIT, F.coalesce(F.col(marked), F.lit(False)).alias("marked"), F.coalesce(F.col(attached), F.lit(False)).alias("attached")).dropna(subset=UNIT)
    p = p.groupBy(corpus, *UNIT).agg(F.max("marked").alias("marked"), F.max("attached").alias("attached"))
    return p if excluded is None else p.join(excluded.select("session_id").distinct(), "session_id", "left_anti")


def draw(units: DataFrame, random: int, oversample: int, reserve: int, relabel: int, seed: int = 18) -> DataFrame:
    """(stratum, session_id, block_index, rank, sheet_position, relabelled): a random draw, an oversample of marked units from the rest, and reserves.

    All draws go by hashed order, so they are repeatable and need no stream of random numbers; drawn units get positions of a sheet, shuffled
    by another hash; the first ``relabel`` of a third order are to be labelled twice. Reserves have rank only.
    """
    key = F.concat_ws("\t", *UNIT)
    u = units.withColumn("_key", key)
    by = lambda salt: F.md5(F.concat(F.lit(f"{seed}:{salt}:"), F.col("_key")))
    first = u.orderBy(by("random"), "_key").limit(random + reserve).withColumn("rank", F.row_number().over(Window.orderBy(by("random"), "_key")))  # few rows: the limit's
    first = first.withColumn("stratum", F.when(F.col("rank") <= random, "random").otherwise("random_reserve"))
    rest = u.filter("marked").join(first.filter("stratum = 'random'").select("_key"), "_key", "left_anti")
    second = rest.orderBy(by("oversample"), "_key").limit(oversample + reserve).withColumn("rank", F.row_number().over(Window.orderBy(by("oversample"), "_key")))
    second = second.withColumn("stratum", F.when(F.col("rank") <= oversample, "oversample").otherwise("oversample_reserve"))
    cols = ["stratum", *UNIT, "rank", "_key"]
    both = first.select(cols).unionByName(second.select(cols))
    drawn = F.col("stratum").isin("random", "oversample")
    place = F.row_number().over(Window.partitionBy(drawn).orderBy(by("sheet"), "_key"))
    again = F.row_number().over(Window.partitionBy(drawn).orderBy(by("relabel"), "_key")) <= relabel
    return both.select("stratum", *UNIT, F.col("rank").cast("long").alias("rank"), F.when(drawn, place).cast("long").alias("sheet_position"), (drawn & again).alias("relabelled"))


def draw_by_agent(rows: DataFrame, family: str, agent: str, key: str, per_family: dict[str, int], seed: int) -> DataFrame:
    """A fixed number of rows per family, no two of one agent: the first by hash of each agent, then the first agents by hash."""
    one = stratified(rows.filter(F.col(family).isin(*per_family)).select(family, agent, key), agent, key, 1, seed).drop("rank")
    ranked = one.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:agent:"), agent)))
    n = F.row_number().over(Window.partitionBy(family).orderBy("_h", agent))  # one row an agent
    most = F.coalesce(*(F.when(F.col(family) == f, k) for f, k in per_family.items()))
    return ranked.withColumn("rank", n.cast("long")).filter(F.col("rank") <= most).select(family, agent, key, "rank")


def blocks_of(blocks: DataFrame, wanted: DataFrame, what: str = "text") -> DataFrame:
    """The wanted units (session_id, block_index, ...) with their block; a unit without one is an error when it is read."""
    j = wanted.join(blocks.select(*UNIT, what).withColumn("_there", F.lit(True)), UNIT, "left")
    miss = F.raise_error(F.concat(F.lit("no block for "), F.to_json(F.struct(*UNIT))))
    return j.withColumn(what, F.when(F.col("_there"), F.col(what)).otherwise(miss.cast("string"))).drop("_there")


def anchor_units(blocks: DataFrame, sessions: DataFrame, least: int = 5) -> DataFrame:
    """Blocks of the listed sessions that have ``least`` of them, in order of (session_id, block_index), with positions from 1."""
    mine = blocks.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    large = mine.groupBy("session_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("session_id")
    at = running(mine.join(large, "session_id", "left_semi"), [], UNIT, position="_i")
    return at.withColumn("sheet_position", F.col("_i") + 1).drop("_i")


def sheet_hash(rows: DataFrame, position: str, text: str) -> DataFrame:
    """One row: the hash of a sheet's texts in order, to tell whether it was rendered from the same units. Sheets are small by design."""
    line = F.concat(F.col(position).cast("string"), F.lit("\t"), F.coalesce(F.sha2(text, 256), F.lit("")))
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, line.alias("line")))), lambda x: x["line"]), "\n"), 256).alias("sheet_hash"), F.count("*").alias("n"))


def write_sheet(rows: DataFrame, path: str, columns: list[str], order: list[str]) -> int:
    """One CSV file in the shared folder, in order, nulls blank; returns the number of rows."""
    rows.select(*columns, *(c for c in order if c not in columns)).orderBy(*order).select(*columns).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    return rows.sparkSession.read.option("header", True).csv(path).count()


def file_hashes(spark, path: str) -> DataFrame:
    """(path, sha256) of every file below a folder: the hash manifest."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", F.sha2("content", 256).alias("sha256"))


def read_hashes(lines: DataFrame) -> DataFrame:
    """(path, sha256) of a manifest's lines '<sha>  <path>'; comments and blank lines are passed over, other lines have a null hash."""
    t = lines.select(F.trim("value").alias("v")).filter(~F.col("v").startswith("#") & (F.col("v") != ""))
    good = F.col("v").rlike(r"^[0-9a-f]{64}\s+\S")
    return t.select(F.when(good, F.regexp_extract("v", r"^[0-9a-f]{64}\s+(.+)$", 1)).otherwise(F.col("v")).alias("path"), F.when(good, F.substring("v", 1, 64)).alias("sha256"))


def _replace(path: Path, text: str) -> None:
    """Write beside the file and move it there, so that readers see the old or the new one."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    with part.open("w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    part.replace(path)


def update_manifest(folder: str, updates: dict) -> dict:
    """The run's manifest with these members set, others kept; a missing manifest is an empty one."""
    path = Path(folder, "manifest.json")
    now = json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
    now |= updates
    _replace(path, json.dumps(now, indent=1, sort_keys=True))
    return now


def write_seal(path: str, seeds: dict[str, int], counts: dict[str, int], outputs: list[str]) -> str:
    """Seeds, pool counts and the hashes of the files drawn, one a line; the seal's own hash comes back."""
    lines = [f"seed {k} {v}" for k, v in sorted(seeds.items())] + [f"count {k} {v}" for k, v in sorted(counts.items())]
    lines += [f"{hashlib.sha256(Path(p).read_bytes()).hexdigest()}  {Path(p).name}" for p in sorted(outputs)]
    text = "\n".join(lines) + "\n"
    _replace(Path(path), text)
    return hashlib.sha256(text.encode()).hexdigest()


def split_prompt(text: str, marker: str) -> tuple[str, str]:
    """What stands before and after the one line that is the marker; none or several are an error."""
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if x.strip() == marker]
    if len(at) != 1:
        raise ValueError(f"{len(at)} lines are {marker!r}")
    return "\n".join(lines[: at[0]]), "\n".join(lines[at[0] + 1 :])


def prompts(units: DataFrame, before: str, after: str, text: str = "text") -> DataFrame:
    """Units with ``prompt``: their text between the halves of a template, put in once, so that it may hold anything."""
    return units.withColumn("prompt", F.concat(F.lit(before), F.coalesce(F.col(text), F.lit("")), F.lit(after)))


def merge_counters(rows: DataFrame, key: str, sums: list[str], started: str, notes: str) -> DataFrame:
    """Counters of one pass over several runs: sums, the earliest start, notes in order of their start."""
    return rows.groupBy(key).agg(*(F.sum(c).alias(c) for c in sums), F.min(started).alias(started), F.transform(F.array_sort(F.collect_list(F.struct(started, notes))), lambda x: x[notes]).alias(notes))
