"""Percentiles of very large numeric columns by mergeable centroid digests, with rank errors certified by counting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.runtime import checkpointed, looked_up

#: Size of a digest: no cluster spans more than one unit of the scale function, which has this many.
DELTA = 400
#: Values buffered for a group before they are clustered, and groups held in a worker before all are emitted.
BUFFER, GROUPS = 8192, 4096
PROBABILITIES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: The rank error that a percentile keeps to, as a share of its group (or one row, for small groups).
BOUND = 0.005

_PARTIAL = "dimension string, group_key string, salt int, means array<double>, weights array<double>, low double, high double"


def scale(q: np.ndarray, delta: int = DELTA) -> np.ndarray:
    """The size function: steep at both ends, so that clusters there are small."""
    return delta / np.pi * np.arcsin(np.clip(2 * q - 1, -1, 1))


def compress(means: np.ndarray, weights: np.ndarray, delta: int = DELTA) -> tuple[np.ndarray, np.ndarray]:
    """Cluster values (or centroids) in sorted order; those whose middle rank falls in one unit of the scale become one."""
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    upto = np.cumsum(weights)
    cell = np.floor(scale((upto - weights / 2) / upto[-1], delta))
    starts = np.flatnonzero(np.concatenate(([True], np.diff(cell) > 0)))
    w = np.add.reduceat(weights, starts)
    m = np.add.reduceat(means * (weights / np.repeat(w, np.diff(np.append(starts, len(weights))))), starts)
    return np.clip(m, means[starts], means[np.append(starts[1:], len(means)) - 1]), w  # a cluster of equal values keeps the value itself


def quantile(means: np.ndarray, weights: np.ndarray, low: float, high: float, q: np.ndarray) -> np.ndarray:
    """Values at ranks q n, linear between the clusters' middle ranks and the extremes."""
    n = weights.sum()
    middle = np.cumsum(weights) - weights / 2
    return np.interp(q * n, np.concatenate(([0.0], middle, [n])), np.concatenate(([low], means, [high])))


class _Builder:
    def __init__(self) -> None:
        self.means, self.weights, self.new, self.held, self.low, self.high = np.empty(0), np.empty(0), [], 0, np.inf, -np.inf

    def add(self, values: np.ndarray) -> None:
        self.new.append(values)
        self.held += len(values)
        self.low, self.high = min(self.low, values.min()), max(self.high, values.max())
        if self.held >= BUFFER:
            self.flush()

    def flush(self) -> None:
        if self.held:
            x = np.concatenate([self.means, *self.new])
            self.means, self.weights = compress(x, np.concatenate([self.weights, np.ones(self.held)]))
            self.new, self.held = [], 0

    def row(self, dimension: str, key: str | None, salt: int) -> tuple:
        self.flush()
        return dimension, key, salt, self.means, self.weights, self.low, self.high


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = TaskContext.get().partitionId() % 64
    held: dict[tuple, _Builder] = {}

    def out() -> pa.RecordBatch:
        rows = [b.row(d, k, salt) for (d, k), b in held.items()]
        held.clear()
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64())
        names = [c.split()[0] for c in _PARTIAL.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=names)

    for batch in batches:
        values = batch.column("value").to_numpy(zero_copy_only=False)
        for name in batch.schema.names[1:]:
            codes = batch.column(name).dictionary_encode()
            k = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(k, kind="stable")
            cuts = np.flatnonzero(np.diff(k[order])) + 1
            keys = [*codes.dictionary.to_pylist(), None]
            for part in np.split(order, cuts) if len(order) else []:
                held.setdefault((name, keys[k[part[0]]]), _Builder()).add(values[part])
        if len(held) > GROUPS:
            yield out()
    yield out()


def _recluster(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pairs = [compress(np.asarray(m), np.asarray(w)) for m, w in zip(pdf["means"], pdf["weights"], strict=True)]
        yield pdf.assign(means=[m for m, _ in pairs], weights=[w for _, w in pairs])


def _merge_by(digests: DataFrame, salt: Column) -> DataFrame:
    lists = digests.groupBy("dimension", "group_key", salt.alias("salt")).agg(F.collect_list(F.struct("means", "weights")).alias("x"), F.min("low").alias("low"), F.max("high").alias("high"))
    joined = lists.select("dimension", "group_key", "salt", F.flatten(F.transform("x", lambda d: d["means"])).alias("means"), F.flatten(F.transform("x", lambda d: d["weights"])).alias("weights"), "low", "high")
    return joined.mapInPandas(_recluster, _PARTIAL)


def merge_digests(digests: DataFrame) -> DataFrame:
    """One digest a (dimension, group_key) from any number of them (partitions, days): re-clustered per salt, then over the 64 salts."""
    return _merge_by(_merge_by(digests, F.col("salt")), F.lit(0))


def digests(values: DataFrame, dimensions: list[str]) -> DataFrame:
    """Digests of ``value`` per group of each dimension (string columns), built in one narrow pass and merged.

    Each task emits at most one digest of a group (more, if it meets over 4,096 groups), so a hot group costs what a cold one does.
    """
    part = values.select("value", *dimensions).mapInArrow(_partials, _PARTIAL)
    return merge_digests(part)


def _estimates(batches: Iterator[pd.DataFrame], probabilities: tuple[float, ...]) -> Iterator[pd.DataFrame]:
    q = np.array(probabilities)
    for pdf in batches:
        est = [quantile(np.asarray(r.means), np.asarray(r.weights), r.low, r.high, q) for r in pdf.itertuples()]
        yield pd.DataFrame({"dimension": pdf["dimension"], "group_key": pdf["group_key"], "estimates": est})


def percentiles(values: DataFrame, dimensions: list[str], probabilities: tuple[float, ...] = PROBABILITIES, built: DataFrame | None = None) -> DataFrame:
    """Percentiles per group: dimension, group_key, n, probability, estimate, rank_low, rank_high, rank_error, certified.

    ``values`` holds ``value`` DOUBLE and one string column for each dimension; null, NaN and infinite values are left out, null keys are
    a group of their own. The second pass counts, for each estimate, the values below and up to it: its true ranks are rank_low to
    rank_high, rank_error is how far n p lies outside of them as a share of n, and certified says whether that is within
    ``BOUND`` or one row. The estimates join the values as one array a group, broadcast only if they are counted to be
    few (see ``looked_up``), and counts are summed before they are shuffled. ``built`` takes digests made earlier, e.g. merged from days.
    """
    clean = values.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))))
    made = digests(clean, dimensions) if built is None else built
    est = checkpointed(made.mapInPandas(lambda b: _estimates(b, probabilities), "dimension string, group_key string, estimates array<double>"))
    long = clean.select("value", F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("k")) for d in dimensions))).alias("g")).select("value", "g.dimension", "g.k")
    pair = looked_up(long, est.withColumnRenamed("group_key", "k"), ["dimension", "k"])
    counts = pair.groupBy("dimension", F.col("k").alias("group_key")).agg(
        F.count("*").alias("n"), *(F.count_if(F.col("value") < F.col("estimates")[i]).alias(f"lo{i}") for i in range(len(probabilities))), *(F.count_if(F.col("value") <= F.col("estimates")[i]).alias(f"hi{i}") for i in range(len(probabilities)))
    )
    all_ = counts.alias("c").join(est.alias("e"), (F.col("c.dimension") == F.col("e.dimension")) & F.col("c.group_key").eqNullSafe(F.col("e.group_key")))
    item = F.explode(F.array(*(F.struct(F.lit(p).alias("probability"), F.col("estimates")[i].alias("estimate"), F.col(f"lo{i}").alias("rank_low"), F.col(f"hi{i}").alias("rank_high")) for i, p in enumerate(probabilities))))
    out = all_.select("c.dimension", "c.group_key", "n", item.alias("p")).select("dimension", "group_key", "n", "p.*")
    off = F.greatest(F.col("rank_low") - F.col("n") * F.col("probability"), F.col("n") * F.col("probability") - F.col("rank_high"), F.lit(0.0))
    return out.withColumn("rank_error", off / F.col("n")).withColumn("certified", off <= F.greatest(F.lit(1.0), F.col("n") * BOUND))


def once(rows: DataFrame, key: str, columns: list[str], newest: Column) -> DataFrame:
    """Each key's newest row (ties: the greatest values), the others being the same row loaded again; rows without key stay."""
    latest = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(newest.alias("_at"), *columns)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in columns))
    return latest.unionByName(rows.filter(F.col(key).isNull()).select(key, *columns))


def block_lengths(block_signals: DataFrame) -> DataFrame:
    """Valid word counts, each block once: present and not negative; with file, corpus and day as string keys."""
    b = once(block_signals, "block_id", ["length_words", "file_path", "corpus", "obs_date"], F.col("loaded_at"))
    return b.filter("length_words >= 0").select(F.col("length_words").cast("double").alias("value"), "file_path", "corpus", F.col("obs_date").cast("string").alias("obs_date"))


def baseline_values(baseline_stats: DataFrame) -> DataFrame:
    """Valid medians and MADs as values keyed by signal; a MAD is never negative."""
    b = once(baseline_stats, "stat_id", ["signal_name", "median", "mad"], F.col("computed_at"))
    long = b.select(F.explode(F.array(F.struct(F.concat_ws(":", F.lit("median"), "signal_name").alias("stat"), F.col("median").alias("value")), F.struct(F.concat_ws(":", F.lit("mad"), "signal_name").alias("stat"), F.when(F.col("mad") >= 0, F.col("mad")).alias("value")))).alias("x")).select("x.*")
    return long.select("value", "stat")


def daily_digests(values: DataFrame, day: str, key: str) -> DataFrame:
    """Digests per day and key, to be kept and merged later: group_key is the key, the day only tells them apart."""
    apart = values.select("value", F.to_json(F.struct(F.col(key).alias("k"), F.col(day).alias("d"))).alias(key))
    return digests(apart, [key]).withColumn("day", F.get_json_object("group_key", "$.d")).withColumn("group_key", F.get_json_object("group_key", "$.k"))


def mad(values: DataFrame, dimension: str) -> DataFrame:
    """Median and median absolute deviation per group, both from digests."""
    med = percentiles(values, [dimension], (0.5,)).select("group_key", F.col("estimate").alias("median"), F.col("n"), F.col("rank_error").alias("median_rank_error"))
    clean = values.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))))
    v = looked_up(clean, checkpointed(med.select(F.col("group_key").alias(dimension), "median")), [dimension]).select(F.abs(F.col("value") - F.col("median")).alias("value"), dimension)
    dev = percentiles(v, [dimension], (0.5,)).select(F.col("group_key").alias("gk"), F.col("estimate").alias("mad"), F.col("rank_error").alias("mad_rank_error"))
    return med.join(dev, med["group_key"].eqNullSafe(dev["gk"])).drop("gk")

