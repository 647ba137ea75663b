"""Robust statistics, agreement, correlation and exact small-sample quantiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.windows import running
from tracemill.runtime import checkpointed

LOW_CONFIDENCE_N, Z_FACTOR = 20, 1.4826
#: Distinct values of all groups that one task may sort.
FEW_VALUES = 200_000


def _same(keys: list[str], mark: str = "_k_") -> Column:
    """Whether the keys of two sides are the same, nulls being equal."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{mark}{k}"))
    return on


def _marked(df: DataFrame, keys: list[str], *rest: str, mark: str = "_k_") -> DataFrame:
    return df.select(*(F.col(k).alias(f"{mark}{k}") for k in keys), *rest)


def medians(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median, n): exact medians of the values that are there.

    Equal values are counted first, their counts summed in order, and the two middle ones picked. Up to ``FEW_VALUES`` distinct ones that
    is one window a group, beyond it goes over ranges of the whole table: no large group is held or sorted in one task.
    """
    counts = checkpointed(values.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c")))
    if counts.count() <= FEW_VALUES:
        group = Window.partitionBy(*(keys or [F.lit(0)]))
        j = counts.withColumn("_upto", F.sum("_c").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("_c").over(group))
    else:
        upto = running(counts, keys, [value], {"_upto": F.col("_c")}).drop("position")
        n = _marked(upto.groupBy(*keys).agg(F.sum("_c").alias("n")), keys, "n")
        j = upto.join(n, _same(keys)) if keys else upto.join(F.broadcast(n), F.lit(True))  # without keys one row
    # both 0-based middle positions, which one value may cover
    cover = lambda p: (F.col("_upto") - F.col("_c") <= p) & (p < F.col("_upto"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    x = F.col(value).cast("double")
    return j.groupBy(*keys).agg(((F.max(F.when(cover(low), x)) + F.max(F.when(cover(high), x))) / 2).alias("median"), F.max("n").alias("n"))


def median_mad(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median and MAD with n and low_confidence per group (see ``medians``); a group without values has 0, 0 and n 0."""
    groups = values.select(*keys).distinct() if keys else None
    med = checkpointed(medians(values, keys, value))
    m = _marked(med, keys, F.col("median").alias("_m"))
    dev = values.join(m, _same(keys)) if keys else values.join(F.broadcast(m), F.lit(True))  # without keys one row
    mad = medians(dev.select(*keys, F.abs(F.col(value) - F.col("_m")).alias("_d")), keys, "_d")
    out = med.join(_marked(mad, keys, F.col("median").alias("mad")), _same(keys), "left").select(*keys, "median", "mad", "n")
    if groups is not None:
        out = groups.join(_marked(out, keys, "median", "mad", "n"), _same(keys), "left")
    return out.select(*keys, F.coalesce("median", F.lit(0.0)).alias("median"), F.coalesce("mad", F.lit(0.0)).alias("mad"), F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) < LOW_CONFIDENCE_N).alias("low_confidence"))


def robust_z(raw: Column, median: Column, mad: Column) -> Column:
    """Robust z of any baseline: a median or MAD that is null or NaN counts as 0, a MAD of 0 or less gives 0; only raw may make it null or NaN."""
    median, mad = (F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0)) for c in (median, mad))
    return F.when(mad <= 0, F.lit(0.0)).otherwise((raw - median) / (Z_FACTOR * mad))


def presence_intensity(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of positive values and the exact median of those, with both counts."""
    x = F.col(value)
    share = values.groupBy(*keys).agg(F.avg((x > 0).cast("double")).alias("presence_rate"), F.count(x).alias("n"), F.count_if(x > 0).alias("n_positive"))
    mid = _marked(medians(values.filter(x > 0), keys, value), keys, F.col("median").alias("_m"))
    out = share.join(mid, _same(keys), "left") if keys else share.join(F.broadcast(mid), F.lit(True), "left")  # without keys one row
    return out.select(*keys, "presence_rate", F.coalesce("_m", F.lit(0.0)).alias("intensity_median"), "n", "n_positive", (F.col("n_positive") < LOW_CONFIDENCE_N).alias("low_confidence"))


def confusion(pairs: DataFrame, a: str, b: str, categories: list[int], keys: list[str] | None = None) -> DataFrame:
    """Zero-filled confusion counts: one row for each a, a column c_<b> for each b."""
    return pairs.groupBy(*(keys or []), a).pivot(b, categories).count().na.fill(0).select(*(keys or []), a, *(F.col(str(c)).alias(f"c_{c}") for c in categories))


def weighted_kappa(pairs: DataFrame, a: str, b: str, categories: list[int]) -> list[Column]:
    """Aggregates whose results give quadratic-weighted kappa: one pass, as a group's expected disagreement is made of marginal counts."""
    return [F.count("*").alias("n"), F.sum((F.col(a) - F.col(b)) ** 2).cast("double").alias("_d"), *(F.count_if(F.col(a) == c).alias(f"_a{c}") for c in categories), *(F.count_if(F.col(b) == c).alias(f"_b{c}") for c in categories)]


def kappa_of(grouped: DataFrame, categories: list[int], keep: list[str]) -> DataFrame:
    n = F.col("n").cast("double")
    expected = sum((F.col(f"_a{i}") * F.col(f"_b{j}") * float((i - j) ** 2) for i in categories for j in categories if i != j), F.lit(0.0)) / (n * n)
    observed = F.col("_d") / n
    return grouped.select(*keep, "n", observed.alias("observed"), expected.alias("expected"), F.when(expected > 0, F.lit(1.0) - observed / expected).alias("kappa"))


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1 with ties at their mean; nulls get none. Distinct values are counted first and their counts summed in order."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    upto = running(counts, keys, [value], {"_upto": F.col("_c")})
    rank = upto.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col(value).alias("_v"), (F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(name))
    on = F.col(value) == F.col("_v")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(rank, on, "left").select(*df.columns, name)


def guarded_corr(x: str, y: str) -> Column:
    """Pearson's r; 0 where a side is constant, as division by zero is an error in ANSI mode."""
    ok = (F.var_pop(x) > 0) & (F.var_pop(y) > 0)
    n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    cov, sx, sy = F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)
    return F.when(ok & (n > 1), F.try_divide(cov, sx * sy)).otherwise(F.lit(0.0))


def index_percentiles(df: DataFrame, keys: list[str], value: str, parts: dict[str, Column]) -> DataFrame:
    """Values at positions of the sorted group, no interpolation: ``parts`` maps a name to the 0-based position in terms of n.

    Positions are found by a sort over ranges; no group is collected into a list or sorted in one task.
    """
    x = running(df.filter(F.col(value).isNotNull()).select(*keys, value), keys, [value], position="_i")
    n = x.groupBy(*keys).agg(F.count("*").alias("n")).select(*(F.col(k).alias(f"_k_{k}") for k in keys), "n")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    x = x.join(n, on)
    return x.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("_i") == p, F.col(value))).alias(name) for name, p in parts.items()))


def bootstrap_kappa(pairs: DataFrame, a: str, b: str, resamples: int = 10_000, seed: int = 27, blocks: int = 16) -> DataFrame:
    """Percentile interval of quadratic-weighted kappa: kappa, low, high.

    Kappa needs only the table of score pairs, so the pairs are counted first and each resample is one multinomial draw from that
    table: the cost doesn't depend on the number of rows.
    """
    table = pairs.groupBy(F.col(a).cast("int").alias("x"), F.col(b).cast("int").alias("y")).agg(F.count("*").alias("n")).filter("x is not null and y is not null")
    cells = table.groupBy().agg(F.sort_array(F.collect_list(F.struct("x", "y", "n"))).alias("cells"))

    def kappas(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        k = int(max(x.max(), y.max())) + 1
        total = n.sum(-1)
        d = (n * (x - y) ** 2).sum(-1) / total
        pa = np.stack([n[..., x == c].sum(-1) for c in range(k)], -1)
        pb = np.stack([n[..., y == c].sum(-1) for c in range(k)], -1)
        w = (np.arange(k)[:, None] - np.arange(k)[None, :]) ** 2
        e = np.einsum("...i,ij,...j->...", pa, w, pb) / total**2
        return np.where(e > 0, 1 - d / np.where(e > 0, e, 1), np.nan)

    def draw(batches):
        for pdf in batches:
            for cells_, block in zip(pdf["cells"], pdf["block"], strict=True):
                if not len(cells_):
                    continue
                x, y, n = (np.array([c[f] for c in cells_]) for f in ("x", "y", "n"))
                rng = np.random.default_rng([seed, int(block)])
                got = kappas(x, y, rng.multinomial(n.sum(), n / n.sum(), size=-(-resamples // blocks)))
                yield pd.DataFrame({"point": np.full(len(got), kappas(x, y, n[None])[0]), "kappa": got})

    spread = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.mapInPandas(draw, "point double, kappa double").agg(F.max("point").alias("kappa"), F.percentile("kappa", 0.025).alias("low"), F.percentile("kappa", 0.975).alias("high"), F.count("*").alias("n_resamples"))
