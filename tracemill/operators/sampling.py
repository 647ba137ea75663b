"""Sampling that scales: hash order for stratified draws, positions for systematic ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.scoring import top_per_group
from tracemill.operators.windows import running


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 18) -> DataFrame:
    """n rows of each stratum, those of least hash under the seed: without replacement, the same on every run and partitioning."""
    h = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    return top_per_group(h, stratum, [F.col("_h"), F.col(key)], n).drop("_h")


def systematic(df: DataFrame, key: str, target: int = 50, group: str | None = None) -> DataFrame:
    """Every ceil(n/target)-th row in order of the key, from the first on. Positions come from sorted ranges and their counts."""
    keys = [group] if group is not None else []
    x = running(df, keys, [key], position="_i")
    if group is None:
        n = F.lit(df.count())
    else:
        n = F.col("_n")
        x = x.join(df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n")), F.col(group).eqNullSafe(F.col("_g")))
    return x.filter(F.col("_i") % F.greatest(F.ceil(n / target), F.lit(1)) == 0).select(*df.columns)
