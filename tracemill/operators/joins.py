"""Joins with checks: coverage, gaps, manifests, first and last per key, tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(left: DataFrame, right_keys: DataFrame, on: list[str], group: str) -> DataFrame:
    """Per group: rows of the left side, how many have a partner, and the share; unjoined rows are never dropped."""
    j = left.join(right_keys.select(*on).distinct().withColumn("_hit", F.lit(1)), on, "left")
    return j.groupBy(group).agg(F.count("*").alias("n_rows"), F.count("_hit").alias("n_joined")).withColumn("coverage", F.try_divide("n_joined", "n_rows"))


def reverse_gap(right: DataFrame, left: DataFrame, near: list[str], full: list[str]) -> DataFrame:
    """Right rows whose ``near`` key is known on the left but whose full key isn't there."""
    return right.join(left.select(*near).distinct(), near, "left_semi").join(left.select(*full).distinct(), full, "left_anti")


def manifest_diff(expected: DataFrame, found: DataFrame, key: str, digest: str) -> DataFrame:
    """missing, extra or changed entries between two manifests (key, digest)."""
    e, f = expected.select(key, F.col(digest).alias("_e"), F.lit(1).alias("_in_e")), found.select(key, F.col(digest).alias("_f"), F.lit(1).alias("_in_f"))
    status = F.when(F.col("_in_f").isNull(), "missing").when(F.col("_in_e").isNull(), "extra").when(~F.col("_e").eqNullSafe(F.col("_f")), "changed")
    return e.join(f, key, "full_outer").select(key, status.alias("status")).filter("status is not null")


def refuse_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """The frame with an error raised at run time for a key that occurs twice."""
    twice = F.count("*").over(Window.partitionBy(*keys)) > 1
    return df.withColumn("_twice", twice).withColumn("_ok", F.when(F.col("_twice"), F.raise_error(F.concat(F.lit("duplicate key "), F.to_json(F.struct(*keys)))).cast("int")).otherwise(1)).filter("_ok = 1").drop("_twice", "_ok")


def tool_calls(blocks: DataFrame, session: str = "session_id") -> DataFrame:
    """Tool uses with their last result: (session, tool_use_id) of a use joins the latest result after it; uses without result stay.

    ``blocks`` has session, position (sortable), block_type, tool_name, tool_use_id, block_text.
    """
    uses = blocks.filter("block_type = 'tool_use' and tool_use_id is not null").select(session, "tool_use_id", F.col("position").alias("use_at"), "tool_name")
    results = blocks.filter("block_type = 'tool_result' and tool_use_id is not null").select(session, "tool_use_id", F.col("position").alias("result_at"), F.col("block_text").alias("result_text"))
    w = Window.partitionBy(session, "tool_use_id").orderBy("at")
    # results belong to the latest use before them: a use's span reaches to the next use of that id
    spans = uses.withColumn("at", F.col("use_at")).withColumn("next_use", F.lead("use_at").over(w)).drop("at")
    j = spans.join(results, [session, "tool_use_id"], "left")
    ok = (F.col("result_at") > F.col("use_at")) & (F.col("next_use").isNull() | (F.col("result_at") < F.col("next_use")))
    hit = F.when(ok, F.struct("result_at", "result_text"))
    return j.groupBy(session, "tool_use_id", "use_at", "tool_name").agg(F.max(hit).alias("r")).select(session, "tool_use_id", "use_at", "tool_name", F.col("r.result_at").alias("result_at"), F.col("r.result_text").alias("result_text"))


def first_last(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """First and last non-null value per key by order (ties: the lesser first, the greater last)."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order), F.col(value)))
    return df.groupBy(key).agg(F.min(known)[value].alias("first_value"), F.max(known)[value].alias("last_value"))


def final_attempts(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Per unit: the first valid attempt, else the last; complete if any is valid or there are two."""
    r = F.struct("attempt", "ledger_id", "score", "reason")
    return attempts.groupBy(*keys).agg(F.min(F.when(F.col("valid"), r)).alias("v"), F.max(r).alias("l"), F.countDistinct("attempt").alias("n_attempts")).select(
        *keys, "n_attempts", F.coalesce("v", "l")["attempt"].alias("attempt"), F.col("v.score").alias("score"), (F.col("v").isNotNull() | (F.col("n_attempts") >= 2)).alias("complete")
    )


def symbols(df: DataFrame, text: str) -> DataFrame:
    """Histogram of the space-separated words of a text column."""
    return df.select(F.explode(F.filter(F.split(text, " "), lambda w: w != "")).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


def as_long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]
