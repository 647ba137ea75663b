"""Behaviour detectors over event windows. Events need session, segment_id, event_index and, where used, path, scope, pattern, command, errored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.windows import around, with_halo

REACH = 3


def read_after_edit(events: DataFrame, keys: list[str], is_edit: Column, is_read: Column, reach: int = REACH) -> DataFrame:
    """Edits of a path that is read again within ``reach`` events: rows of the edits."""
    e = with_halo(events.withColumn("_r", is_read.cast("int")).withColumn("_e", is_edit), reach)
    e = e.withColumn("_later", F.max("_r").over(around([*keys, "path"], 1, reach)))
    return e.filter("home and _e and _later = 1").drop("_r", "_e", "_later", "bucket", "home")


def edit_failures(events: DataFrame, keys: list[str], is_edit: Column, is_read: Column, errored: Column, reach: int = REACH) -> DataFrame:
    """Edits whose result is an error, or whose path is read again within ``reach`` events."""
    e = with_halo(events.withColumn("_r", is_read.cast("int")).withColumn("_e", is_edit).withColumn("_x", F.coalesce(errored, F.lit(False))), reach)
    e = e.withColumn("_later", F.max("_r").over(around([*keys, "path"], 1, reach)))
    return e.filter("home and _e and (_x or _later = 1)").drop("_r", "_e", "_x", "_later", "bucket", "home")


def grep_reformulations(events: DataFrame, keys: list[str], reach: int = REACH) -> DataFrame:
    """Searches followed within ``reach`` events by one of the same scope and another pattern (nulls equal nulls); each counts once.

    Another pattern is there if the least or the greatest pattern ahead differs, or if a null and a value meet: a window, no self-join.
    """
    w = around([*keys, "scope"], 1, reach)
    e = with_halo(events, reach).withColumn("_lo", F.min("pattern").over(w)).withColumn("_hi", F.max("pattern").over(w)).withColumn("_n", F.count("*").over(w)).withColumn("_known", F.count("pattern").over(w))
    differs = F.when(F.col("pattern").isNull(), F.col("_known") > 0).otherwise((F.col("_known") < F.col("_n")) | (F.col("_lo") != F.col("pattern")) | (F.col("_hi") != F.col("pattern")))
    return e.filter(F.col("home") & (F.col("_n") > 0) & differs).drop("_lo", "_hi", "_n", "_known", "bucket", "home")


def bash_retries(events: DataFrame, keys: list[str], reach: int = REACH, carry: str | None = None) -> DataFrame:
    """Failed commands with the first retry: a later command within ``reach`` of the same first word that doesn't merely extend it.

    Adds retry_index and retry_command, and with ``carry`` that column of the retry as retry_<carry>. What lies ahead is at most
    ``reach`` events, gathered by a window. Commands of one event go by ``pos``, where there is such a column.
    """
    word = F.regexp_extract("command", r"(?U)\S+", 0)
    e = with_halo(events.withColumn("_word", word), reach)
    seen = ["event_index", *(c for c in ("pos",) if c in events.columns), "command", *([carry] if carry else [])]
    e = e.withColumn("_ahead", F.collect_list(F.struct(*seen)).over(around([*keys, "_word"], 1, reach)))
    fits = F.filter("_ahead", lambda b: ~(b["command"].startswith(F.col("command")) & (F.length(b["command"]) > F.length("command"))))
    e = e.withColumn("_first", F.try_element_at(F.array_sort(fits), F.lit(1)))
    e = e.filter("home and errored and _first is not null").withColumn("retry_index", F.col("_first.event_index")).withColumn("retry_command", F.col("_first.command"))
    e = e.withColumn(f"retry_{carry}", F.col(f"_first.{carry}")) if carry else e
    return e.drop("_word", "_ahead", "_first", "bucket", "home")


def rollup(detected: dict[str, DataFrame], key: str) -> DataFrame:
    """Counts of each detector's rows per key, and their total; every name is a column."""
    rows = reduce(DataFrame.unionByName, (d.select(key, F.lit(n).alias("kind")) for n, d in detected.items()))
    return rows.groupBy(key).agg(*(F.count_if(F.col("kind") == n).alias(n) for n in detected), F.count("*").alias("total"))
