"""Checks of trajectories and tables: neighbours that name a path, contained and equal sequences, duplicates, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.scoring import top_per_group
from tracemill.operators.windows import with_halo


def named_beside(events: DataFrame, key: str, order: str, path: Column, action: Column) -> DataFrame:
    """Add ``beside``: whether an event's path occurs in the text of the action before it, after it, both or neither; 'no_name' without path.

    ``order`` numbers the events of a key from 0 without gaps; windows are cut into buckets with a halo of one event.
    """
    e = with_halo(events.withColumn("event_index", F.col(order)).withColumn("_p", path).withColumn("_a", action), 1)
    w = Window.partitionBy(key, "bucket").orderBy("event_index")
    e = e.withColumn("_b", F.lag("_a").over(w)).withColumn("_n", F.lead("_a").over(w)).filter("home")
    at = lambda c: F.coalesce(F.contains(c, F.col("_p")), F.lit(False))
    before, after = at(F.col("_b")), at(F.col("_n"))
    named = F.when(F.col("_p").isNull() | (F.col("_p") == ""), "no_name").when(before & after, "both").when(after, "next").when(before, "previous").otherwise("neither")
    return e.withColumn("beside", named).select(*events.columns, "beside")


def ordered_containment(parts: Column, whole: Column) -> Column:
    """Whether an array is a subsequence of another: each item found after the one before. One pass over ``whole``."""
    n = F.size(parts)
    at = F.aggregate(whole, F.lit(0), lambda i, x: F.when((i < n) & F.element_at(parts, F.least(i, n - 1) + 1).eqNullSafe(x), i + 1).otherwise(i))
    return F.when(n <= 0, n == 0).otherwise(at == n)


def sequence_equality(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def column_differences(mine: DataFrame, theirs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(column, n_compared, n_different) over rows of equal keys, nulls being equal; every column has a row."""
    j = mine.select(*keys, *(F.col(c).alias(f"_a_{c}") for c in columns)).join(theirs.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in columns)), keys)
    one = j.agg(*(F.count("*").alias(f"n_{c}") for c in columns), *(F.count_if(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))).alias(f"d_{c}") for c in columns))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n_compared"), F.col(f"d_{c}").alias("n_different")) for c in columns)))
    return one.select(rows.alias("x")).select("x.*")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many distinct rows are only on one side or the other, and whether none is."""
    only = a.distinct().withColumn("_a", F.lit(1)).unionByName(b.select(*a.columns).distinct().withColumn("_a", F.lit(2))).groupBy(*a.columns).agg(F.sum("_a").alias("_s"))
    return only.agg(F.count_if(F.col("_s") == 1).alias("only_first"), F.count_if(F.col("_s") == 2).alias("only_second")).withColumn("same", (F.col("only_first") == 0) & (F.col("only_second") == 0))


def fragment_multiplicity(units: DataFrame) -> DataFrame:
    """How many units have how many fragments."""
    return units.groupBy("n_fragments").agg(F.count("*").alias("n_units"))


def presence(units: DataFrame, trajectories: DataFrame, key: str) -> DataFrame:
    """One row: trajectories, those with any unit, units, and units per trajectory that has some."""
    u = units.groupBy(key).agg(F.count("*").alias("_n"))
    j = trajectories.select(key).distinct().join(u, key, "left")
    out = j.agg(F.count("*").alias("n_trajectories"), F.count("_n").alias("n_with_units"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_units"))
    return out.withColumn("share", F.try_divide("n_with_units", "n_trajectories")).withColumn("units_each", F.try_divide("n_units", "n_with_units"))


def unit_rates(units: DataFrame, group: Column | None = None) -> DataFrame:
    """Units and the shares of them that are terminal or free-standing, per group and over all (group null)."""
    g = units.withColumn("grp", group if group is not None else F.lit("all"))
    out = g.rollup("grp").agg(F.count("*").alias("n_units"), F.count_if(F.col("emission_kind") == "terminal").alias("n_terminal"), F.count_if(F.col("emission_kind") == "free-standing").alias("n_free"), F.grouping("grp").alias("total"))
    return out.withColumn("terminal_rate", F.try_divide("n_terminal", "n_units")).withColumn("free_rate", F.try_divide("n_free", "n_units"))


def duplicates(rows: DataFrame, group: str, text: str, most: int = 5) -> DataFrame:
    """The most frequent texts of each group that occur twice or more: (group, text hash, n, rank)."""
    n = rows.filter(F.col(text).isNotNull()).groupBy(group, F.sha2(text, 256).alias("text_hash")).agg(F.count("*").alias("n")).filter("n >= 2")
    return top_per_group(n, group, [F.desc("n"), F.col("text_hash")], most)


def census(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """Counts by group and kind with subtotals and a total: 'TOTAL' stands for all."""
    c = rows.rollup(group, kind).agg(F.count("*").alias("n"), F.grouping_id(group, kind).alias("level"))
    name = lambda col, bit: F.when(F.col("level").bitwiseAND(bit) != 0, F.lit("TOTAL")).otherwise(F.col(col))
    return c.select(name(group, 2).alias(group), name(kind, 1).alias(kind), "n")


def fence_census(rows: DataFrame, text: str) -> DataFrame:
    """One row: texts, those with fences, those whose fences don't pair, opening and closing think tags, and texts where these differ."""
    fences, opened, closed = F.regexp_count(F.col(text), F.lit("(?md)^```")), F.regexp_count(F.col(text), F.lit("<think>")), F.regexp_count(F.col(text), F.lit("</think>"))
    return rows.agg(
        F.count(text).alias("n_texts"), F.count_if(fences > 0).alias("n_fenced"), F.count_if(fences % 2 == 1).alias("n_unpaired"), F.coalesce(F.sum(opened), F.lit(0)).alias("n_opened"), F.coalesce(F.sum(closed), F.lit(0)).alias("n_closed"), F.count_if(opened != closed).alias("n_unbalanced")
    )


def key_sets(payloads: DataFrame, payload: str) -> DataFrame:
    """(keys, n): how many objects have which top-level keys, sorted; what is no object counts under null."""
    keys = F.json_object_keys(payload)
    return payloads.groupBy(F.when(keys.isNotNull(), F.array_join(F.array_sort(keys), ",")).alias("keys")).agg(F.count("*").alias("n"))
