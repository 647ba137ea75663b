"""Step-anchored units: emissions attach to the next action step; fragments keep their offsets in the unit's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.operators.windows import running, with_halo

JOINER = "\n\n"


def anchor(events: DataFrame, key: str, order: str, is_action: Column, text: str, container: str | None = None, harness_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Units: key, unit (ordinal of the step they attach to), n_fragments, unit_text, fragments with start and end, emission_kind, terminal.

    Blank emissions and those that begin with a harness prefix are dropped. A unit is free-standing if one of its fragments lies in
    another container than its step, terminal if no step follows.
    """
    e = running(events.withColumn("_a", is_action), [key], [order], {"unit": F.col("_a").cast("long")}, position="_at")
    # an action closes the unit that bears its own ordinal
    steps = e.filter("_a").select(key, (F.col("unit") - 1).alias("unit"), F.col(container or order).alias("_step"))
    harness = F.lit(False)
    for p in harness_prefixes:
        harness = harness | F.ltrim(text).startswith(p)
    said = e.filter(~F.col("_a") & F.coalesce(F.col(text).rlike(r"\S"), F.lit(False)) & ~harness)
    run = Window.partitionBy(key, "unit").orderBy(order)
    size = F.length(text).cast("long")
    said = said.withColumn("start", F.coalesce(F.sum(size + len(JOINER)).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("end", F.col("start") + size)
    frag = said.select(key, "unit", F.col(order).alias("_o"), "start", "end", F.col(text).alias("_t"), F.col(container or order).alias("_c"))
    g = frag.join(steps, [key, "unit"], "left").groupBy(key, "unit").agg(
        F.sort_array(F.collect_list(F.struct("_o", "start", "end", "_t"))).alias("_f"), F.max("_step").isNull().alias("terminal"), F.max(F.coalesce(F.col("_c") != F.col("_step"), F.lit(True))).alias("_free"), F.count("*").alias("n_fragments")
    )
    kind = F.when(F.col("terminal"), "terminal").when(F.col("_free"), "free-standing").otherwise("in-step")
    return g.select(key, "unit", "n_fragments", F.array_join(F.transform("_f", lambda f: f["_t"]), JOINER).alias("unit_text"), F.transform("_f", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"))).alias("fragments"), kind.alias("emission_kind"), "terminal")


def recovered(units: DataFrame) -> DataFrame:
    """Fragment texts cut out of the unit text again."""
    return units.withColumn("recovered", F.transform("fragments", lambda f: F.substr(F.col("unit_text"), (f["start"] + 1).cast("int"), (f["end"] - f["start"]).cast("int"))))


def alternation(events: DataFrame, key: str, order: str, is_action: Column) -> DataFrame:
    """Per key: events, emissions right after emissions, actions without an emission before them, and whether it ends in an emission."""
    e = running(events.select(key, order, is_action.alias("_a")), [key], [order], position="event_index")
    e = with_halo(e, 1).withColumn("_before", F.lag("_a").over(Window.partitionBy(key, "bucket").orderBy("event_index"))).filter("home")
    return e.groupBy(key).agg(
        F.count("*").alias("n_events"), F.count_if(~F.col("_a") & F.coalesce(~F.col("_before"), F.lit(False))).alias("n_consecutive"), F.count_if(F.col("_a") & F.coalesce(F.col("_before"), F.lit(True))).alias("n_unpreceded"), (~F.max_by("_a", order)).cast("int").alias("trailing")
    )
