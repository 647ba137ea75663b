"""Event order, segments and bounded event windows that no hot session can overload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.runtime import checkpointed

#: Events of a session are numbered in slices of this many seconds, and windows are cut into buckets of this many events.
SLICE_SECONDS = 7 * 86_400
BUCKET = 4096


def ordinals(events: DataFrame, session: str, time: str, tie: str, boundary: Column, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Add ``event_index`` (from 0) and ``segment_id`` (boundaries so far) per session, ordered by time, then tie.

    A session is numbered slice by slice of time; counts of the slices before are added. Null times come first, in one slice.
    """
    e = events.withColumn("_b", F.coalesce(boundary, F.lit(False)).cast("long")).withColumn("_slice", F.coalesce(F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(slice_seconds * 1_000_000)), F.lit(-(2**60))))
    within = Window.partitionBy(session, "_slice").orderBy(F.col(time).asc_nulls_first(), tie)
    e = e.withColumn("_n", F.row_number().over(within).cast("long")).withColumn("_seg", F.sum("_b").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    slices = e.groupBy(session, "_slice").agg(F.count("*").alias("_rows"), F.sum("_b").alias("_bs"))
    earlier = Window.partitionBy(session).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(F.col(session).alias("_session"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"), F.coalesce(F.sum("_bs").over(earlier), F.lit(0)).alias("_segs"))
    j = e.join(slices, F.col(session).eqNullSafe(F.col("_session")) & (F.col("_slice") == F.col("_s")))
    return j.select(*events.columns, (F.col("_before") + F.col("_n") - 1).alias("event_index"), (F.col("_segs") + F.col("_seg")).alias("segment_id"))


def with_halo(events: DataFrame, reach: int, bucket: int = BUCKET) -> DataFrame:
    """Copies of the events near a bucket's edge for its neighbour: windows of ±reach inside a ``bucket`` are complete for its ``home`` rows."""
    i = F.col("event_index")
    at = lambda x: F.floor(x / F.lit(bucket))
    return events.withColumn("bucket", F.explode(F.array_distinct(F.array(at(i - reach), at(i), at(i + reach))))).withColumn("home", F.col("bucket") == at(i))


def around(keys: list[str], low: int, high: int) -> Window:
    """The window of event indices [i+low, i+high] per key and bucket."""
    return Window.partitionBy(*keys, "bucket").orderBy("event_index").rangeBetween(low, high)


def coupling(events: DataFrame, keys: list[str], is_tool: Column, reach: int = 3) -> DataFrame:
    """Add ``coupled``: some tool use within ±reach events, the own event included."""
    w = around(keys, -reach, reach)
    return with_halo(events, reach).withColumn("coupled", F.max(F.coalesce(is_tool, F.lit(False))).over(w)).filter("home").drop("bucket", "home")


def nearest_path(events: DataFrame, keys: list[str], path: Column, reach: int = 3) -> DataFrame:
    """Add nearest_path, nearest_distance, nearest_direction: the closest other event that names a path; ties go to the one before."""
    e = with_halo(events, reach).withColumn("_p", path).withColumn("_at", F.when(F.col("_p").isNotNull(), F.col("event_index")))
    b, a = around(keys, -reach, -1), around(keys, 1, reach)
    e = e.withColumn("_bp", F.last("_p", True).over(b)).withColumn("_ba", F.last("_at", True).over(b)).withColumn("_ap", F.first("_p", True).over(a)).withColumn("_aa", F.first("_at", True).over(a))
    db, da = F.col("event_index") - F.col("_ba"), F.col("_aa") - F.col("event_index")
    before = F.col("_ba").isNotNull() & (F.col("_aa").isNull() | (db <= da))
    e = e.withColumn("nearest_path", F.when(before, F.col("_bp")).otherwise(F.col("_ap"))).withColumn("nearest_distance", F.when(before, db).otherwise(da))
    e = e.withColumn("nearest_direction", F.when(before, "before").when(F.col("_aa").isNotNull(), "after"))
    return e.filter("home").drop("_p", "_at", "_bp", "_ba", "_ap", "_aa", "bucket", "home")


def bursts(uses: DataFrame, keys: list[str], reach: int = 5) -> DataFrame:
    """Add ``burst``: another use with the same keys within ±reach events."""
    return with_halo(uses, reach).withColumn("burst", F.count("*").over(around(keys, -reach, reach)) > 1).filter("home").drop("bucket", "home")


def carry_forward(events: DataFrame, session: str, value: Column, name: str) -> DataFrame:
    """Add the latest non-null value at or before each event of its session; sessions are carried bucket by bucket."""
    e = events.withColumn("_v", value).withColumn("_bk", F.floor(F.col("event_index") / F.lit(BUCKET)))
    w = Window.partitionBy(session, "_bk").orderBy("event_index")
    e = e.withColumn("_own", F.last("_v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = e.groupBy(session, "_bk").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("event_index"))).alias("_end"))
    before = Window.partitionBy(session).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(session).alias("_s"), F.col("_bk").alias("_k"), F.last("_end", True).over(before).alias("_carry"))
    j = e.join(ends, F.col(session).eqNullSafe(F.col("_s")) & (F.col("_bk") == F.col("_k")))
    return j.select(*events.columns, F.coalesce("_own", "_carry").alias(name))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, position: str = "position") -> DataFrame:
    """Add each row's ``position`` (from 0) in its group by ``order`` and inclusive running sums.

    Rows are sorted by range over the whole table, numbered inside of each range, and raised by what the group has in the ranges before:
    a hot group spreads over many tasks, and the counts that one task adds up are one row a group and range. Null keys are groups too.
    """
    sums = sums or {}
    s = df.select("*", *(c.alias(f"_s_{n}") for n, c in sums.items()))
    s = s.repartitionByRange(*[F.col(c).asc_nulls_first() for c in [*keys, *order]]).sortWithinPartitions(*keys, *order)
    s = checkpointed(s.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    here = Window.partitionBy(*keys, "_p").orderBy("_m")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_i", F.row_number().over(here).cast("long") - 1)
    for n in sums:
        s = s.withColumn(f"_r_{n}", F.sum(f"_s_{n}").over(upto))
    part = s.groupBy(*keys, "_p").agg(F.count("*").alias("_c"), *(F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    add = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    part = part.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_p").alias("_q"), add("_c").alias("_off"), *(add(f"_t_{n}").alias(f"_o_{n}") for n in sums))
    on = F.col("_p") == F.col("_q")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return s.join(part, on).select(*df.columns, (F.col("_i") + F.col("_off")).alias(position), *((F.coalesce(f"_r_{n}", F.lit(0)) + F.col(f"_o_{n}")).alias(n) for n in sums))
