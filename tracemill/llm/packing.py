"""Filling context windows of fixed capacity: bounded-space best fit per partition, then leftovers are merged."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.runtime import checkpointed

#: Windows kept open at once in a partition, for each capacity.
OPEN_WINDOWS = 64
#: Leftover windows whose items are packed anew in one task, and items at most; windows filled less than this then are so once more.
MERGE_ROWS, MERGE_ITEMS, FULL = 2_000, 200_000, 0.97


class OpenWindows:
    """At most ``limit`` open windows of one capacity; items go to the fullest one that takes them."""

    def __init__(self, capacity: int, prefix: str, limit: int = OPEN_WINDOWS) -> None:
        self.capacity, self.prefix, self.limit = capacity, prefix, limit
        self.room: list[tuple[int, int]] = []  # (free, window), ascending
        self.made = 0
        self.closed: list[int] = []

    def place(self, size: int) -> int:
        k = bisect_left(self.room, (size, -1))
        if k < len(self.room):
            free, w = self.room.pop(k)
        else:
            if len(self.room) >= self.limit:
                self.closed.append(self.room.pop(0)[1])  # none fits: the fullest is emitted
            free, w = self.capacity, self.made
            self.made += 1
        if free > size:
            insort(self.room, (free - size, w))
        else:
            self.closed.append(w)
        return w

    def name(self, w: int) -> str:
        return f"{self.prefix}-{w}"


_PLACED = "window_name string, capacity bigint, window_id string, item_id bigint, piece int, start_token bigint, n_tokens bigint, leftover boolean"


def _task() -> int:
    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def pack_partition(rows: Iterator[tuple[int, int]], windows: dict[str, int], part: int, chunk: int = 20_000) -> Iterator[list[tuple]]:
    """Placements of one partition's (item, size) rows in chunks; ``leftover`` is set for windows still open at the end.

    Rows of a window are held back until it is closed, so a row is out once and final; what is held is bounded by the windows open.
    """
    for name, cap in windows.items():
        if cap is None or cap <= 0:
            raise ValueError(f"{name}: capacity {cap}")
    packs = {name: OpenWindows(cap, f"{name}-{part:06d}") for name, cap in windows.items()}
    held: dict[tuple[str, int], list[tuple]] = {}
    out: list[tuple] = []

    def flush(name: str, leftover: bool) -> None:
        p = packs[name]
        for w in p.closed:
            out.extend((name, p.capacity, p.name(w), *r, leftover) for r in held.pop((name, w)))
        p.closed.clear()

    for item, size in rows:
        for name, p in packs.items():
            if size <= 0:
                out.append((name, p.capacity, None, item, 0, 0, 0, False))
                continue
            start = piece = 0
            while True:
                take = min(size - start, p.capacity)
                w = p.place(take)
                held.setdefault((name, w), []).append((item, piece, start, take))
                start, piece = start + take, piece + 1
                if start >= size:
                    break
            flush(name, False)
        if len(out) >= chunk:
            yield out
            out = []
    for name, p in packs.items():
        p.closed.extend(w for _, w in p.room)
        flush(name, True)
    yield out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_PLACED_ARROW = pa.schema([("window_name", pa.string()), ("capacity", pa.int64()), ("window_id", pa.string()), ("item_id", pa.int64()), ("piece", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int64()), ("leftover", pa.bool_())])


def _repacked(leftovers: DataFrame, step: int) -> DataFrame:
    """Leftover items in new windows, largest first and each in the fullest window that takes it, in tasks of like size; windows that are
    not ``FULL`` are leftovers again."""
    held = leftovers.agg(F.countDistinct("window_name", "window_id").alias("w"), F.count("*").alias("n")).first()
    groups = max(1, -(-held.w // MERGE_ROWS), -(-held.n // MERGE_ITEMS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: dict[str, OpenWindows] = {}
        held: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = packs.setdefault(r[0], OpenWindows(r[1], f"{r[0]}-m{step}-{_task():06d}", limit=1 << 62))
                held.append((r, p.place(r[6])))
                p.closed.clear()
        again = {(name, w) for name, p in packs.items() for free, w in p.room if free > (1 - FULL) * p.capacity}
        yield _batch([(*r[:2], packs[r[0]].name(w), *r[3:7], (r[0], w) in again) for r, w in held], _PLACED_ARROW)

    dealt = leftovers.repartition(groups, F.xxhash64("item_id", "piece", "window_name"))
    return checkpointed(dealt.sortWithinPartitions("window_name", F.desc("n_tokens"), "item_id", "piece").mapInArrow(run, _PLACED))


def pack(sizes: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Place every item (item_id, n_tokens) in a window of each named capacity.

    Comes out: window_name, capacity, window_id, item_id, piece, start_token, n_tokens. An item is one piece unless it is larger
    than the capacity, when all its pieces but the last fill a window each. Items of 0 or null tokens need no room: they come out with
    a null window_id; repeated items are packed each time; no items give no windows. One narrow pass packs the partitions as they lie (64 open
    windows for each capacity). The items of the windows still open at their ends, a number that grows with the partitions only, are
    dealt to tasks of some ``MERGE_ROWS`` windows' worth and packed anew, largest first; the few windows a task then leaves unfilled go
    through this once more. That is two shuffles of small parts, however many partitions there are.
    """
    source = sizes.select(F.col("item_id").cast("bigint"), F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)).alias("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for out in pack_partition(rows, windows, _task()):
            yield _batch(out, _PLACED_ARROW)

    placed = checkpointed(source.mapInArrow(run, _PLACED))
    first = _repacked(placed.filter("leftover"), 1)
    parts = (placed.filter("not leftover"), first.filter("not leftover"), _repacked(first.filter("leftover"), 2))
    return reduce(DataFrame.unionByName, parts).drop("leftover")


def fill_report(placed: DataFrame) -> DataFrame:
    """For each capacity: windows used, the least number possible by volume, and the share of room used."""
    total = placed.groupBy("window_name", "capacity").agg(F.countDistinct("window_id").alias("n_windows"), F.sum("n_tokens").alias("n_tokens"), F.countDistinct("item_id").alias("n_items"), F.count("*").alias("n_pieces"))
    return total.withColumn("least_windows", F.ceil(F.col("n_tokens") / F.col("capacity"))).withColumn("fill", F.try_divide(F.col("n_tokens"), F.col("n_windows") * F.col("capacity")))


def capacities(context_windows: DataFrame, most: int = 1000) -> dict[str, int]:
    """Named capacities to the driver; the table is a small dimension, and more rows than ``most`` are refused."""
    rows = context_windows.select("window_name", "capacity_tokens").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} context windows")
    return {r[0]: int(r[1]) for r in rows if r[0] is not None and r[1] is not None}
