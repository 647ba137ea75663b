"""Nested session records to flat tables of records and blocks, with Arrow list offsets and parent indices."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.runtime import ship

RECORD_SCHEMA = "record_id bigint, record_type string, session_id string, event_uuid string, parent_uuid string, event_time string, cwd string, agent_sourced boolean, n_items int, readable boolean"
LINKS_SCHEMA = "record_id bigint, block_path string, parent_path string, block_type string"
BLOCK_SCHEMA = f"{LINKS_SCHEMA}, depth int, block_text string, tool_name string, tool_use_id string, command string"
_LOST = object()


def _decode(text: str | None):
    if text is None:
        return _LOST
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return _LOST


def _object(value):
    """The object a value is or, where it is JSON text of an object, stands for."""
    if isinstance(value, dict):
        return value
    if isinstance(value, str) and "{" in value:
        inner = _decode(value)
        return inner if isinstance(inner, dict) else None
    return None


def _member(value, key: str):
    o = _object(value)
    return None if o is None else o.get(key)


def content_of(record) -> list | None:
    """The array of blocks of one decoded record, None if it has none."""
    if not isinstance(record, dict):
        return None
    kind = record.get("type")
    if kind in ("assistant", "user"):
        content = _member(record.get("message"), "content")
    elif kind == "progress" and _member(record.get("data"), "type") == "agent_progress":
        content = _member(_member(_member(record.get("data"), "message"), "message"), "content")
    else:
        return None
    return content if isinstance(content, list) else None


def _text(items: list, *keys: str) -> pa.Array:
    """The first of the keys that is text, as one column."""
    return pa.array([next((v for k in keys if isinstance(v := b.get(k), str)), None) for b in items], pa.large_string())


def _command(block: dict) -> str | None:
    """The command of a block's input; one that is no text, as JSON."""
    command = _member(block.get("input"), "command")
    return command if command is None or isinstance(command, str) else json.dumps(command, ensure_ascii=False)


def flatten_blocks(ids: pa.Array, contents: list[list | None], detail: bool = True) -> pa.Table:
    """All blocks of a batch, level by level.

    Each level is one list column: its offsets come from the item counts, the parent index of every item from the offsets
    (``list_parent_indices``), its position is item index minus the parent's offset, and keys and paths go down by ``take``.
    """
    levels, keys, paths, lists, depth = [], ids, pa.array([""] * len(contents), pa.large_string()), contents, 0
    while True:
        counts = np.fromiter((0 if c is None else len(c) for c in lists), np.int64, len(lists))
        offsets = np.concatenate(([0], np.cumsum(counts)))
        if not offsets[-1]:
            break
        flat = list(chain.from_iterable(c for c in lists if c))
        column = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.arange(len(flat))))
        parent = pc.list_parent_indices(column)
        position = pc.subtract(pc.list_flatten(column), pc.take(pa.array(offsets), parent))
        keep = [k for k, b in enumerate(flat) if isinstance(b, dict) and isinstance(b.get("type"), str)]
        kept = pa.array(keep, pa.int64())
        blocks = [flat[k] for k in keep]
        parent = pc.take(parent, kept)
        above = pc.take(paths, parent)
        where = pc.cast(pc.take(position, kept), pa.large_string())
        path = where if depth == 0 else pc.binary_join_element_wise(above, where, pa.scalar(".", pa.large_string()))
        keys = pc.take(keys, parent)
        level = {"record_id": keys, "block_path": path, "parent_path": above, "block_type": _text(blocks, "type")}
        if detail:
            level |= {"depth": pa.array(np.full(len(keep), depth, np.int32)), "block_text": _text(blocks, "text", "thinking", "content"), "tool_name": _text(blocks, "name"), "tool_use_id": _text(blocks, "id", "tool_use_id"), "command": pa.array([_command(b) for b in blocks], pa.large_string())}
        levels.append(pa.table(level))
        paths, depth = path, depth + 1
        lists = [c if isinstance(c := b.get("content"), list) else None for b in blocks]
    if not levels:
        text, names = pa.large_string(), ("record_id", "block_path", "parent_path", "block_type", "depth", "block_text", "tool_name", "tool_use_id", "command")
        kinds = (pa.int64(), text, text, text, pa.int32(), text, text, text, text)
        return pa.table({n: pa.array([], t) for n, t in list(zip(names, kinds, strict=True))[: None if detail else 4]})
    return pa.concat_tables(levels)


def _to_spark(table: pa.Table) -> Iterator[pa.RecordBatch]:
    fields = [pa.field(f.name, pa.string() if pa.types.is_large_string(f.type) else f.type) for f in table.schema]
    yield from table.cast(pa.schema(fields)).combine_chunks().to_batches(max_chunksize=20_000)


def _blocks(batches: Iterator[pa.RecordBatch], detail: bool = True) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contents = [content_of(_decode(p)) for p in batch.column("payload").to_pylist()]
        yield from _to_spark(flatten_blocks(batch.column("record_id"), contents, detail))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        records = [_decode(p) for p in batch.column("payload").to_pylist()]
        dicts = [r if isinstance(r, dict) else {} for r in records]
        contents = [content_of(r) for r in records]
        yield from _to_spark(
            pa.table(
                {
                    "record_id": batch.column("record_id"), "record_type": _text(dicts, "type"), "session_id": _text(dicts, "sessionId"), "event_uuid": _text(dicts, "uuid"), "parent_uuid": _text(dicts, "parentUuid"), "event_time": _text(dicts, "timestamp"), "cwd": _text(dicts, "cwd"),
                    "agent_sourced": pa.array([d.get("type") == "progress" and c is not None for d, c in zip(dicts, contents, strict=True)]),
                    "n_items": pa.array([None if c is None else len(c) for c in contents], pa.int32()),
                    "readable": pa.array([isinstance(r, dict) for r in records]),
                }
            )
        )


def blocks_table(records: DataFrame) -> DataFrame:
    """The child table: one row per block of ``records`` (record_id, payload), linked by record_id and parent_path.

    The payload is decoded once a batch; below that no row is parsed (see ``flatten_blocks``). A null, empty or malformed payload,
    one that is no object, or one nested beyond the decoder's depth has no blocks (the records table has readable = false).
    Of repeated keys in an object the last holds. Items that are no object or have no text ``type`` are no blocks, but count as
    positions; their own content is not entered. Repeated rows give their blocks again, under their own record_id. Narrow: no shuffle.
    """
    ship(records.sparkSession)
    return records.select("record_id", "payload").mapInArrow(_blocks, BLOCK_SCHEMA)


def records_table(records: DataFrame) -> DataFrame:
    """The parent table: one row per record, readable or not."""
    ship(records.sparkSession)
    return records.select("record_id", "payload").mapInArrow(_records, RECORD_SCHEMA)


def links(records: DataFrame) -> DataFrame:
    """The child table's keys and kinds alone: what isn't asked for is neither built nor sent from Python."""
    ship(records.sparkSession)
    return records.select("record_id", "payload").mapInArrow(lambda b: _blocks(b, detail=False), LINKS_SCHEMA)


def found(records: DataFrame) -> DataFrame:
    return links(records)


def children_per_block(records: DataFrame) -> DataFrame:
    """Each block with the number of its child blocks: the parent-child link used as a join key."""
    b = links(records)
    kids = b.filter("parent_path <> ''").groupBy("record_id", F.col("parent_path").alias("block_path")).agg(F.count("*").alias("n_children"))
    return b.join(kids, ["record_id", "block_path"], "left").select("record_id", "block_path", "block_type", F.coalesce("n_children", F.lit(0)).alias("n_children"))
