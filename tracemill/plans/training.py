"""Queries of the training-data operators that belong to the core: damaged rows (2), nested records (3), drifting schemas (5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import drift, nested
from tracemill.runtime import table
from tracemill.sources import delimited

Query = Callable[[SparkSession, str], DataFrame]


def p5_ingested(spark: SparkSession, d: str) -> DataFrame:
    return drift.ingest(table(spark, d, "attribution_exports"), drift.EXPORT_TARGET)


def p5_replayed(spark: SparkSession, d: str) -> DataFrame:
    return drift.replay(p5_ingested(spark, d), {"attribution.file_paths": "array<string>", "tags": "array<string>", "latencyMs": "double"})


QUERIES: dict[str, Query] = {
    "p2_found": lambda s, d: delimited.failed_lines(table(s, d, "raw_lines")),
    "p2_valid": lambda s, d: delimited.valid_records(table(s, d, "raw_lines")),
    "p2_summary": lambda s, d: delimited.read_delimited(table(s, d, "raw_lines")).groupBy("file_name").agg(F.count("*").alias("n_records"), F.count("reason").alias("n_failed"), *(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in delimited.REASONS)),
    "p3_found": lambda s, d: nested.found(table(s, d, "session_records")),
    "p3_records": lambda s, d: nested.records_table(table(s, d, "session_records")),
    "p3_children": lambda s, d: nested.children_per_block(table(s, d, "session_records")),
    "p5_found": lambda s, d: drift.found(table(s, d, "attribution_exports")),
    "p5_ingested": p5_ingested,
    "p5_replayed": p5_replayed,
}

_BLOCKS = """
rec as (select record_id, try_cast(payload as json) as p from session_records),
msg as (
  select record_id, p->>'$.type' as t, case json_type(p->'$.message') when 'OBJECT' then p->'$.message' when 'VARCHAR' then try_cast(p->>'$.message' as json) end as m,
    case json_type(p->'$.data') when 'OBJECT' then p->'$.data' when 'VARCHAR' then try_cast(p->>'$.data' as json) end as dat
  from rec where json_type(p) = 'OBJECT'
), inner1 as (
  select *, case json_type(dat->'$.message') when 'OBJECT' then dat->'$.message' when 'VARCHAR' then try_cast(dat->>'$.message' as json) end as m1 from msg
), inner2 as (
  select *, case json_type(m1->'$.message') when 'OBJECT' then m1->'$.message' when 'VARCHAR' then try_cast(m1->>'$.message' as json) end as m2 from inner1
), top as (
  select record_id, case when t in ('assistant', 'user') then m->'$.content' when t = 'progress' and dat->>'$.type' = 'agent_progress' then m2->'$.content' end as content from inner2
), items as (
  select record_id, '' as parent_path, cast(i as varchar) as block_path, content->i as b from (select record_id, content, unnest(range(cast(json_array_length(content) as bigint))) as i from top where json_type(content) = 'ARRAY')
  union all
  select record_id, block_path, block_path || '.' || i, (b->'$.content')->i from (select record_id, block_path, b, unnest(range(cast(json_array_length(b->'$.content') as bigint))) as i from items where json_type(b) = 'OBJECT' and json_type(b->'$.type') = 'VARCHAR' and json_type(b->'$.content') = 'ARRAY')
), blocks as (select record_id, block_path, parent_path, b->>'$.type' as block_type from items where json_type(b) = 'OBJECT' and json_type(b->'$.type') = 'VARCHAR')"""

SQL: dict[str, str] = {
    "p3_found": f"with recursive {_BLOCKS} select * from blocks",
    "p3_children": f"with recursive {_BLOCKS} select b.record_id, b.block_path, b.block_type, (select count(*) from blocks c where c.record_id = b.record_id and c.parent_path = b.block_path) as n_children from blocks b",
}
