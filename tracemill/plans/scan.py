"""Queries of the scan over the session records, and the SQL of those that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import scan, scoring
from tracemill.operators.schema import EVENT_TYPES
from tracemill.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def scanned(s: SparkSession, d: str) -> scan.Scan:
    return scan.Scan(table(s, d, "session_records"))


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six decimals."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def scan_events(s: SparkSession, d: str) -> DataFrame:
    e = scanned(s, d).events
    return e.select("session", "record_id", "event_index", "segment_id", "type", "model", "assistant_like", "agent_sourced", F.size("blocks").cast("long").alias("n_blocks"))


def scan_report(s: SparkSession, d: str) -> DataFrame:
    """The report's files by score, then path, with the leading excerpts of each; files without any source on disk stay if they were written."""
    x = scanned(s, d)
    files = x.report_files().select("path", "name", "directory", "score", "tangle_count", "thinking_resolution_rate", "session_count", "leakage_total", "read", "edit", "write", "bash", "grep", "glob")
    told = x.excerpts_by_file().groupBy("path").agg(F.count("*").alias("n_excerpts"))
    return r6(files.join(told, "path", "left").na.fill(0, ["n_excerpts"]))


QUERIES: dict[str, Query] = {
    "scan_events": scan_events,
    "scan_models": lambda s, d: scanned(s, d).models(),
    "tool_paths": lambda s, d: scanned(s, d).uses.select("tool_name", F.explode("paths").alias("path")).groupBy("tool_name", "path").agg(F.count("*").alias("n")),
    "tool_usage": lambda s, d: scan.tool_usage(scanned(s, d).uses),
    "file_leakage": lambda s, d: scanned(s, d).leaks.groupBy("path").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in scan.LEAKS), F.count("*").alias("total")),
    "thinking_attribution": lambda s, d: scanned(s, d).blocks.select("session", "event_index", "pos", "block_index", "tool_use_coupling", "tier", F.array_sort("file_paths").alias("file_paths"), "proximity_distance", "proximity_direction", "cluster_count"),
    "corpus_baselines": lambda s, d: r6(scanned(s, d).corpus_baselines()),
    "session_baselines": lambda s, d: r6(scanned(s, d).session_baselines()),
    "file_scores_full": lambda s, d: r6(scanned(s, d).file_scores()),
    "excerpts_by_file": lambda s, d: scanned(s, d).excerpts_by_file().select("path", "session", "block_index", "cluster_index", "rank", F.sha2("text", 256).alias("text_hash")),
    "scan_report": scan_report,
    "top_components": lambda s, d: r6(scanned(s, d).top_components()),
    "session_titles": lambda s, d: scanned(s, d).titles(),
    "report_top": lambda s, d: scoring.ranked(scanned(s, d).report_files().select("path", F.round("score", 6).alias("score"))),
}

_TYPES = ", ".join(f"'{t}'" for t in EVENT_TYPES)
_EVENTS = f"""
rec as (select file_name as session, record_id, try_cast(payload as json) as p from session_records),
raw as (select session, record_id, p, p->>'$.type' as type, p->>'$.subtype' as subtype, try_cast(p->>'$.timestamp' as timestamptz) as stamp from rec where json_type(p) = 'OBJECT' and json_type(p->'$.type') = 'VARCHAR' and p->>'$.type' in ({_TYPES})),
ev as (
  select *, row_number() over w - 1 as event_index, cast(sum(case when type = 'system' and subtype = 'compact_boundary' then 1 else 0 end) over (w rows unbounded preceding) as bigint) as segment_id,
    type = 'progress' and coalesce(p->>'$.data.type', '') = 'agent_progress' as agent_sourced
  from raw window w as (partition by session order by stamp nulls first, record_id)
), turn as (
  select *, case when type in ('assistant', 'user') then p->'$.message.content' when agent_sourced then p->'$.data.message.message.content' end as content,
    type = 'assistant' or (agent_sourced and coalesce(p->>'$.data.message.type', '') = 'assistant') as assistant_like from ev
), item as (
  select session, record_id, event_index, segment_id, type, p, i as pos, content->i as b from (select *, unnest(range(cast(json_array_length(content) as bigint))) as i from turn where json_type(content) = 'ARRAY')
), block as (
  select *, b->>'$.type' as kind from item where json_type(b) = 'OBJECT' and json_type(b->'$.type') = 'VARCHAR' and b->>'$.type' in ('text', 'thinking', 'tool_use', 'tool_result')
)"""

SQL: dict[str, str] = {
    "scan_events": f"""with {_EVENTS}, n as (select record_id, count(*) as n from block group by 1)
      select session, turn.record_id, event_index, segment_id, type, case when type = 'assistant' then p->>'$.message.model' when assistant_like then p->>'$.data.message.message.model' end as model, assistant_like, agent_sourced, coalesce(n, 0) as n_blocks from turn left join n using (record_id)""",
    "session_titles": """with r as (select file_name as session, row(coalesce(try_cast(p->>'$.timestamp' as timestamptz), timestamptz '0001-01-01'), record_id) as at_, p->>'$.type' as type, case when json_type(p->'$.aiTitle') = 'VARCHAR' then p->>'$.aiTitle' end as title, case when json_type(p->'$.lastPrompt') = 'VARCHAR' then p->>'$.lastPrompt' end as prompt
        from (select file_name, record_id, try_cast(payload as json) as p from session_records)),
      g as (select session, arg_max(title, at_) filter (type = 'ai-title' and regexp_matches(title, '\\S')) as title, arg_min(prompt, at_) filter (type = 'last-prompt' and regexp_matches(prompt, '\\S')) as prompt from r group by 1),
      f as (select session, title, regexp_replace(trim(split_part(regexp_replace(prompt, '^\\s+', ''), chr(10), 1)), '^# +', '') as line from g)
      select session, coalesce(title, case when length(line) > 60 then line[1:59] || '…' else line end, '(untitled)') as title from f""",
    "scan_models": f"""with {_EVENTS}, m as (select session, case when type = 'assistant' then p->>'$.message.model' when assistant_like then p->>'$.data.message.message.model' end as model, assistant_like from turn)
      select coalesce(model, 'unknown') as model, count(*) as n_events, count(distinct session) as n_sessions from m where model is not null or assistant_like group by 1""",
}
