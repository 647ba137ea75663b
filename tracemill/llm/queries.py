"""Queries of the operators for language-model data, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import bpe, consensus, conversations, packing, pii, quantiles
from tracemill.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_turns(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "chat_messages")
    return conversations.with_texts(conversations.conversations(rows), rows)


def p4_block_length_percentiles(s: SparkSession, d: str) -> DataFrame:
    values = quantiles.checkpointed(quantiles.block_lengths(table(s, d, "block_signals")))
    return quantiles.percentiles(values, ["file_path", "corpus", "obs_date"])


def p4_merged_days(s: SparkSession, d: str) -> DataFrame:
    values = quantiles.checkpointed(quantiles.block_lengths(table(s, d, "block_signals")))
    days = quantiles.daily_digests(values, "obs_date", "corpus")
    return quantiles.percentiles(values, ["corpus"], built=quantiles.merge_digests(days.drop("day")))


def _labels(s: SparkSession, d: str) -> DataFrame:
    return consensus.score_labels(table(s, d, "attempts"), table(s, d, "pass1_scores"), table(s, d, "relabel_scores"))


def _fit(s: SparkSession, d: str) -> consensus.Fitted:
    return consensus.fit(_labels(s, d).select("unit", "rater", "label"))


def _packed(s: SparkSession, d: str) -> DataFrame:
    sizes = bpe.token_counts(table(s, d, "documents"), ["doc_id"]).withColumnRenamed("doc_id", "item_id")
    return packing.pack(sizes, packing.capacities(table(s, d, "context_windows")))


QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: conversations.found(table(s, d, "chat_messages")),
    "p1_turns": p1_turns,
    "p4_block_length_percentiles": p4_block_length_percentiles,
    "p4_merged_days": p4_merged_days,
    "p4_baseline_percentiles": lambda s, d: quantiles.percentiles(quantiles.baseline_values(table(s, d, "baseline_stats")), ["stat"]),
    "p4_corpus_mad": lambda s, d: quantiles.mad(quantiles.checkpointed(quantiles.block_lengths(table(s, d, "block_signals"))), "corpus"),
    "p6_found": lambda s, d: consensus.by_unit(_fit(s, d).units).select("session_id", "block_index", "score"),
    "p6_consensus": lambda s, d: consensus.by_unit(_fit(s, d).units),
    "p6_raters": lambda s, d: _fit(s, d).raters,
    "p6_agreement": lambda s, d: consensus.agreement(_labels(s, d)),
    "p7_ids": lambda s, d: bpe.encode_corpus(table(s, d, "documents")),
    "p8_packed": lambda s, d: _packed(s, d).withColumnRenamed("item_id", "doc_id"),
    "p9_found": lambda s, d: pii.find(table(s, d, "documents")),
    "p9_redacted": lambda s, d: pii.redact(table(s, d, "documents")),
    "p9_counts": lambda s, d: pii.counts(pii.find(table(s, d, "documents"))),
    "p8_fill": lambda s, d: packing.fill_report(_packed(s, d)),
}

_UNITS = """
with labels as (
  select session_id, block_index, pass_id as rater, arg_min(score, (attempt, score)) as label from attempts
  where valid and score between 0 and 3 and session_id is not null and block_index is not null and pass_id is not null group by 1, 2, 3
  union all
  select session_id, block_index, 'v1-pass1', min(score) from pass1_scores where score between 0 and 3 and session_id is not null and block_index is not null group by 1, 2
  union all
  select session_id, block_index, rater_id, min(relabel_score) from relabel_scores
  where relabel_score between 0 and 3 and session_id is not null and block_index is not null and rater_id is not null group by 1, 2, 3
), per as (
  select session_id, block_index, count(*) as m, count(*) filter (label = 0) as c0, count(*) filter (label = 1) as c1, count(*) filter (label = 2) as c2, count(*) filter (label = 3) as c3
  from labels group by 1, 2 having count(*) >= 2
), cells as (
  select a, b, sum((case a when 0 then c0 when 1 then c1 when 2 then c2 else c3 end) * ((case b when 0 then c0 when 1 then c1 when 2 then c2 else c3 end) - (case when a = b then 1 else 0 end)) / cast(m - 1 as double)) as o
  from per, (select unnest(range(4)) as a) x, (select unnest(range(4)) as b) y group by 1, 2
), mass as (select a, sum(o) as n from cells group by 1), total as (select count(*) as n_units, cast(sum(m) as bigint) as n_labels from per)
select n_units, n_labels, (select sum(o) from cells where a = b) / n_labels as pair_agreement,
  1 - (n_labels - 1) * (select sum(o) from cells where a <> b) / (select sum(x.n * y.n) from mass x, mass y where x.a <> y.a) as alpha_nominal,
  1 - (n_labels - 1) * (select sum(o * (a - b) * (a - b)) from cells) / (select sum(x.n * y.n * (x.a - y.a) * (x.a - y.a)) from mass x, mass y) as alpha_interval
from total
"""

_ROLE = "case " + " ".join(f"when regexp_replace(lower(msg_role), '[^a-z]', '', 'g') in ({', '.join(repr(x) for x in v)}) then '{k}'" for k, v in conversations.ROLES.items()) + " end"
_TURNS = f"""
with recursive rows0 as (
  select lower(trim(session_id)) as session_id, nullif(trim(msg_uuid), '') as msg_uuid, parent_uuid, {_ROLE} as role,
    case when regexp_matches(msg_timestamp, '^[0-9]{{11,14}}$') then cast(msg_timestamp as bigint) * 1000
      when regexp_matches(msg_timestamp, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}([.][0-9]+)?(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') and msg_timestamp not like '0000%' then epoch_us(try_cast(msg_timestamp as timestamptz)) end as instant,
    coalesce(regexp_matches(msg_text, '[^\\s\\x{{A0}}\\x{{200B}}\\x{{FEFF}}]'), false) as visible
  from chat_messages where session_id is not null
), m as (
  select session_id, msg_uuid, min(role) as role, min(instant) as instant, bool_or(visible) as visible, max(parent_uuid) as parent_uuid, bool_or(msg_uuid is null or role is null or instant is null) as unsound from rows0 where session_id <> '' group by 1, 2
), linked as (
  select c.*, p.instant as above, c.parent_uuid is not null and (p.msg_uuid is null or p.instant is null or c.instant is null or p.instant > c.instant or p.msg_uuid = c.msg_uuid) as orphan from m c left join m p on p.session_id = c.session_id and p.msg_uuid = c.parent_uuid
), deep as (
  select session_id, msg_uuid, instant, 0 as depth from linked where parent_uuid is null or above is null or above <> instant
  union all
  select l.session_id, l.msg_uuid, l.instant, deep.depth + 1 from linked l join deep on l.session_id = deep.session_id and l.parent_uuid = deep.msg_uuid and l.instant = deep.instant
), bad as (
  select session_id from linked where unsound or orphan union select session_id from linked l where msg_uuid is not null and not exists (select 1 from deep where deep.session_id = l.session_id and deep.msg_uuid = l.msg_uuid)
), turns as (
  select l.session_id, l.msg_uuid, l.role, row_number() over (partition by l.session_id order by l.instant, deep.depth, l.msg_uuid) - 1 as turn from linked l join deep on deep.session_id = l.session_id and deep.msg_uuid = l.msg_uuid
  where l.visible and l.session_id not in (select session_id from bad)
), talk as (
  select session_id, role, lead(role) over (partition by session_id order by turn) as answer, row_number() over (partition by session_id order by turn) as nth from turns where role in ('user', 'assistant')
), sound as (select session_id from talk group by 1 having bool_and(role <> 'user' or coalesce(answer, '') = 'assistant') and bool_or(nth = 1 and role = 'user'))
select session_id, cast(turn as integer) as turn, msg_uuid from turns where session_id in (select session_id from sound)
"""

SQL: dict[str, str] = {"p1_found": _TURNS, "p6_agreement": _UNITS}

