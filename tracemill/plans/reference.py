"""Queries of the reference's operators over the test tables, each with the SQL it must agree with.

Stand-ins: a session is events.user_id, its order (ts, event_id), a boundary is 'signup'; view, purchase and click are reading, editing and
searching or running; an action errs if the next event of its segment is 'error'. k of props gives paths (k % 10) and patterns (k).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import complexity, judge, shell, text
from tracemill.operators import attribution, behaviour, joins, nested, sampling, scoring, stats, units, windows
from tracemill.operators.schema import EVENT_TYPES
from tracemill.plans.training import _BLOCKS as _NESTED
from tracemill.runtime import checkpointed, spread, table
from tracemill.sources import session_log

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ["user_id", "segment_id"]

_EV = """
ev0 as (
  select event_id, user_id, ts, event_type, value, cast(json_extract(props, '$.k') as integer) as k,
    row_number() over (partition by user_id order by ts, event_id) - 1 as event_index,
    cast(sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as segment_id
  from events
), ev as (
  select *, cast(k % 10 as varchar) as path, cast(k % 10 as varchar) as scope, cast(k as varchar) as pattern, concat('cmd', k % 10, ' ', k) as command,
    coalesce(lead(event_type) over (partition by user_id, segment_id order by event_index) = 'error', false) as errored
  from ev0 where event_type <> 'signup'
)"""


def indexed(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return windows.ordinals(e, "user_id", "ts", "event_id", F.col("event_type") == "signup")


def inside(s: SparkSession, d: str) -> DataFrame:
    """Events within segments (the boundaries themselves left out) with paths, patterns, commands and whether they err."""
    e = indexed(s, d).filter("event_type <> 'signup'")
    nxt = windows.with_halo(e, 1).withColumn("_n", F.lead("event_type").over(Window.partitionBy(*KEYS, "bucket").orderBy("event_index"))).filter("home").drop("bucket", "home")
    m = (F.col("k") % 10).cast("string")
    return nxt.select("*", m.alias("path"), m.alias("scope"), F.col("k").cast("string").alias("pattern"), F.concat(F.lit("cmd"), m, F.lit(" "), F.col("k").cast("string")).alias("command"), F.coalesce(F.col("_n") == "error", F.lit(False)).alias("errored")).drop("_n")


def is_(kind: str):
    return F.col("event_type") == kind


def detected(s: SparkSession, d: str) -> dict[str, DataFrame]:
    e = inside(s, d)
    click = e.filter(is_("click"))
    return {
        "edit_failures": behaviour.edit_failures(e, KEYS, is_("purchase"), is_("view"), F.col("errored")),
        "read_after_edit": behaviour.read_after_edit(e, KEYS, is_("purchase"), is_("view")),
        "grep_reformulations": behaviour.grep_reformulations(click, KEYS),
        "bash_retries": behaviour.bash_retries(click, KEYS),
    }


_DETECT = {
    "edit_failures": "select * from ev e where event_type = 'purchase' and (errored or exists (select 1 from ev r where r.event_type = 'view' and r.user_id = e.user_id and r.segment_id = e.segment_id and r.path = e.path and r.event_index between e.event_index + 1 and e.event_index + 3))",
    "read_after_edit": "select * from ev e where event_type = 'purchase' and exists (select 1 from ev r where r.event_type = 'view' and r.user_id = e.user_id and r.segment_id = e.segment_id and r.path = e.path and r.event_index between e.event_index + 1 and e.event_index + 3)",
    "grep_reformulations": "select * from ev e where event_type = 'click' and exists (select 1 from ev r where r.event_type = 'click' and r.user_id = e.user_id and r.segment_id = e.segment_id and r.scope is not distinct from e.scope and r.pattern is distinct from e.pattern and r.event_index between e.event_index + 1 and e.event_index + 3)",
    "bash_retries": "select * from ev e where event_type = 'click' and errored and exists (select 1 from ev r where r.event_type = 'click' and r.user_id = e.user_id and r.segment_id = e.segment_id and split_part(r.command, ' ', 1) = split_part(e.command, ' ', 1) and not (starts_with(r.command, e.command) and length(r.command) > length(e.command)) and r.event_index between e.event_index + 1 and e.event_index + 3)",
}
_COLS = "event_id, user_id, event_index, segment_id, path"


def _burst(kind: str) -> Query:
    def q(s: SparkSession, d: str) -> DataFrame:
        b = windows.bursts(inside(s, d).filter(is_(kind)), [*KEYS, "path"])
        return b.filter("burst").groupBy("path").agg(F.count("*").alias("n"))

    return q


def _burst_sql(kind: str) -> str:
    return f"with {_EV}, u as (select path, count(*) over (partition by user_id, segment_id, path order by event_index range between 5 preceding and 5 following) as c from ev where event_type = '{kind}') select path, count(*) as n from u where c > 1 group by 1"


_SPACE = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WORD = f"[^{_SPACE}]+"
_MARK_SQL = text.marker_pattern_without_lookaround().replace("'", "''")
_FENCE_SQL = "(?m)^```(?s:.*?)^```"
_BARE = f"regexp_replace(text, '{_FENCE_SQL}', '', 'g')"
_COUNT_WORDS = f"len(regexp_extract_all(bare, '{_WORD}'))"
# fences with backquotes for their words, and commas doubled, as the marker pattern takes the character before along
_MASKED = f"case when text is not null then replace(array_to_string(list_transform(list_zip(string_split_regex(text, '{_FENCE_SQL}'), regexp_extract_all(text, '{_FENCE_SQL}')), lambda x: concat(x[1], regexp_replace(coalesce(x[2], ''), '[^{_SPACE}]', '`', 'g'))), ''), ',', ',,') end"
_SIG = f"""
sig0 as (select *, {_BARE} as bare, {_MASKED} as masked from documents),
sig as (
  select doc_id, source, lang, session_id, block_index, block_kind, text, cast({_COUNT_WORDS} as bigint) as length_words, cast(length(bare) as bigint) as length_chars,
    cast(len(regexp_extract_all(masked, '{_MARK_SQL}')) as bigint) as marker_count,
    len(regexp_extract_all(bare, '\\?')) * 100.0 / greatest({_COUNT_WORDS}, 1) as question_rate_per_100w,
    len(regexp_extract_all(masked, '{_MARK_SQL}')) * 100.0 / greatest({_COUNT_WORDS}, 1) as markers_per_100w
  from sig0
)"""
_CLUSTERS = f"""
sig0 as (select doc_id, {_MASKED} as masked from documents),
cut as (select doc_id, masked, string_split_regex(masked, '{_MARK_SQL}') as pieces, regexp_extract_all(masked, '{_MARK_SQL}') as marks from sig0),
nth as (select *, unnest(range(1, len(marks) + 1)) as i from cut),
place as (select doc_id, i, masked[1 : length(array_to_string(pieces[1:i], '')) + length(array_to_string(marks[1:i - 1], '')) + case when regexp_matches(marks[i], '(?i)^[a-z]') then 0 else 1 end] as before from nth),
marker as (select doc_id, i, len(regexp_extract_all(before, '{_WORD}')) - cast(regexp_matches(before, '{_WORD}$') as integer) as word_index from place),
jump as (select doc_id, i, case when word_index - lag(word_index) over (partition by doc_id order by i) > 200 then 1 else 0 end as jumped from marker),
clustered as (select doc_id, i, sum(jumped) over (partition by doc_id order by i) as cluster_index from jump)"""


def documents(s: SparkSession, d: str) -> DataFrame:
    """The documents in as many partitions as there are cores, as their regular expressions cost more than reading them."""
    return spread(table(s, d, "documents"))


def signals(s: SparkSession, d: str) -> DataFrame:
    return text.signals(documents(s, d))


def r6(name: str):
    return F.round(name, 6).alias(name)


def block_signals(s: SparkSession, d: str) -> DataFrame:
    return signals(s, d).select("doc_id", "length_words", "length_chars", "marker_count", r6("question_rate_per_100w"), r6("markers_per_100w"))


def attributed(s: SparkSession, d: str) -> DataFrame:
    """Document blocks with the paths they name and their signals, written once as several branches read them; tool results count as coupled."""
    sig = signals(s, d).select("doc_id", "session_id", "block_kind", "text", "length_words", "marker_count", "markers_per_100w").withColumn("paths", F.array_distinct(text.path_scan(F.col("text")))).withColumn("coupled", F.coalesce(F.col("block_kind") == "tool_result", F.lit(False)))
    return checkpointed(sig.drop("text"))


_END = "(?:" + "|".join(sorted(text.SUFFIXES, key=lambda s: (-len(s), s))) + ")"
_STOP = _SPACE + r"\x27\x22`;|&<>$()\[\]{}*?:"
# a run of path characters; its words: whole if it begins rooted, else up to the last known ending, and from the first rooted place in what is left
_SCAN = f"""
runs as (select doc_id, unnest(regexp_extract_all(text, '[^{_STOP}]*[./][^{_STOP}]*')) as run from documents),
heads as (select doc_id, run, case when regexp_matches(run, '^(/|[.]/|[.][.]/)') then run else regexp_extract(run, '^((?s:.+)[.]{_END})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1) end as head from runs),
tails as (select doc_id, head, case when head = '' then regexp_extract(run, '(?:^|[^\\p{{L}}\\p{{N}}_])((?:/|[.]/|[.][.]/)(?s:.*))$', 1) else regexp_extract(run[length(head) + 1 :], '[^\\p{{L}}\\p{{N}}_]((?:/|[.]/|[.][.]/)(?s:.*))$', 1) end as tail from heads),
words as (select doc_id, regexp_replace(unnest([head, tail]), '[,;:]+$', '') as path from tails),
scan as (select distinct doc_id, path from words where path <> '' and not starts_with(path, '//'))"""
_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _sql_pattern(table: dict[tuple, str], ext: str) -> str:
    """A fixed pattern with the classes of characters that RE2 has for ASCII only written out."""
    p = next(p for endings, p in table.items() if ext in endings)
    return "(?m)" + p.replace(r"\s", f"[{_SPACE}]").replace(r"\w", r"[\p{L}\p{N}_]")


_EXCERPTS = f"""
{_CLUSTERS}, hit as (select c.doc_id, i, cluster_index, word_index, max(cluster_index) over (partition by c.doc_id) + 1 as cluster_count from clustered c join marker m using (doc_id, i)),
cl as (select doc_id, cluster_index, any_value(cluster_count) as cluster_count, greatest(min(word_index) - 50, 0) as low, max(word_index) + 50 as high, count(*) as n_highlights from hit group by 1, 2),
excerpt as (select doc_id, cast(cluster_index as bigint) as cluster_index, cast(cluster_count as bigint) as cluster_count, n_highlights,
  regexp_replace(array_to_string(regexp_extract_all(text, '[{_SPACE}]*{_WORD}')[low + 1 : high + 1], ''), '^[{_SPACE}]+', '') as excerpt from cl join documents using (doc_id))"""
_ATTR = f"""
{_SIG}, {_SCAN}, attr as (
  select sig.*, coalesce(block_kind = 'tool_result', false) as coupled, p.paths from sig left join (select doc_id, list(path) as paths from scan group by 1) p using (doc_id)
), exploded as (
  select *, 1.0 / len(paths) as share, unnest(paths) as path from attr
), agg as (
  select path, count(*) as tangle_count, sum(share) as weight, sum(case when marker_count > 0 then share else 0 end) as pw, sum(case when marker_count > 0 then share * markers_per_100w else 0 end) as pi,
    count(*) filter (coupled) as cc from exploded where path <> '' group by 1
), files as (
  select path, tangle_count, coalesce(pw / nullif(weight, 0), 0) * coalesce(pi / nullif(pw, 0), 0) as markers, cc * 1.0 / tangle_count as resolution_rate from agg
)"""


def _counts(blocks: DataFrame) -> dict[str, DataFrame]:
    """Behaviour counts per path of the documents: mentions in repeated blocks stand for re-reads, tool results for edits."""
    a = blocks.select(F.explode("paths").alias("path"), "session_id", "block_kind").filter("path <> ''")
    reread = a.groupBy("path", "session_id").agg(F.count("*").alias("c")).filter("c > 1").groupBy("path").agg(F.sum("c").alias("n"))
    churn = a.filter("block_kind = 'tool_result'").groupBy("path").agg(F.count("*").alias("n"))
    return {"reread_bursts": reread, "edit_churn": churn}


def baselines(counts: dict[str, DataFrame]) -> DataFrame:
    """One row with the median and MAD of each count."""
    long = reduce(DataFrame.unionByName, (c.select(F.lit(n).alias("g"), F.col("n").cast("double").alias("v")) for n, c in counts.items()))
    m = stats.median_mad(long, ["g"], "v")
    return m.agg(*(F.max(F.when(F.col("g") == n, F.col(x))).alias(f"{n}_{x}") for n in counts for x in ("median", "mad")))


def scores(s: SparkSession, d: str) -> DataFrame:
    blocks = attributed(s, d)
    c = {n: checkpointed(x) for n, x in _counts(blocks).items()}
    return scoring.file_scores(scoring.block_aggregate(blocks), c, baselines(c))


def file_score_topk(s: SparkSession, d: str) -> DataFrame:
    return scoring.ranked(scores(s, d).withColumn("score", F.round("score", 6))).select("path", "tangle_count", r6("markers"), r6("resolution_rate"), "reread_bursts", "edit_churn", "score")


_SCORES = f"""
{_ATTR}, men as (select unnest(paths) as path, session_id, block_kind from attr),
rr0 as (select path, session_id, count(*) as c from men where path <> '' group by 1, 2 having count(*) > 1),
rr as (select path, cast(sum(c) as bigint) as n from rr0 group by 1),
ch as (select path, count(*) as n from men where path <> '' and block_kind = 'tool_result' group by 1),
base as (select (select median(n) from rr) as rm, (select mad(n) from rr) as rd, (select median(n) from ch) as cm, (select mad(n) from ch) as cd),
joined as (
  select coalesce(f.path, rr.path, ch.path) as path, coalesce(tangle_count, 0) as tangle_count, coalesce(markers, 0) as markers, coalesce(resolution_rate, 0) as resolution_rate, coalesce(rr.n, 0) as reread_bursts, coalesce(ch.n, 0) as edit_churn
  from files f full outer join rr on f.path = rr.path full outer join ch on coalesce(f.path, rr.path) = ch.path
), scored as (
  select *, round(markers * 0.25 + (case when coalesce(rd, 0) <= 0 then 0 else (reread_bursts - rm) / (1.4826 * rd) end) * (0.25 / 3) + (case when coalesce(cd, 0) <= 0 then 0 else (edit_churn - cm) / (1.4826 * cd) end) * (0.25 / 3), 6) as score
  from joined, base
)"""


def session_blocks(s: SparkSession, d: str) -> DataFrame:
    """Blocks of the session records with their session and a sortable position (event time, record, path)."""
    r = table(s, d, "session_records")
    rec = nested.records_table(r).select("record_id", "session_id", "event_time", "record_type", "agent_sourced")
    return nested.blocks_table(r).join(rec, "record_id").withColumn("position", F.struct("event_time", "record_id", "block_path"))


def kappa_pairs(s: SparkSession, d: str) -> DataFrame:
    """Units scored by v1-pass1 and by people, one row for each unit and person."""
    key = ["session_id", "block_index"]
    p = table(s, d, "pass1_scores").filter("score between 0 and 3").groupBy(*key).agg(F.min("score").alias("judge"))
    h = table(s, d, "relabel_scores").filter("relabel_score between 0 and 3").groupBy(*key, "rater_id").agg(F.min("relabel_score").alias("human"))
    return p.join(h, key)


_PAIRS = """
pairs as (
  select p.session_id, p.block_index, rater_id, judge, human from (select session_id, block_index, min(score) as judge from pass1_scores where score between 0 and 3 group by 1, 2) p
  join (select session_id, block_index, rater_id, min(relabel_score) as human from relabel_scores where relabel_score between 0 and 3 group by 1, 2, 3) h on p.session_id = h.session_id and p.block_index = h.block_index
)"""
_CATS = [0, 1, 2, 3]


def kappa_grouping_sets(s: SparkSession, d: str) -> DataFrame:
    agg = kappa_pairs(s, d).rollup("rater_id").agg(*stats.weighted_kappa(None, "judge", "human", _CATS), F.grouping("rater_id").alias("pooled"))
    k = stats.kappa_of(agg, _CATS, ["rater_id", "pooled"])
    return k.select(F.coalesce("rater_id", F.lit("all")).alias("rater_id"), F.col("n").alias("n_pairs"), F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), r6("kappa"))


def first_valid(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "attempts").filter("valid and score between 0 and 3").groupBy("pass_id", "session_id", "block_index")
    return a.agg(F.min_by("score", F.struct("attempt", "score")).alias("score"))


_FIRST = "fv as (select pass_id, session_id, block_index, arg_min(score, (attempt, score)) as score from attempts where valid and score between 0 and 3 group by 1, 2, 3)"


def pairwise_kappa(s: SparkSession, d: str) -> DataFrame:
    f = first_valid(s, d)
    a, b = (f.select("session_id", "block_index", F.col("pass_id").alias(f"pass_{x}"), F.col("score").alias(x)) for x in "ab")
    pairs = a.join(b, ["session_id", "block_index"]).filter("pass_a < pass_b")
    k = stats.kappa_of(pairs.groupBy("pass_a", "pass_b").agg(*stats.weighted_kappa(pairs, "a", "b", _CATS)), _CATS, ["pass_a", "pass_b"])
    return k.select("pass_a", "pass_b", F.col("n").alias("n_pairs"), r6("kappa"))


def messages(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "chat_messages").filter("session_id is not null and msg_uuid is not null")
    return m.groupBy("session_id", "msg_uuid").agg(F.min("row_id").alias("row_id"), F.min_by("msg_role", "row_id").alias("msg_role"), F.min_by("msg_text", "row_id").alias("msg_text"))


_MSG = "msg0 as (select *, row_number() over (partition by session_id, msg_uuid order by row_id) as rn from chat_messages where session_id is not null and msg_uuid is not null), msg as (select session_id, msg_uuid, row_id, msg_role, msg_text from msg0 where rn = 1)"


def is_action():
    return F.coalesce(F.lower(F.trim("msg_role")).isin("assistant", "ai", "model"), F.lit(False))


_ACT = "coalesce(lower(trim(msg_role)) in ('assistant', 'ai', 'model'), false)"


def anchored(s: SparkSession, d: str) -> DataFrame:
    return units.anchor(messages(s, d), "session_id", "row_id", is_action(), "msg_text")


def anchored_units(s: SparkSession, d: str) -> DataFrame:
    return anchored(s, d).select("session_id", "unit", "n_fragments", F.sha2("unit_text", 256).alias("text_hash"), "emission_kind")


_UNIT = f"""
{_MSG}, w as (select *, {_ACT} as act, cast(coalesce(sum(case when {_ACT} then 1 else 0 end) over (partition by session_id order by row_id rows unbounded preceding), 0) as bigint) as unit from msg),
frag as (select * from w where not act and regexp_matches(coalesce(msg_text, ''), '\\S')),
steps as (select session_id, max(unit) as n_steps from w group by 1)"""


def rank_correlation(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("qty"))
    o = table(s, d, "orders").join(lines, "o_orderkey").select("o_orderpriority", "o_totalprice", "qty")
    r = stats.average_ranks(stats.average_ranks(o, ["o_orderpriority"], "o_totalprice", "ra"), ["o_orderpriority"], "qty", "rb")
    return r.groupBy("o_orderpriority").agg(F.round(stats.guarded_corr("ra", "rb"), 6).alias("rho"), F.count("*").alias("n"))


def unit_coverage(s: SparkSession, d: str) -> DataFrame:
    u = first_valid(s, d).select("session_id", "block_index")
    return joins.coverage(table(s, d, "documents").filter("block_kind is not null"), u, ["session_id", "block_index"], "block_kind").withColumn("coverage", F.round("coverage", 6))


def manifest(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    found = docs.filter("doc_id % 7 <> 0").withColumn("sha", F.when(F.col("doc_id") % 11 == 0, F.sha2("sha", 256)).otherwise(F.col("sha"))).unionByName(docs.filter("doc_id % 13 = 0").withColumn("doc_id", -F.col("doc_id") - 1))
    return docs, found


def nearest(s: SparkSession, d: str) -> DataFrame:
    e = windows.nearest_path(inside(s, d), KEYS, F.when(F.col("event_type") != "error", F.col("path")))
    return e.filter(is_("error")).select("event_id", F.col("nearest_path").alias("path"), F.col("nearest_distance").alias("distance"), F.col("nearest_direction").alias("direction"))


def nearest_rank(sig: DataFrame) -> DataFrame:
    n = F.col("n")
    pos = lambda p: F.bround(p * (n - 1), 0)
    return stats.index_percentiles(sig, ["source"], "length_words", {f"q{int(p * 100)}": pos(p) for p in (0.1, 0.5, 0.9)})


#: Measures of the sources; documents without one are a group.
_BY_SOURCE: dict[str, Callable[[DataFrame], DataFrame]] = {
    "median_mad_by_source": lambda sig: stats.median_mad(sig.withColumn("v", F.col("length_words").cast("double")), ["source"], "v"),
    "presence_intensity": lambda sig: stats.presence_intensity(sig, ["source"], "markers_per_100w").select("source", r6("presence_rate"), r6("intensity_median"), "n", "n_positive", "low_confidence"),
    "topk_excerpts": lambda sig: scoring.top_per_group(sig.select("source", "doc_id", "marker_count"), "source", [F.desc_nulls_last("marker_count"), F.col("doc_id")], 5).select("source", "doc_id", "marker_count", "rank"),
    "nearest_rank_quantiles": nearest_rank,
}


def robust_z_stats(s: SparkSession, d: str) -> DataFrame:
    """The z of every baseline, unrounded: extreme ones are to be compared by relative error."""
    return table(s, d, "baseline_stats").select("stat_id", stats.robust_z(F.lit(1.0), F.col("median"), F.col("mad")).alias("z"))


def tool_call_summary(s: SparkSession, d: str) -> DataFrame:
    t = joins.tool_calls(session_blocks(s, d).filter("session_id is not null"))
    return t.groupBy("tool_name").agg(F.count("*").alias("n_calls"), F.count("result_at").alias("n_results"))


def answers(s: SparkSession, d: str) -> DataFrame:
    """Judges' answers made up from the ledger: prose around a JSON object, some of them broken in the ways the reader must tell apart."""
    a = table(s, d, "attempts")
    body = F.concat(F.lit("Verdict {sic}: "), F.to_json(F.struct("score", "justification")), F.lit(" -- end"))
    j = a.withColumn("answer", F.when(F.col("ledger_id") % 17 == 0, F.lit("no object here")).otherwise(body)).withColumn("p", judge.answer_parts("answer"))
    return j.groupBy(judge.outcome(F.col("p"), F.col("stop_reason")).alias("outcome")).agg(F.count("*").alias("n"))


def attributed_tiers(s: SparkSession, d: str) -> DataFrame:
    """Thinking blocks against the paths that the tool results of their session name."""
    docs = documents(s, d).filter("session_id is not null")
    ev = docs.filter("block_kind = 'tool_result'").select("session_id", F.explode(F.array_distinct(text.path_scan(F.col("text")))).alias("path"))
    a = attribution.attribute(docs.filter("block_kind = 'thinking'").withColumnRenamed("doc_id", "block_id"), ev)
    return a.filter("tier is not null").select("session_id", "block_id", "tier", F.size("file_paths").cast("long").alias("n_paths"))


def source_measures(s: SparkSession, d: str) -> DataFrame:
    """Texts as sources under an ending that goes by their id."""
    end = F.element_at(F.array(*map(F.lit, ("py", "js", "go", "sql"))), (F.col("doc_id") % 4 + 1).cast("int"))
    f = documents(s, d).filter("text is not null").select(F.concat(F.lit("src/d."), end).alias("path"), F.col("text").alias("content"))
    return complexity.measures(f).groupBy("path").agg(*(F.sum(c).alias(c) for c in ("loc", "code_lines", "n_functions", "n_classes")))


def python_complexity(s: SparkSession, d: str) -> DataFrame:
    """Branch counts and Halstead volume of the texts that parse as Python."""
    f = documents(s, d).select("doc_id", complexity.cyclomatic("text").alias("c"), complexity.halstead("text").alias("h"))
    return f.filter("c.n is not null").select("doc_id", "c.max", "c.mean", "c.sum", F.col("h.volume").alias("volume"))


def latency(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "attempts").groupBy("pass_id").agg(F.min("latency_s").alias("low"), F.median("latency_s").alias("middle"), F.max("latency_s").alias("high"), F.count("*").alias("n"), F.sum("infra_retries").alias("retries"))


def path_tokens(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", F.explode(F.array_distinct(text.path_scan(F.col("text")))).alias("path")).groupBy("path").agg(F.count("*").alias("n_documents"))


def user_ignore(s: SparkSession, d: str) -> DataFrame:
    paths = documents(s, d).select(F.explode(F.array_distinct(text.path_scan(F.col("text")))).alias("path")).distinct()
    return paths.filter(attribution.user_ignored(F.col("path"), ["*.md", "tests/", "!tests/**/*.md", "/src/*.py", "# note"]))



QUERIES: dict[str, Query] = {
    "event_ordinal_segments": lambda s, d: indexed(s, d).select("event_id", "user_id", "event_index", "segment_id"),
    "reread_bursts": _burst("view"),
    "edit_churn": _burst("purchase"),
    "tool_coupling": lambda s, d: windows.coupling(inside(s, d), KEYS, F.col("event_type").isin("view", "purchase", "click")).filter(is_("error")).select("event_id", "coupled"),
    "tier3_nearest": nearest,
    **{n: (lambda s, d, n=n: detected(s, d)[n].select("event_id", "user_id", "event_index", "segment_id", "path")) for n in _DETECT},
    "bash_retry_pairs": lambda s, d: detected(s, d)["bash_retries"].select("event_id", "retry_index", "retry_command"),
    "leakage_rollup": lambda s, d: behaviour.rollup(detected(s, d), "path"),
    "leakage_by_session": lambda s, d: behaviour.rollup(detected(s, d), "user_id"),
    "tool_usage_by_file": lambda s, d: inside(s, d).filter(F.col("event_type").isin("view", "purchase", "click")).groupBy("path").pivot("event_type", ["click", "purchase", "view"]).count().na.fill(0).select("path", *(F.col(c).alias(f"n_{c}") for c in ("click", "purchase", "view"))),
    "sessions_by_file": lambda s, d: inside(s, d).groupBy("path").agg(F.countDistinct("user_id").alias("n_sessions")),
    "carry_forward_state": lambda s, d: windows.carry_forward(indexed(s, d), "user_id", F.when(is_("purchase"), (F.col("k") % 10).cast("string")), "open_path").filter(is_("error")).select("event_id", "open_path"),
    "block_signals": block_signals,
    "marker_clusters": lambda s, d: text.clusters(text.marker_positions(documents(s, d), "doc_id"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_markers"), F.max("cluster_index").alias("last_cluster")),
    **{n: (lambda s, d, f=f: f(signals(s, d))) for n, f in _BY_SOURCE.items()},
    "path_tokens": path_tokens,
    "user_ignore": user_ignore,
    "file_score_topk": file_score_topk,
    "attribution_tiers": attributed_tiers,
    "corpus_mode": lambda s, d: scoring.corpus_mode(scores(s, d).withColumn("score", F.round("score", 6))),
    "noise_in_top": lambda s, d: scoring.ranked(scores(s, d).withColumn("score", F.round("score", 6))).agg(F.count_if(scoring.noisy(F.col("path"))).alias("n_noise"), F.count_if(scoring.ignored(F.col("path"))).alias("n_ignored"), F.count("*").alias("n")),
    "home_redaction": lambda s, d: documents(s, d).select("doc_id", F.sha2(text.redact_home(F.concat(F.lit("/home/someone/"), F.col("text"))), 256).alias("hash")),
    "model_distribution": lambda s, d: table(s, d, "chat_messages").groupBy(F.coalesce("model", F.lit("unknown")).alias("model")).agg(F.count("*").alias("n_events"), F.countDistinct("session_id").alias("n_sessions")),
    "last_first_title": lambda s, d: joins.first_last(table(s, d, "active_sessions"), "session_id", "mtime", "title"),
    "session_age": lambda s, d: table(s, d, "active_sessions").select("session_id", "mtime", text.relative_time(F.lit(1_780_000_000.0) - F.col("mtime")).alias("age"), text.fallback_title(F.col("title")).alias("short_title")).groupBy("age").agg(F.count("*").alias("n"), F.max(F.length("short_title")).cast("long").alias("longest")),
    "anchored_units": anchored_units,
    "fragment_offsets": lambda s, d: units.recovered(anchored(s, d)).select("session_id", "unit", F.posexplode("fragments").alias("nth", "f"), "recovered").select("session_id", "unit", F.col("nth").cast("long").alias("nth"), "f.start", "f.end", F.sha2(F.element_at("recovered", F.col("nth") + 1), 256).alias("text_hash")),
    "alternation_census": lambda s, d: units.alternation(messages(s, d), "session_id", "row_id", is_action()),
    "systematic_sample": lambda s, d: sampling.systematic(table(s, d, "documents").select("doc_id"), "doc_id"),
    "stratified_sample": lambda s, d: sampling.stratified(table(s, d, "documents").filter("block_kind is not null").select("block_kind", "doc_id"), "block_kind", "doc_id", 10),
    "index_percentiles": lambda s, d: stats.index_percentiles(table(s, d, "orders"), ["o_orderpriority"], "o_totalprice", {"p10": F.floor(F.col("n") / 10), "p50": F.floor(F.col("n") / 2)}),
    "label_confusion": lambda s, d: stats.confusion(kappa_pairs(s, d), "human", "judge", _CATS),
    "label_agreement": lambda s, d: kappa_pairs(s, d).groupBy(F.abs(F.col("judge") - F.col("human")).alias("distance")).agg(F.count("*").alias("n")),
    "kappa_grouping_sets": kappa_grouping_sets,
    "pairwise_kappa": pairwise_kappa,
    "rerun_agreement": lambda s, d: first_valid(s, d).groupBy("session_id", "block_index").agg(F.count("*").alias("k"), F.countDistinct("score").alias("u")).filter("k >= 2").agg(F.count("*").alias("n_compared"), F.count_if(F.col("u") == 1).alias("n_agree")),
    "final_attempts": lambda s, d: joins.final_attempts(table(s, d, "attempts"), ["pass_id", "session_id", "block_index"]),
    "latency_stats": latency,
    "answer_outcomes": answers,
    "bootstrap_kappa_ci": lambda s, d: stats.bootstrap_kappa(kappa_pairs(s, d), "judge", "human"),
    "rank_correlation": rank_correlation,
    "pearson_guarded": lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(stats.guarded_corr("l_quantity", "l_extendedprice"), 6).alias("r")),
    "coverage_left_join": unit_coverage,
    "reverse_gap_anti": lambda s, d: joins.reverse_gap(first_valid(s, d).select("session_id", "block_index").distinct(), table(s, d, "documents").select("session_id", "block_index"), ["session_id"], ["session_id", "block_index"]),
    "manifest_diff": lambda s, d: joins.manifest_diff(*manifest(s, d), "doc_id", "sha"),
    "sha_gate": lambda s, d: table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha")),
    "robust_z_stats": robust_z_stats,
    "unknown_types": lambda s, d: nested.records_table(table(s, d, "session_records")).filter(~F.col("record_type").isin(*EVENT_TYPES)).groupBy("record_type").agg(F.count("*").alias("n")),
    "tool_call_summary": tool_call_summary,
    "thinking_blocks": lambda s, d: session_blocks(s, d).filter("block_type = 'thinking' and session_id is not null").groupBy("session_id").agg(F.count("*").alias("n_blocks"), F.count_if("agent_sourced").alias("n_agent")),
    "shell_paths": lambda s, d: session_log.shell_commands(table(s, d, "session_records")).select(F.split_part("command", F.lit(" "), F.lit(1)).alias("program"), shell.shell_paths("command").alias("paths")).groupBy("program").agg(F.count("*").alias("n_commands"), F.sum(F.size("paths")).alias("n_paths")),
    "json_first_object": lambda s, d: table(s, d, "events").select("event_id", F.get_json_object(judge.first_json_object(F.concat(F.lit("{ props: "), "props", F.lit(" }"))), "$.k").cast("long").alias("k")),
    "source_measures": source_measures,
    "python_complexity": python_complexity,
    "excerpts": lambda s, d: text.excerpts(documents(s, d), "doc_id").select("doc_id", "cluster_index", "cluster_count", F.sha2("text", 256).alias("text_hash"), F.size("highlights").cast("long").alias("n_highlights")),
    "symbol_histogram": lambda s, d: joins.symbols(table(s, d, "part").select(F.col("p_name").alias("t")), "t"),
}

_KAPPA = "count(*) as n_pairs, avg((judge - human) * (judge - human)) as o, " + " + ".join(f"count(*) filter (judge = {i}) * count(*) filter (human = {j}) * {(i - j) ** 2}.0" for i in _CATS for j in _CATS if i != j) + " as e"

SQL: dict[str, str] = {
    "event_ordinal_segments": f"with {_EV} select event_id, user_id, event_index, segment_id from ev0",
    "reread_bursts": _burst_sql("view"),
    "edit_churn": _burst_sql("purchase"),
    "tool_coupling": f"with {_EV}, c as (select event_id, event_type, max(event_type in ('view', 'purchase', 'click')) over (partition by user_id, segment_id order by event_index range between 3 preceding and 3 following) as coupled from ev) select event_id, coupled from c where event_type = 'error'",
    "tier3_nearest": f"""with {_EV}, best as (
      select e.event_id, arg_min(r.path, (abs(r.event_index - e.event_index), r.event_index)) as path, min(abs(r.event_index - e.event_index)) as distance, arg_min(case when r.event_index < e.event_index then 'before' else 'after' end, (abs(r.event_index - e.event_index), r.event_index)) as direction
      from ev e join ev r on r.user_id = e.user_id and r.segment_id = e.segment_id and r.event_index between e.event_index - 3 and e.event_index + 3 and r.event_index <> e.event_index and r.event_type <> 'error'
      where e.event_type = 'error' group by 1)
      select e.event_id, b.path, b.distance, b.direction from ev e left join best b on b.event_id = e.event_id where e.event_type = 'error'""",
    **{n: f"with {_EV} select {_COLS} from ({q})" for n, q in _DETECT.items()},
    "bash_retry_pairs": f"""with {_EV} select e.event_id, min(r.event_index) as retry_index, arg_min(r.command, r.event_index) as retry_command from ev e join ev r on r.event_type = 'click' and r.user_id = e.user_id and r.segment_id = e.segment_id
      and split_part(r.command, ' ', 1) = split_part(e.command, ' ', 1) and not (starts_with(r.command, e.command) and length(r.command) > length(e.command)) and r.event_index between e.event_index + 1 and e.event_index + 3
      where e.event_type = 'click' and e.errored group by 1""",
    **{
        f"leakage_{n}": f"with {_EV}, u as (" + " union all ".join(f"select {k}, '{x}' as kind from ({q})" for x, q in _DETECT.items()) + f") select {k}, " + ", ".join(f"count(*) filter (kind = '{x}') as {x}" for x in _DETECT) + f", count(*) as total from u group by {k}"
        for n, k in (("rollup", "path"), ("by_session", "user_id"))
    },
    "tool_usage_by_file": f"with {_EV} select path, count(*) filter (event_type = 'click') as n_click, count(*) filter (event_type = 'purchase') as n_purchase, count(*) filter (event_type = 'view') as n_view from ev where event_type in ('view', 'purchase', 'click') group by 1",
    "sessions_by_file": f"with {_EV} select path, count(distinct user_id) as n_sessions from ev group by 1",
    "carry_forward_state": f"with {_EV}, c as (select event_id, event_type, last_value(case when event_type = 'purchase' then cast(k % 10 as varchar) end ignore nulls) over (partition by user_id order by event_index rows unbounded preceding) as open_path from ev0) select event_id, open_path from c where event_type = 'error'",
    "block_signals": f"with {_SIG} select doc_id, length_words, length_chars, marker_count, round(question_rate_per_100w, 6) as question_rate_per_100w, round(markers_per_100w, 6) as markers_per_100w from sig",
    "median_mad_by_source": f"with {_SIG} select source, coalesce(median(length_words), 0.0) as median, coalesce(mad(length_words), 0.0) as mad, count(length_words) as n, count(length_words) < 20 as low_confidence from sig group by 1",
    "presence_intensity": f"with {_SIG} select source, round(avg(case when markers_per_100w > 0 then 1.0 when markers_per_100w is not null then 0.0 end), 6) as presence_rate, round(coalesce(median(markers_per_100w) filter (markers_per_100w > 0), 0.0), 6) as intensity_median, count(markers_per_100w) as n, count(*) filter (markers_per_100w > 0) as n_positive, count(*) filter (markers_per_100w > 0) < 20 as low_confidence from sig group by 1",
    "file_score_topk": f"with {_SCORES} select path, tangle_count, round(markers, 6) as markers, round(resolution_rate, 6) as resolution_rate, reread_bursts, edit_churn, score from scored order by score desc, path limit 20",
    "corpus_mode": f"""with {_SCORES}, m as (select score, path, row_number() over (order by score desc, path) as rn, lead(score) over (order by score desc, path) as nxt, sum(score) over () as total from scored where score >= 0.1),
      x as (select (select count(*) from scored) as n_files, (select count(*) from m) as n_meaningful, (select min(rn) from m where rn <= 3 and score / nxt >= 2) as cliff,
        (select count(*) from (select rn, min(case when score / total >= 0.3 then 1 else 0 end) over (order by rn) as ok from m) where rn <= 3 and ok = 1) as dom)
      select case when n_meaningful = 0 then 'empty' when n_meaningful < 10 then 'calm' else 'healthy' end as mode, n_files, n_meaningful, case when n_meaningful >= 10 then coalesce(cliff, dom) else 0 end as n_standouts from x""",
    "topk_excerpts": f"with {_SIG} select source, doc_id, marker_count, rank from (select source, doc_id, marker_count, row_number() over (partition by source order by marker_count desc nulls last, doc_id) as rank from sig) where rank <= 5",
    "path_tokens": f"with {_SCAN} select path, count(*) as n_documents from scan group by 1",
    "marker_clusters": f"with {_CLUSTERS} select doc_id, count(*) as n_markers, cast(max(cluster_index) as bigint) as last_cluster from clustered group by 1",
    "excerpts": f"with {_EXCERPTS} select doc_id, cluster_index, cluster_count, sha256(excerpt) as text_hash, n_highlights from excerpt",
    "home_redaction": r"select doc_id, sha256(regexp_replace('/home/someone/' || text, '/(?:Users|home)/[^/\s]+', '~', 'g')) as hash from documents",
    "model_distribution": "select coalesce(model, 'unknown') as model, count(*) as n_events, count(distinct session_id) as n_sessions from chat_messages group by 1",
    "anchored_units": f"""with {_UNIT} select f.session_id, unit, count(*) as n_fragments, sha256(string_agg(msg_text, chr(10) || chr(10) order by row_id)) as text_hash, case when unit >= max(n_steps) then 'terminal' else 'free-standing' end as emission_kind from frag f join steps using (session_id) group by 1, 2""",
    "fragment_offsets": f"""with {_UNIT}, o as (select session_id, unit, row_number() over w - 1 as nth, cast(coalesce(sum(length(msg_text) + 2) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) as "start", length(msg_text) as n, msg_text from frag window w as (partition by session_id, unit order by row_id))
      select session_id, unit, nth, "start", "start" + n as "end", sha256(msg_text) as text_hash from o""",
    "alternation_census": f"with {_MSG}, a as (select session_id, row_id, {_ACT} as act, lag({_ACT}) over (partition by session_id order by row_id) as before from msg) select session_id, count(*) as n_events, count(*) filter (not act and not coalesce(before, true)) as n_consecutive, count(*) filter (act and coalesce(before, true)) as n_unpreceded, cast(not arg_max(act, row_id) as integer) as trailing from a group by 1",
    "systematic_sample": "with r as (select doc_id, row_number() over (order by doc_id) - 1 as i, count(*) over () as n from documents) select doc_id from r where i % cast(ceil(n / 50.0) as bigint) = 0",
    "stratified_sample": "select block_kind, doc_id, rank from (select block_kind, doc_id, row_number() over (partition by block_kind order by md5('18:' || doc_id), doc_id) as rank from documents where block_kind is not null) where rank <= 10",
    "nearest_rank_quantiles": f"with {_SIG}, l as (select source, list_sort(list(length_words) filter (length_words is not null)) as x, count(length_words) as n from sig group by 1) select source, n, " + ", ".join(f"x[cast(round_even({p} * (n - 1), 0) as integer) + 1] as q{int(p * 100)}" for p in (0.1, 0.5, 0.9)) + " from l where n > 0",
    "index_percentiles": "with l as (select o_orderpriority, list_sort(list(o_totalprice)) as x, count(*) as n from orders group by 1) select o_orderpriority, n, x[n // 10 + 1] as p10, x[n // 2 + 1] as p50 from l",
    "label_confusion": f"with {_PAIRS} select human, " + ", ".join(f"count(*) filter (judge = {c}) as c_{c}" for c in _CATS) + " from pairs group by 1",
    "label_agreement": f"with {_PAIRS} select abs(judge - human) as distance, count(*) as n from pairs group by 1",
    "kappa_grouping_sets": f"with {_PAIRS}, k as (select case when grouping(rater_id) = 1 then 'all' else rater_id end as rater_id, {_KAPPA} from pairs group by grouping sets ((), (rater_id))) select rater_id, n_pairs, round(o, 6) as observed, round(e / (n_pairs * n_pairs), 6) as expected, case when e > 0 then round(1 - o / (e / (n_pairs * n_pairs)), 6) end as kappa from k where n_pairs > 0",
    "pairwise_kappa": f"with {_FIRST}, p as (select a.pass_id as pass_a, b.pass_id as pass_b, a.score as judge, b.score as human from fv a join fv b on a.session_id = b.session_id and a.block_index = b.block_index and a.pass_id < b.pass_id), k as (select pass_a, pass_b, {_KAPPA} from p group by 1, 2) select pass_a, pass_b, n_pairs, case when e > 0 then round(1 - o / (e / (n_pairs * n_pairs)), 6) end as kappa from k",
    "rerun_agreement": f"with {_FIRST}, g as (select count(*) as k, count(distinct score) as u from fv group by session_id, block_index) select count(*) as n_compared, count(*) filter (u = 1) as n_agree from g where k >= 2",
    "final_attempts": "select pass_id, session_id, block_index, count(distinct attempt) as n_attempts, coalesce(arg_min(attempt, (attempt, ledger_id)) filter (valid), arg_max(attempt, (attempt, ledger_id))) as attempt, arg_min(score, (attempt, ledger_id)) filter (valid) as score, coalesce(bool_or(valid), false) or count(distinct attempt) >= 2 as complete from attempts group by 1, 2, 3",
    "latency_stats": "select pass_id, min(latency_s) as low, median(latency_s) as middle, max(latency_s) as high, count(*) as n, cast(sum(infra_retries) as bigint) as retries from attempts group by 1",
    "rank_correlation": """with l as (select l_orderkey, sum(l_quantity) as qty from lineitem group by 1), o as (select o_orderpriority as g, o_totalprice as a, qty as b from orders join l on o_orderkey = l_orderkey),
      r as (select g, rank() over (partition by g order by a) + (count(*) over (partition by g, a) - 1) / 2.0 as ra, rank() over (partition by g order by b) + (count(*) over (partition by g, b) - 1) / 2.0 as rb from o)
      select g as o_orderpriority, round(corr(ra, rb), 6) as rho, count(*) as n from r group by 1""",
    "pearson_guarded": "select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem group by 1",
    "coverage_left_join": f"with {_FIRST}, u as (select distinct session_id, block_index from fv) select block_kind, count(*) as n_rows, count(u.session_id) as n_joined, round(count(u.session_id) / count(*), 6) as coverage from documents d left join u on d.session_id = u.session_id and d.block_index = u.block_index where block_kind is not null group by 1",
    "reverse_gap_anti": f"with {_FIRST} select distinct session_id, block_index from fv where session_id in (select session_id from documents where session_id is not null) and not exists (select 1 from documents d where d.session_id = fv.session_id and d.block_index = fv.block_index)",
    "manifest_diff": "with e as (select doc_id, sha256(coalesce(text, '')) as sha from documents), f as (select doc_id, case when doc_id % 11 = 0 then sha256(sha) else sha end as sha from e where doc_id % 7 <> 0 union all select -doc_id - 1, sha from e where doc_id % 13 = 0) select coalesce(e.doc_id, f.doc_id) as doc_id, case when f.doc_id is null then 'missing' when e.doc_id is null then 'extra' else 'changed' end as status from e full outer join f on e.doc_id = f.doc_id where f.doc_id is null or e.doc_id is null or e.sha <> f.sha",
    "sha_gate": "select doc_id, sha256(text) as sha from documents",
    "robust_z_stats": "select stat_id, case when coalesce(case when not isnan(mad) then mad end, 0.0) <= 0 then 0.0 else (1.0 - coalesce(case when not isnan(median) then median end, 0.0)) / (1.4826 * mad) end as z from baseline_stats",
    "unknown_types": "select payload->>'$.type' as record_type, count(*) as n from session_records where payload->>'$.type' not in (" + ", ".join(f"'{t}'" for t in EVENT_TYPES) + ") group by 1",
    "json_first_object": "select event_id, cast(props->>'$.k' as bigint) as k from events",
    "attribution_tiers": f"""with {_SCAN}, docs as (select * from documents where session_id is not null),
      paths as (select distinct session_id, path, regexp_extract(path, '[^/]*$') as base, regexp_extract(path, '[^/]*/[^/]*$') as tail from docs join scan using (doc_id) where block_kind = 'tool_result'),
      blocks as (select doc_id, session_id, text from docs where block_kind = 'thinking'),
      t1 as (select doc_id, count(distinct path) as n from blocks b join paths p on b.session_id = p.session_id and p.tail <> '' and contains(b.text, p.tail)
        where regexp_matches(b.text, '(^|[^\\p{{L}}\\p{{N}}_-])' || regexp_escape(p.tail) || '($|[^\\p{{L}}\\p{{N}}_-])') group by 1),
      u as (select session_id, base, max(path) as path from paths group by 1, 2 having count(*) = 1),
      names as (select distinct doc_id, session_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_.-]*[.]{_END}\\b')) as base from blocks),
      t2 as (select doc_id, count(distinct path) as n from names w join u on w.session_id = u.session_id and w.base = u.base group by 1)
      select b.session_id, b.doc_id as block_id, case when t1.n is not null then 'exact_path' else 'unique_basename' end as tier, coalesce(t1.n, t2.n) as n_paths from blocks b left join t1 using (doc_id) left join t2 using (doc_id) where coalesce(t1.n, t2.n) is not null""",
    "user_ignore": f"""with {_SCAN} select distinct path from scan
      where case when regexp_matches(path, '^src/[^/]*[.]py(/|$)') then true when regexp_matches(path, '^tests/(.+/)?[^/]*[.]md(/|$)') then false when regexp_matches(path, '(^|/)tests/') then true else regexp_matches(path, '[.]md(/|$)') end""",
    "noise_in_top": f"""with {_SCORES}, top as (select path, string_split(path, '/') as parts from scored order by score desc, path limit 20)
      select count(*) filter (regexp_matches(path, '([.]lock|[.]min[.]js|[.]min[.]css|[.]snap|[.]map|(^|/)package-lock[.]json|(^|/)pnpm-lock[.]yaml)/*$') or list_has_any(parts, ['vendor', 'dist', 'generated'])) as n_noise,
        count(*) filter (list_has_any(parts[1:-2], ['.git', '__pycache__', 'node_modules', '.venv', 'venv', 'dist', 'build', '.next', '.cache', '.claude']) or regexp_matches(parts[-1], '[.]pyc$|^[.]env$|^[.]env[.]|^[.]DS_Store$')) as n_ignored, count(*) as n from top""",
    "source_measures": f"""with f as (select ['py', 'js', 'go', 'sql'][doc_id % 4 + 1] as ext, text from documents where text is not null),
      l as (select ext, text, string_split_regex(text, '{_LINE_END}') as lines from f), k as (select ext, text, case when lines[-1] = '' then lines[1:-2] else lines end as lines from l),
      m as (select ext, len(lines) as loc, len(list_filter(lines, lambda x: regexp_matches(x, '[^{_SPACE}]') and not (ext = 'py' and regexp_matches(x, '^[{_SPACE}]*#')) and not (ext in ('js', 'go') and regexp_matches(x, '^[{_SPACE}]*//')))) as code_lines,
        case ext when 'py' then len(regexp_extract_all(text, '{_sql_pattern(complexity.FUNCTIONS, "py")}')) when 'js' then len(regexp_extract_all(text, '{_sql_pattern(complexity.FUNCTIONS, "js")}')) when 'go' then len(regexp_extract_all(text, '{_sql_pattern(complexity.FUNCTIONS, "go")}')) else 0 end as n_functions,
        case ext when 'py' then len(regexp_extract_all(text, '{_sql_pattern(complexity.CLASSES, "py")}')) when 'js' then len(regexp_extract_all(text, '{_sql_pattern(complexity.CLASSES, "js")}')) when 'go' then len(regexp_extract_all(text, '{_sql_pattern(complexity.CLASSES, "go")}')) else 0 end as n_classes from k)
      select 'src/d.' || ext as path, cast(sum(loc) as bigint) as loc, cast(sum(code_lines) as bigint) as code_lines, cast(sum(n_functions) as bigint) as n_functions, cast(sum(n_classes) as bigint) as n_classes from m group by 1""",
    "session_age": r"""with a as (select 1780000000.0 - mtime as age, regexp_replace(trim(split_part(regexp_replace(title, '^\s+', ''), chr(10), 1)), '^# +', '') as line from active_sessions),
      b as (select age, case when length(line) > 60 then 60 else length(line) end as n, cast(floor(age / case when age < 3600 then 60 else 3600 end) as bigint) as k from a)
      select case when age < 60 then 'just now' else k || case when age < 3600 then ' minute' else ' hour' end || case when k = 1 then '' else 's' end || ' ago' end as age, count(*) as n, max(n) as longest from b group by 1""",
    "symbol_histogram": "select symbol, count(*) as n from (select unnest(string_split(p_name, ' ')) as symbol from part) where symbol <> '' group by 1",
}
SQL["last_first_title"] = "select session_id, arg_min(title, (mtime, title)) filter (title is not null) as first_value, arg_max(title, (mtime, title)) filter (title is not null) as last_value from active_sessions group by 1"
_CALLS = f"""
with recursive {_NESTED}, placed as (
  select payload->>'$.sessionId' as sid, b->>'$.type' as kind, case when json_type(b->'$.id') = 'VARCHAR' then b->>'$.id' when json_type(b->'$.tool_use_id') = 'VARCHAR' then b->>'$.tool_use_id' end as tid, case when json_type(b->'$.name') = 'VARCHAR' then b->>'$.name' end as tool_name,
    row(coalesce(payload->>'$.timestamp', ''), record_id, block_path) as pos
  from items join session_records using (record_id) where json_type(b) = 'OBJECT' and json_type(b->'$.type') = 'VARCHAR' and payload->>'$.sessionId' is not null
), u as (select *, lead(pos) over (partition by sid, tid order by pos) as following from placed where kind = 'tool_use' and tid is not null),
r as (select sid, tid, pos from placed where kind = 'tool_result')"""
SQL["tool_call_summary"] = f"""{_CALLS}, c as (select tool_name, exists (select 1 from r where r.sid = u.sid and r.tid = u.tid and r.pos > u.pos and (u.following is null or r.pos < u.following)) as hit from u)
  select tool_name, count(*) as n_calls, count(*) filter (hit) as n_results from c group by 1"""
SQL["thinking_blocks"] = f"""with recursive {_NESTED} select payload->>'$.sessionId' as session_id, count(*) as n_blocks, count(*) filter (payload->>'$.type' = 'progress') as n_agent
  from blocks join session_records using (record_id) where block_type = 'thinking' and payload->>'$.sessionId' is not null group by 1"""
