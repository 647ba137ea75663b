"""Queries of judge runs, censuses and display over the test tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import display
from tracemill.operators import census, judging
from tracemill.plans import reference as R
from tracemill.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def pass1(s: SparkSession, d: str) -> DataFrame:
    """The reference pass, each unit once."""
    return table(s, d, "pass1_scores").filter("score between 0 and 3").groupBy("session_id", "block_index").agg(F.min("score").alias("score"))


def first_valid(s: SparkSession, d: str) -> DataFrame:
    return judging.pass_scores(table(s, d, "attempts"))


def marked_documents(s: SparkSession, d: str) -> DataFrame:
    """Thinking blocks of the documents with whether they hold a marker."""
    sig = R.signals(s, d).filter("block_kind = 'thinking'")
    return sig.select("doc_id", "source", "session_id", "block_index", (F.col("marker_count") > 0).alias("marked"))


def session_density(s: SparkSession, d: str) -> DataFrame:
    m = marked_documents(s, d).filter("session_id is not null")
    return m.groupBy("session_id").agg(F.round(F.avg(F.col("marked").cast("double")), 6).alias("density"))


def unit_paths(s: SparkSession, d: str) -> DataFrame:
    return R.documents(s, d).select("session_id", "block_index", F.explode(F.array_distinct(R.text.path_scan(F.col("text")))).alias("path"))


QUERIES: dict[str, Query] = {
    "pass_scores": first_valid,
    "pass_metrics": lambda s, d: rounded(judging.pass_metrics(table(s, d, "attempts"), pass1(s, d))),
    "score_histogram": lambda s, d: judging.score_histogram(first_valid(s, d), "pass_id"),
    "scores_by_file": lambda s, d: rounded(judging.scores_by_file(pass1(s, d), unit_paths(s, d))),
    "bootstrap_mad_difference": lambda s, d: judging.bootstrap_difference(table(s, d, "relabel_scores").filter("abs_diff is not null").withColumn("side", F.when(F.col("block_index") % 2 == 0, "even").otherwise("odd")), "side", "abs_diff", "even", "odd"),
    "kappa_bands": lambda s, d: R.kappa_grouping_sets(s, d).select("rater_id", judging.band(F.col("kappa")).alias("band")),
    "session_density": session_density,
    "hot_calm_sessions": lambda s, d: judging.hot_calm(session_density(s, d), "session_id", "density", 5, 5),
    "fragment_multiplicity": lambda s, d: census.fragment_multiplicity(R.anchored(s, d)),
    "unit_presence": lambda s, d: rounded(census.presence(R.anchored(s, d), R.messages(s, d), "session_id")),
    "unit_rates": lambda s, d: rounded(census.unit_rates(R.anchored(s, d)).filter("total = 1").select("n_units", "n_terminal", "n_free", "terminal_rate", "free_rate")),
    "text_duplicates": lambda s, d: census.duplicates(table(s, d, "documents"), "block_kind", "text"),
    "unit_census": lambda s, d: census.census(table(s, d, "documents").select(F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("block_kind", F.lit("none")).alias("block_kind")), "source", "block_kind"),
    "fence_census": lambda s, d: census.fence_census(R.documents(s, d), "text"),
    "payload_key_sets": lambda s, d: census.key_sets(table(s, d, "attribution_exports"), "payload"),
    "ledger_column_differences": lambda s, d: census.column_differences(*(first_valid(s, d).filter(F.col("pass_id") == p).drop("pass_id") for p in passes(s, d)), ["session_id", "block_index"], ["score", "sheet_position"]),
    "display_paths": lambda s, d: R.path_tokens(s, d).select("path", display.display_path(F.col("path"), F.lit("/srv/app")).alias("shown")),
    "session_lookup": lambda s, d: display.match_session(table(s, d, "active_sessions").select("session_id", "title").distinct(), "fix"),
}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def passes(s: SparkSession, d: str) -> list[str]:
    """The two first passes by name."""
    return [r[0] for r in table(s, d, "attempts").select("pass_id").filter("pass_id is not null").distinct().orderBy("pass_id").limit(2).collect()]


_FINAL = """
final as (
  select pass_id, session_id, block_index, min(sheet_position) as sheet_position, arg_min(score, (attempt, ledger_id)) filter (valid) as score0, coalesce(bool_or(valid), false) or count(distinct attempt) >= 2 as complete
  from attempts group by 1, 2, 3
), scored as (select pass_id, session_id, block_index, sheet_position, case when score0 between 0 and 3 then score0 end as score from final where complete)"""
_PASS1 = "p1 as (select session_id, block_index, min(score) as ref from pass1_scores where score between 0 and 3 group by 1, 2)"
_DENSITY = f"with {R._SIG}, dens as (select session_id, round(avg(case when marker_count > 0 then 1.0 when marker_count is not null then 0.0 end), 6) as density from sig where block_kind = 'thinking' and session_id is not null group by 1)"
_K = "count(*) as n, avg((score - ref) * (score - ref)) as o, " + " + ".join(f"count(*) filter (score = {i}) * count(*) filter (ref = {j}) * {(i - j) ** 2}.0" for i in range(4) for j in range(4) if i != j) + " as e"

SQL: dict[str, str] = {
    "pass_scores": f"with {_FINAL} select * from scored",
    "pass_metrics": f"""with {_FINAL}, {_PASS1}, u as (select pass_id, count(distinct (session_id, block_index)) as n_units from attempts group by 1), c as (select pass_id, count(*) as n_complete, count(score) as n_scored, avg(score) as mean_score from scored group by 1),
      j as (select scored.pass_id, score, ref from scored join p1 using (session_id, block_index) where score is not null), k as (select pass_id, {_K}, avg(case when score = ref then 1.0 else 0.0 end) as exact, avg(abs(score - ref)) as mean_difference from j group by 1),
      f as (select *, case when e > 0 then round(1 - o / (e / (n * n)), 6) end as kappa from k)
      select u.pass_id, n_units, coalesce(n_complete, 0) as n_complete, coalesce(n_scored, 0) as n_scored, round(mean_score, 6) as mean_score, round(exact, 6) as exact, round(mean_difference, 6) as mean_difference, coalesce(n, 0) as n_pairs, kappa,
        case when kappa >= 0.6 then 'substantial' when kappa >= 0.4 then 'moderate' when kappa is not null then 'low' end as band from u left join c on u.pass_id is not distinct from c.pass_id left join f on u.pass_id = f.pass_id where u.pass_id is not null""",
    "score_histogram": f"with {_FINAL} select pass_id, " + ", ".join(f"count(*) filter (score = {c}) as n_{c}" for c in range(4)) + ", count(score) as n from scored group by 1",
    "scores_by_file": f"with {_PASS1}, {R._SCAN}, u as (select distinct session_id, block_index, path from scan join documents using (doc_id)) select path, count(*) as n_units, round(avg(ref), 6) as mean_score from p1 join u using (session_id, block_index) group by 1",
    "kappa_bands": f"select rater_id, case when kappa >= 0.6 then 'substantial' when kappa >= 0.4 then 'moderate' when kappa is not null then 'low' end as band from ({R.SQL['kappa_grouping_sets']})",
    "session_density": f"{_DENSITY} select session_id, density from dens",
    "hot_calm_sessions": f"""{_DENSITY}, hot as (select session_id, density, row_number() over (order by density desc, session_id) as rank from dens where density is not null qualify rank <= 5),
      calm as (select session_id, density, row_number() over (order by density, session_id) as rank from dens where density is not null and session_id not in (select session_id from hot) qualify rank <= 5)
      select session_id, density, 'hot' as kind, rank from hot union all select session_id, density, 'calm', rank from calm""",
    "fragment_multiplicity": f"with {R._UNIT}, u as (select session_id, unit, count(*) as n_fragments from frag group by 1, 2) select n_fragments, count(*) as n_units from u group by 1",
    "unit_presence": f"with {R._UNIT}, u as (select session_id, unit from frag group by 1, 2) select (select count(distinct session_id) from msg) as n_trajectories, count(distinct session_id) as n_with_units, count(*) as n_units, round(count(distinct session_id) / (select count(distinct session_id) from msg), 6) as share, round(count(*) / count(distinct session_id), 6) as units_each from u",
    "unit_rates": f"with {R._UNIT}, u as (select session_id, unit, unit >= max(n_steps) as terminal from frag join steps using (session_id) group by 1, 2) select count(*) as n_units, count(*) filter (terminal) as n_terminal, count(*) filter (not terminal) as n_free, round(count(*) filter (terminal) / count(*), 6) as terminal_rate, round(count(*) filter (not terminal) / count(*), 6) as free_rate from u",
    "text_duplicates": "with n as (select block_kind, sha256(text) as text_hash, count(*) as n from documents where text is not null group by 1, 2 having count(*) >= 2) select *, row_number() over (partition by block_kind order by n desc, text_hash) as rank from n qualify rank <= 5",
    "unit_census": "select case when grouping(s) = 1 then 'TOTAL' else s end as source, case when grouping(k) = 1 then 'TOTAL' else k end as block_kind, count(*) as n from (select coalesce(source, 'none') as s, coalesce(block_kind, 'none') as k from documents) group by rollup (s, k)",
    "fence_census": "with c as (select text, len(regexp_extract_all(text, '(?m)^```')) as f, len(regexp_extract_all(text, '<think>')) as a, len(regexp_extract_all(text, '</think>')) as b from documents) select count(text) as n_texts, count(*) filter (f > 0) as n_fenced, count(*) filter (f % 2 = 1) as n_unpaired, cast(coalesce(sum(a), 0) as bigint) as n_opened, cast(coalesce(sum(b), 0) as bigint) as n_closed, count(*) filter (a <> b) as n_unbalanced from c",
    "display_paths": f"with {R._SCAN}, p as (select distinct path from scan) select path, case when path = '/srv/app' then '' when starts_with(path, '/srv/app/') then path[10:] else regexp_replace(path, '/(?:Users|home)/[^/\\s]+', '~', 'g') end as shown from p",
    "session_lookup": "select distinct session_id, title, 'title' as matched_by from active_sessions where contains(lower(title), 'fix')",
}
