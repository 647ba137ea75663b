"""The scan of session logs: events and blocks, tool calls with their paths, attribution, excerpts, behaviour counts, baselines and file scores.

A session is a file of records. Everything is windows over (session, segment), a segment being what lies between two compaction boundaries, and
joins on sessions, tool calls and paths; no session is collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text as T
from tracemill.functions.complexity import LINE_END, canonical_path
from tracemill.operators import attribution, behaviour, joins, scoring, stats, windows
from tracemill.operators.schema import EVENT_TYPES
from tracemill.runtime import checkpointed

KEYS = ["session", "segment_id"]
#: Tools whose uses are counted, and those that name their file outright (fixed values).
TOOLS = ("Read", "Edit", "Write", "Bash", "Grep", "Glob")
NAMES_FILE, SEARCHES = ("Read", "Edit", "Write"), ("Grep", "Glob")
#: Markers of a failed edit in the first characters of its result, and of a failed command anywhere (fixed values).
EDIT_ERRORS, EDIT_ERROR_CHARS = ("string not found", "does not match", "no match", "error"), 100
SHELL_ERRORS = ("error", "traceback", "failed", "command not found", "syntax error", "permission denied")
#: Folders of the system, whose paths in commands are no files of the project (fixed values).
SYSTEM_PREFIXES = ("/usr/", "/bin/", "/sbin/", "/etc/", "/var/", "/tmp/", "/sys/", "/proc/", "/dev/", "/private/var/", "/private/tmp/", "/private/etc/")
BLOCK_TYPES = ("text", "thinking", "tool_use", "tool_result")
#: A session has baselines of its own from so many thinking blocks.
SESSION_BLOCKS = 20
REACH, BURST_REACH = 3, 5


def _string(v: Column, path: str) -> Column:
    """A member that is a JSON string, else null."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def result_texts(content: Column) -> Column:
    """The texts of a tool result: a string, or of an array the strings and the ``text`` of objects."""
    items = F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda y: F.coalesce(_string(y, "$.text"), _string(y, "$")))
    return F.coalesce(F.filter(items, lambda s: s.isNotNull()), F.when(_string(content, "$").isNotNull(), F.array(_string(content, "$"))))


def _block(x: Column, pos: Column) -> Column:
    of = lambda name, path: _string(x, path).alias(name)
    content = F.try_variant_get(x, "$.content", "variant")
    return F.struct(
        pos.alias("pos"), of("kind", "$.type"), of("text", "$.text"), of("thinking", "$.thinking"), of("tool_name", "$.name"), F.coalesce(F.when(_string(x, "$.type") == "tool_use", _string(x, "$.id")), _string(x, "$.tool_use_id")).alias("tool_use_id"),
        of("file_path", "$.input.file_path"), of("scope", "$.input.path"), of("pattern", "$.input.pattern"), of("command", "$.input.command"), of("description", "$.input.description"), result_texts(content).alias("result"),
    )


def events(records: DataFrame, session: str = "file_name") -> DataFrame:
    """One row an event of a known type: session, record_id, segment_id, event_index, type, subtype, session_id, cwd, model, assistant_like,
    agent_sourced, blocks.

    Payloads that are no JSON object or of an unknown type are no events. The events of a session go by timestamp, then record_id.
    A content that is no array, or a message that is no object, has no blocks; items of other types than the four are left out.
    A turn of a sub-agent, inside of a progress record, counts as that record's. Missing members are null.
    """
    e = records.select(F.col(session).alias("session"), "record_id", F.try_parse_json("payload").alias("v")).withColumn("type", _string(F.col("v"), "$.type")).filter(F.col("type").isin(*EVENT_TYPES))
    agent = (F.col("type") == "progress") & F.coalesce(_string(F.col("v"), "$.data.type") == "agent_progress", F.lit(False))
    turn = F.col("type").isin("assistant", "user")
    items = F.when(turn, F.try_variant_get("v", "$.message.content", "array<variant>")).when(agent, F.try_variant_get("v", "$.data.message.message.content", "array<variant>"))
    nested = agent & F.coalesce(_string(F.col("v"), "$.data.message.type") == "assistant", F.lit(False))
    model = F.when(F.col("type") == "assistant", _string(F.col("v"), "$.message.model")).when(nested, _string(F.col("v"), "$.data.message.message.model"))
    blocks = F.filter(F.transform(items, lambda x, i: _block(x, i)), lambda b: b["kind"].isin(*BLOCK_TYPES))
    of = lambda name, path: _string(F.col("v"), path).alias(name)
    e = e.select(
        "session", "record_id", "type", of("subtype", "$.subtype"), of("session_id", "$.sessionId"), of("cwd", "$.cwd"), of("event_time", "$.timestamp"), model.alias("model"), ((F.col("type") == "assistant") | nested).alias("assistant_like"),
        agent.alias("agent_sourced"), F.coalesce(blocks, F.array().cast("array<struct<pos:int,kind:string,text:string,thinking:string,tool_name:string,tool_use_id:string,file_path:string,scope:string,pattern:string,command:string,description:string,result:array<string>>>")).alias("blocks"),
    ).withColumn("event_time", F.col("event_time").try_cast("timestamp"))
    boundary = (F.col("type") == "system") & F.coalesce(F.col("subtype") == "compact_boundary", F.lit(False))
    return windows.ordinals(e, "session", "event_time", "record_id", boundary)


def result_paths(texts: Column) -> Column:
    """Paths in the lines of a search's result: before ':12:' or '-12-', else those of the whole scan, else a line that is one."""
    lines = F.transform(F.flatten(F.transform(texts, lambda t: F.split(t, LINE_END))), lambda x: F.regexp_replace(x, r"(?U)\A[\s\x{1C}-\x{1F}]+|[\s\x{1C}-\x{1F}]+\z", ""))

    def of(line: Column) -> Column:
        hit, found = F.regexp_extract(line, r"(?U)\A([^\s:]\S*?)[-:]\d+[-:]", 1), T.path_scan(line)
        bare = F.when(line.contains("/") & ~line.contains(" "), F.array(line)).otherwise(F.array().cast("array<string>"))
        return F.when(hit != "", F.array(hit)).when(F.size(found) > 0, found).otherwise(bare)

    return F.coalesce(F.flatten(F.transform(F.filter(lines, lambda x: (x != "") & (x != "--")), of)), F.array().cast("array<string>"))


def command_paths(*texts: Column) -> Column:
    """Paths of the whole scan in commands and their descriptions, but for the system's and numbers."""
    found = F.flatten(F.array(*(T.path_scan(F.coalesce(t, F.lit(""))) for t in texts)))
    outside = lambda p: ~reduce(lambda a, b: a | b, (p.startswith(x) for x in SYSTEM_PREFIXES))
    last = lambda p: F.try_element_at(F.filter(F.split(p, "/"), lambda s: s != ""), F.lit(-1))
    return F.filter(found, lambda p: outside(p) & F.coalesce(last(p).rlike(r"\p{L}"), F.lit(True)))


def used_paths(tool: Column, file_path: Column, scope: Column, command: Column, description: Column, result: Column) -> Column:
    """Raw paths of a tool use, by tool: the file it names; the folder searched and what was found; those in a command. Others have none."""
    none = F.array().cast("array<string>")
    one = lambda c: F.when(c != "", F.array(c)).otherwise(none)
    found = F.when(tool.isin(*NAMES_FILE), one(file_path)).when(tool.isin(*SEARCHES), F.concat(one(scope), result_paths(result))).when(tool == "Bash", command_paths(command, description))
    return F.filter(F.array_distinct(F.coalesce(found, none)), lambda p: p != "")


def tool_uses(ev: DataFrame) -> DataFrame:
    """One row a tool use with its last result and its canonical paths, each path once: the searches' come from their results.

    A result belongs to the latest use of its id before it in the session; uses without id or result stay, with null ``result``.
    """
    b = ev.select("session", "segment_id", "event_index", "cwd", "session_id", F.explode("blocks").alias("b")).select("*", "b.*").drop("b")
    at = F.struct("event_index", "pos")
    calls = joins.tool_calls(b.select("session", at.alias("position"), F.col("kind").alias("block_type"), "tool_name", "tool_use_id", F.col("result").alias("block_text")), session="session")
    calls = calls.select("session", "tool_use_id", F.col("use_at.event_index").alias("event_index"), F.col("use_at.pos").alias("pos"), F.col("result_text").alias("outcome"), F.col("result_at.event_index").alias("result_index"))
    u = b.filter("kind = 'tool_use'").drop("result", "kind", "text", "thinking").join(calls, ["session", "tool_use_id", "event_index", "pos"], "left").withColumnRenamed("outcome", "result")
    raw = used_paths(*map(F.col, ("tool_name", "file_path", "scope", "command", "description", "result")))
    return u.withColumn("paths", F.array_distinct(F.transform(raw, lambda p: canonical_path(p, F.col("cwd")))))


def _said(result: Column) -> Column:
    return F.lower(F.array_join(result, "\n"))


def leakage(uses: DataFrame) -> DataFrame:
    """(session, path, kind): a row for each time a file is hit by one of the four behaviours, within a segment and ``REACH`` events."""
    said, none = F.coalesce(_said(F.col("result")), F.lit("")), F.lit(False)
    has = lambda where, markers: reduce(lambda a, b: a | b, (where.contains(m) for m in markers), none)
    u = uses.select("session", "segment_id", "event_index", "pos", "tool_name", "tool_use_id", "scope", "pattern", "command", "paths", has(F.substring(said, 1, EDIT_ERROR_CHARS), EDIT_ERRORS).alias("edit_error"), has(said, SHELL_ERRORS).alias("errored"))
    touched = u.filter(F.col("tool_name").isin("Edit", "Read")).withColumn("path", F.explode("paths"))
    edit, read = F.col("tool_name") == "Edit", F.col("tool_name") == "Read"
    greps = behaviour.grep_reformulations(u.filter("tool_name = 'Grep'"), KEYS).withColumn("path", F.explode("paths"))
    bash = behaviour.bash_retries(u.filter((F.col("tool_name") == "Bash") & F.col("command").rlike(r"(?U)\S")), KEYS, carry="paths")
    bash = bash.withColumn("path", F.explode(F.array_distinct(F.concat("paths", "retry_paths"))))
    kinds = {
        "edit_failures": behaviour.edit_failures(touched, KEYS, edit & F.col("tool_use_id").isNotNull(), read, F.col("edit_error")),
        "grep_reformulations": greps, "bash_retries": bash, "read_after_edit": behaviour.read_after_edit(touched, KEYS, edit, read),
    }
    return reduce(DataFrame.unionByName, (d.select("session", "path", F.lit(k).alias("kind")) for k, d in kinds.items()))


LEAKS = ("edit_failures", "grep_reformulations", "bash_retries", "read_after_edit")


def tool_usage(uses: DataFrame) -> DataFrame:
    """Uses of each of the six tools per path, a path once a use."""
    u = uses.filter(F.col("tool_name").isin(*TOOLS)).select(F.explode("paths").alias("path"), "tool_name")
    return u.groupBy("path").agg(*(F.count_if(F.col("tool_name") == t).alias(t.lower()) for t in TOOLS))


def burst_counts(uses: DataFrame, tool: str, reach: int = BURST_REACH) -> DataFrame:
    """(session, path, n): uses of a tool on a path with another one within ``reach`` events."""
    u = uses.filter(F.col("tool_name") == tool).select(*KEYS, "event_index", "pos", F.explode("paths").alias("path"))
    return windows.bursts(u, [*KEYS, "path"], reach).filter("burst").groupBy("session", "path").agg(F.count("*").alias("n"))


def thinking_blocks(ev: DataFrame, uses: DataFrame) -> DataFrame:
    """One row a thinking block with text: its place, signals, clusters, coupling, and the files it is attributed to.

    block_index counts a session's thinking blocks from 0. Tier 3 takes the first tool use with paths of the nearest other event.
    """
    e = ev.select("session", "segment_id", "event_index", "session_id", "agent_sourced", "type", "blocks").withColumn("uses_tool", F.exists("blocks", lambda b: b["kind"] == "tool_use"))
    e = windows.coupling(e, KEYS, F.col("uses_tool"), REACH).withColumnRenamed("coupled", "tool_use_coupling")
    b = e.withColumn("b", F.explode(F.filter("blocks", lambda b: (b["kind"] == "thinking") & (b["thinking"] != "")))).select("session", "segment_id", "event_index", "session_id", "agent_sourced", "type", "tool_use_coupling", F.col("b.pos").alias("pos"), F.col("b.thinking").alias("text"))
    b = windows.running(b.withColumn("block_id", F.concat_ws("\t", "session", "event_index", "pos")), ["session"], ["event_index", "pos"], position="block_index")
    b = checkpointed(T.signals(b))
    first = uses.filter("size(paths) > 0").groupBy("session", "event_index").agg(F.min_by("paths", "pos").alias("paths"))
    near = windows.nearest_path(ev.select(*KEYS, "event_index").join(first, ["session", "event_index"], "left"), KEYS, F.col("paths"), REACH)
    near = b.select("session", "event_index", "block_id").join(near.filter("nearest_path is not null").select("session", "event_index", F.col("nearest_path").alias("nearest_paths"), "nearest_distance", "nearest_direction"), ["session", "event_index"])
    named = uses.select("session", F.explode("paths").alias("path"))
    a = attribution.attribute(b, named, session="session", block="block_id", proximity=near.select("block_id", "nearest_paths")).drop("session")
    n = T.clusters(T.marker_positions(b, "block_id"), "block_id").groupBy("block_id").agg((F.max("cluster_index") + 1).alias("cluster_count"))
    out = b.join(a, "block_id", "left").join(near.select("block_id", "nearest_distance", "nearest_direction"), "block_id", "left").join(n, "block_id", "left")
    third = F.col("tier") == "temporal_proximity"
    out = out.withColumn("tier", F.coalesce("tier", F.lit("temporal_proximity"))).withColumn("proximity_distance", F.when(third, F.col("nearest_distance"))).withColumn("proximity_direction", F.when(third, F.col("nearest_direction")))
    return out.drop("confidence", "nearest_distance", "nearest_direction").withColumn("cluster_count", F.coalesce("cluster_count", F.lit(0)))


def block_sums(blocks: DataFrame) -> DataFrame:
    """Per path: blocks, shares (1/N of a block's N files), shared sums of the signals, presence and intensity of markers."""
    b = blocks.filter("size(file_paths) > 0").withColumn("share", F.lit(1.0) / F.size("file_paths")).withColumn("path", F.explode("file_paths"))
    marked = F.col("markers_per_100w") * T.cluster_weight(F.greatest(F.col("cluster_count"), F.lit(1)))
    positive = F.col("markers_per_100w") > 0
    shared = lambda c: F.sum(c * F.col("share"))
    return b.groupBy("path").agg(
        F.count("*").alias("tangle_count"), F.sum("share").alias("shares"), F.count_if("tool_use_coupling").alias("coupled"), shared(marked).alias("shared_markers"), F.sum(marked).alias("whole_markers"), shared(F.col("length_words")).alias("words"),
        shared(F.col("question_rate_per_100w")).alias("questions"), shared(F.col("tool_use_coupling").cast("double")).alias("coupling"), F.sum(F.when(positive, F.col("share")).otherwise(0.0)).alias("positive"), F.sum(F.when(positive, F.col("share") * F.col("markers_per_100w")).otherwise(0.0)).alias("intensity"),
    )


def _turn_texts(ev: DataFrame) -> DataFrame:
    """(session, event_index, text_chars): what an assistant turn says aloud."""
    size = F.aggregate(F.filter("blocks", lambda b: b["kind"] == "text"), F.lit(0).cast("long"), lambda s, b: s + F.coalesce(F.length(b["text"]), F.lit(0)))
    return ev.filter("type = 'assistant'").select("session", "event_index", size.alias("text_chars"))


def reasoning_ratio(ev: DataFrame, blocks: DataFrame) -> DataFrame:
    """(path, ratio): characters thought about a file by those said in the same turns, each turn's once a file; capped."""
    t = blocks.filter("type = 'assistant' and size(file_paths) > 0").select("session", "event_index", F.length("text").alias("n"), F.explode("file_paths").alias("path"))
    t = t.groupBy("session", "event_index", "path").agg(F.sum("n").alias("n")).join(_turn_texts(ev), ["session", "event_index"])
    return t.groupBy("path").agg(F.sum("n").alias("r"), F.sum("text_chars").alias("o")).select("path", scoring.capped_ratio(F.col("r").cast("double"), F.col("o").cast("double")).alias("ratio"))


#: The signals of a score, their weights (fixed values) and the baselines their z is taken by.
SIGNALS = {
    "markers": (0.25, None), "block_length_words": (0.0, "block_length_words"), "question_rate_per_100w": (0.0, "question_rate_per_100w"), "tool_use_coupling": (0.0, "tool_use_coupling_rate"),
    "reread_bursts": (0.25 / 3, "reread_bursts_per_file"), "edit_churn": (0.25 / 3, "edit_churn_per_file"), "reasoning_to_output_ratio": (0.0, "reasoning_to_output_ratio"), **{k: (0.0, "leakage_events_per_session") for k in LEAKS},
}


BASELINES = ("block_length_words", "question_rate_per_100w", "markers_per_100w", "tool_use_coupling_rate", "reasoning_to_output_ratio", "leakage_events_per_session", "reread_bursts_per_file", "edit_churn_per_file")


@dataclass
class Scan:
    """All tables of a scan over session records; each is planned when it is asked for, and those that several others read are written once."""

    records: DataFrame
    session: str = "file_name"

    @cached_property
    def events(self) -> DataFrame:
        return checkpointed(events(self.records, self.session))

    @cached_property
    def uses(self) -> DataFrame:
        return checkpointed(tool_uses(self.events))

    @cached_property
    def blocks(self) -> DataFrame:
        return checkpointed(thinking_blocks(self.events, self.uses))

    @cached_property
    def leaks(self) -> DataFrame:
        return checkpointed(leakage(self.uses))

    @cached_property
    def bursts(self) -> dict[str, DataFrame]:
        return {k: checkpointed(burst_counts(self.uses, t)) for k, t in (("reread_bursts", "Read"), ("edit_churn", "Edit"))}

    def samples(self) -> DataFrame:
        """(session, signal, value): what the baselines are taken of; a file's bursts are a session's, to be summed for the corpus."""
        b, sessions = self.blocks, self.events.select("session").distinct()
        per_block = b.select("session", F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), F.col(c).cast("double").alias("value")) for n, c in (("block_length_words", "length_words"), ("question_rate_per_100w", "question_rate_per_100w"), ("markers_per_100w", "markers_per_100w"))))).alias("x")).select("session", "x.*")
        coupled = b.groupBy("session").agg(F.avg(F.col("tool_use_coupling").cast("double")).alias("value")).select("session", F.lit("tool_use_coupling_rate").alias("signal"), "value")
        thought = b.filter("type = 'assistant'").groupBy("session").agg(F.sum(F.length("text")).alias("r"))
        said = _turn_texts(self.events).groupBy("session").agg(F.sum("text_chars").alias("o"))
        ratio = sessions.join(thought, "session", "left").join(said, "session", "left").select("session", F.lit("reasoning_to_output_ratio").alias("signal"), (F.coalesce("r", F.lit(0)) / F.greatest(F.coalesce("o", F.lit(0)), F.lit(1))).alias("value"))
        leaks = sessions.join(self.leaks.groupBy("session").agg(F.count("*").alias("n")), "session", "left").select("session", F.lit("leakage_events_per_session").alias("signal"), F.coalesce("n", F.lit(0)).cast("double").alias("value"))
        return reduce(DataFrame.unionByName, (per_block, coupled, ratio, leaks))

    def _stats(self, samples: DataFrame, keys: list[str]) -> DataFrame:
        robust = stats.median_mad(samples.filter("signal <> 'markers_per_100w'"), keys, "value")
        there = stats.presence_intensity(samples.filter("signal = 'markers_per_100w'"), keys, "value")
        return robust.withColumn("kind", F.lit("robust_z")).unionByName(there.withColumn("kind", F.lit("presence_intensity")), allowMissingColumns=True)

    def corpus_baselines(self) -> DataFrame:
        """signal, kind, median, mad, n, low_confidence, presence_rate, intensity_median, n_positive; a signal without samples has zeros."""
        files = [d.groupBy("path").agg(F.sum("n").cast("double").alias("value")).select(F.lit(f"{k}_per_file").alias("signal"), "value") for k, d in self.bursts.items()]
        # a null of each signal, so that it has a row
        empty = self.records.sparkSession.createDataFrame([(n, None) for n in BASELINES], "signal string, value double")
        return self._stats(reduce(DataFrame.unionByName, files, self.samples().drop("session").unionByName(empty)), ["signal"])

    def session_baselines(self, least: int = SESSION_BLOCKS) -> DataFrame:
        """The same per session, of sessions with ``least`` thinking blocks."""
        files = [d.select("session", F.lit(f"{k}_per_file").alias("signal"), F.col("n").cast("double").alias("value")) for k, d in self.bursts.items()]
        large = self.blocks.groupBy("session").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("session")
        return self._stats(reduce(DataFrame.unionByName, files, self.samples()).join(large, "session", "left_semi"), ["session", "signal"])

    def file_scores(self) -> DataFrame:
        """Per file: raw value, z and contribution of the eleven signals, multi_file_weight, tangle_count, thinking_resolution_rate, score."""
        leaks = self.leaks.groupBy("path").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in LEAKS))
        parts = [leaks, reasoning_ratio(self.events, self.blocks).withColumnRenamed("ratio", "reasoning_to_output_ratio"), *(d.groupBy("path").agg(F.sum("n").alias(k)) for k, d in self.bursts.items())]
        j = reduce(lambda a, b: a.join(b, "path", "full_outer"), parts, block_sums(self.blocks)).na.fill(0)
        per = lambda c, by: F.coalesce(F.try_divide(c, by), F.lit(0.0))
        raw = {
            "markers": per("positive", "shares") * per("intensity", "positive"), "block_length_words": per("words", "shares"), "question_rate_per_100w": per("questions", "shares"), "tool_use_coupling": per("coupling", "shares"),
            **{k: F.col(k).cast("double") for k in ("reread_bursts", "edit_churn", "reasoning_to_output_ratio", *LEAKS)},
        }
        base = self.corpus_baselines().filter("kind = 'robust_z'").agg(F.map_from_entries(F.collect_list(F.struct("signal", F.struct("median", "mad")))).alias("base"))
        j = j.join(F.broadcast(base), F.lit(True), "left")  # one row of a few signals
        known = lambda b, f: F.coalesce(F.try_element_at("base", F.lit(b))[f], F.lit(0.0))
        z = {k: F.lit(0.0) if b is None else stats.robust_z(raw[k], known(b, "median"), known(b, "mad")) for k, (_, b) in SIGNALS.items()}
        give = {k: (raw[k] if b is None else z[k]) * w for k, (w, b) in SIGNALS.items()}
        columns = [c for k in SIGNALS for c in (raw[k].alias(k), z[k].alias(f"{k}_z"), give[k].alias(f"{k}_contribution"))]
        weight = F.coalesce(F.try_divide("shared_markers", F.when(F.col("whole_markers") > 0, F.col("whole_markers"))), F.lit(1.0))
        return j.select("path", F.col("tangle_count").cast("long").alias("tangle_count"), per("coupled", "tangle_count").alias("thinking_resolution_rate"), weight.alias("multi_file_weight"), *columns, sum(give.values(), F.lit(0.0)).alias("score"))

    def excerpts(self) -> DataFrame:
        """Every marker cluster of a thinking block with its text, its block's place and signals and the files it is attributed to."""
        cols = ["block_id", "session", "session_id", "block_index", "agent_sourced", "tier", "file_paths", "length_words", "marker_count", "markers_per_100w"]
        total = self.blocks.groupBy("session").agg(F.count("*").alias("block_total"))
        return T.excerpts(self.blocks, "block_id").join(self.blocks.select(cols), "block_id").join(total, "session")

    def excerpts_by_file(self, most: int = 5) -> DataFrame:
        """The leading excerpts of each file: most markers, then most clusters, then the earliest block."""
        e = self.excerpts().withColumn("path", F.explode("file_paths")).select("path", "session", "block_index", "cluster_index", "cluster_count", "marker_count", "text")
        return scoring.top_per_group(e, "path", [F.desc("marker_count"), F.desc("cluster_count"), F.col("block_index"), F.col("session"), F.col("cluster_index")], most)

    def sessions_by_file(self) -> DataFrame:
        named = self.uses.select("session", F.explode("paths").alias("path"))
        told = self.blocks.filter("cluster_count > 0").select("session", F.explode("file_paths").alias("path"))
        return named.unionByName(told).groupBy("path").agg(F.countDistinct("session").alias("session_count"))

    def report_files(self, sources: DataFrame | None = None) -> DataFrame:
        """One row a file of the report: score and components, loc, behaviour, tool usage and sessions; unordered (rank by score, then path).

        ``sources`` has path and loc of files that are there; a file that isn't, and was neither edited nor written, is left out, and so are ignored ones.
        """
        leaks = self.leaks.groupBy("path").agg(F.count("*").alias("leakage_total"))
        told = self.blocks.filter("cluster_count > 0").select(F.explode("file_paths").alias("path")).distinct()
        named = tool_usage(self.uses)
        names = reduce(DataFrame.unionByName, (d.select("path") for d in (leaks, told, named))).distinct().filter(~scoring.ignored(F.col("path")))
        j = reduce(lambda a, b: a.join(b, "path", "left"), (named, leaks, self.sessions_by_file(), self.file_scores()), names)
        j = j.join(sources.select("path", "loc"), "path", "left") if sources is not None else j.withColumn("loc", F.lit(0))
        counts = ["loc", "leakage_total", "session_count", "tangle_count", *(t.lower() for t in TOOLS)]
        j = j.na.fill(0, counts).na.fill(0.0).filter("loc > 0 or edit > 0 or write > 0")
        parts = F.split("path", "/")
        return j.withColumn("name", F.element_at(parts, -1)).withColumn("directory", F.concat(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"), F.lit("/"))).withColumn("normalized_by_loc", F.col("score") / F.greatest(F.col("loc"), F.lit(1)))

    def top_components(self) -> DataFrame:
        """Per file the signal that adds most to its score, by absolute contribution; ties go to the one named first."""
        ranked = F.array_max(F.array(*(F.struct(F.abs(F.col(f"{k}_contribution")).alias("size"), F.lit(-i).alias("place"), F.lit(k).alias("signal"), F.col(f"{k}_contribution").alias("contribution")) for i, k in enumerate(SIGNALS))))
        return self.file_scores().select("path", "score", ranked.alias("x")).select("path", "score", F.col("x.signal").alias("signal"), F.col("x.contribution").alias("contribution"))

    def titles(self) -> DataFrame:
        """(session, title): the last ai-title with text, else the first last-prompt's first line, else '(untitled)'."""
        e = self.records.select(F.col(self.session).alias("session"), "record_id", F.try_parse_json("payload").alias("v"))
        of = lambda kind, path: F.when((_string(F.col("v"), "$.type") == kind) & _string(F.col("v"), path).rlike(r"\S"), _string(F.col("v"), path))
        e = e.select("session", F.struct(_string(F.col("v"), "$.timestamp").try_cast("timestamp").alias("at"), "record_id").alias("at"), of("ai-title", "$.aiTitle").alias("title"), of("last-prompt", "$.lastPrompt").alias("prompt"))
        g = e.groupBy("session").agg(F.max(F.when(F.col("title").isNotNull(), F.struct("at", "title")))["title"].alias("title"), F.min(F.when(F.col("prompt").isNotNull(), F.struct("at", "prompt")))["prompt"].alias("prompt"))
        return g.select("session", F.coalesce("title", T.fallback_title(F.col("prompt")), F.lit("(untitled)")).alias("title"))

    def models(self) -> DataFrame:
        """Events and sessions of each model; assistant events without one are 'unknown'."""
        e = self.events.filter("model is not null or assistant_like").select(F.coalesce("model", F.lit("unknown")).alias("model"), "session")
        return e.groupBy("model").agg(F.count("*").alias("n_events"), F.countDistinct("session").alias("n_sessions"))
