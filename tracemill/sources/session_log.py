"""Session logs: JSON lines to events, with line order kept, and what is read from their blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators.nested import blocks_table
from tracemill.operators.schema import EVENT_TYPES
from tracemill.operators.windows import running

EVENT = "type string, sessionId string, uuid string, parentUuid string, timestamp string, cwd string, subtype string, aiTitle string, lastPrompt string"


def read_lines(spark: SparkSession, path: str, splittable: bool = False) -> DataFrame:
    """(file_name, line_no, payload) of all *.jsonl files of a directory, not recursive; lines keep their order, blank ones are skipped.

    A file is read as one row, which serves files up to some hundred MB. ``splittable`` reads larger files in blocks: lines are ordered by
    the block's start and their order in it, and numbered by a sort over ranges.
    """
    if splittable:
        raw = spark.read.text(f"{path}/*.jsonl").select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("m"))
        lines = running(raw, ["file_name"], ["block", "m"], position="line_no").withColumn("line_no", F.col("line_no").cast("int"))
    else:
        files = spark.read.text(f"{path}/*.jsonl", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.col("value"))
        lines = files.select("file_name", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return lines.select("file_name", "line_no", F.trim("line").alias("payload")).filter("payload <> ''")


def events(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects): known types get an event_index per file that counts kept lines only; rejects say why (malformed, unknown type).

    A file's session is the id of its first event that has one, else the file's name.
    """
    v = lines.withColumn("v", F.try_parse_json("payload"))
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    e = v.withColumn("e", F.when(is_object, F.from_json("payload", EVENT)))
    reason = F.when(F.col("v").isNull() | ~F.coalesce(is_object, F.lit(False)), "malformed").when(~F.coalesce(F.col("e.type").isin(*EVENT_TYPES), F.lit(False)), "unknown_type")
    e = e.select("file_name", "line_no", "payload", "e", reason.alias("reason"))
    kept = running(e.filter("reason is null").drop("reason"), ["file_name"], ["line_no"], position="event_index")
    first = kept.filter("e.sessionId is not null").groupBy(F.col("file_name").alias("_f")).agg(F.min_by("e.sessionId", "line_no").alias("_s"))
    stem = F.regexp_replace("file_name", r"\.jsonl$", "")
    out = kept.join(first, F.col("file_name") == F.col("_f"), "left").select("file_name", "line_no", "event_index", F.coalesce("_s", stem).alias("session_id"), "e.*", "payload").drop("sessionId")
    return out, e.filter("reason is not null").select("file_name", "line_no", "reason", F.col("e.type").alias("type"), "payload")


def titles(ev: DataFrame) -> DataFrame:
    """Per session the last non-empty ai-title, else the first non-empty last-prompt."""
    t = F.when((F.col("type") == "ai-title") & (F.trim("aiTitle") != ""), F.struct("line_no", F.col("aiTitle").alias("t")))
    p = F.when((F.col("type") == "last-prompt") & (F.trim("lastPrompt") != ""), F.struct("line_no", F.col("lastPrompt").alias("t")))
    return ev.groupBy("session_id").agg(F.coalesce(F.max(t)["t"], F.min(p)["t"]).alias("title"))


def shell_commands(records: DataFrame) -> DataFrame:
    """(record_id, command) of every tool use with a command: of turns, sub-agent turns and messages written as JSON text, nested blocks too."""
    return blocks_table(records).filter("block_type = 'tool_use' and command is not null").select("record_id", "command")


def listing(spark: SparkSession, path: str, within_hours: float | None = None) -> DataFrame:
    """Session files by modification time, newest first; ``within_hours`` filters on file metadata before anything is read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(path).select("path", "modificationTime", "length")
    if within_hours is not None:
        f = f.filter(F.col("modificationTime") >= F.current_timestamp() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(within_hours * 60)), F.lit(0).cast("decimal(18,6)")))
    return f.orderBy(F.desc("modificationTime"), "path")
