"""Trajectory files of six formats as one table of ordered events: emissions and action steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import shell

FAMILIES = ("thought", "epam", "sonar", "sage", "trae", "think_tool")
INSTANCE = r"^[A-Za-z0-9_.\-]+__[A-Za-z0-9_.\-]+-\d+$"
_CALL = "array<struct<function:struct<name:string,arguments:string>>>"
SHAPES = {
    "thought": "struct<trajectory:array<struct<thought:string,action:string>>>",
    "sage": "struct<messages:array<struct<role:string,content:string>>>",
    "trae": "array<struct<role:string,content:string>>",
    "sonar": f"array<struct<role:string,blocks:array<struct<block_type:string,content:string,num_tokens:int>>,additional_kwargs:struct<tool_calls:{_CALL}>>>",
    "think_tool": f"array<struct<role:string,content:string,tool_calls:{_CALL}>>",
    "epam": "array<map<string,struct<author_name:string,message:string,input_text:string>>>",  # a map keeps the document's order
}


def discover(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(files, quarantine) of a submission folder: *.traj before *.json, one file a stem, stems that are instance ids; contents as text."""
    f = spark.read.text([f"{folder}/*.traj", f"{folder}/*.json"], wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.col("value").alias("body"))
    f = f.distinct().withColumn("stem", F.regexp_replace("file_name", r"(\.traj\.json|\.traj|\.json)$", "")).withColumn("_rank", F.when(F.col("file_name").endswith(".traj"), 0).otherwise(1))
    f = f.withColumn("_n", F.row_number().over(Window.partitionBy("stem").orderBy("_rank", "file_name")))
    reason = F.when(~F.col("stem").rlike(INSTANCE), "not_an_instance").when(F.col("_n") > 1, "duplicate_stem")
    f = f.withColumn("reason", reason).drop("_rank", "_n")
    return f.filter("reason is null").drop("reason"), f.filter("reason is not null").select("file_name", "stem", "reason")


def shape_matches(family: str, body: Column) -> Column:
    """Whether a body parses to its family's top level: an object with the list that matters, or an array of objects."""
    v = F.try_parse_json(body)
    if family in ("thought", "sage"):
        key = "trajectory" if family == "thought" else "messages"
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")).startswith("ARRAY"), F.lit(False))
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def _rows(files: DataFrame, *parts: Column) -> DataFrame:
    """Explode (position, sub, kind, text, tools, commands) structs made of each step's parts, in order."""
    return files.select("stem", "container", F.posexplode(F.filter(F.concat(*parts), lambda e: e["kind"].isNotNull())).alias("sub", "e")).select("stem", "container", "sub", "e.kind", "e.text", "e.tools", "e.commands")


def _emit(text: Column) -> Column:
    return F.array(F.struct(F.when(text.isNotNull(), "emission").alias("kind"), text.alias("text"), F.lit(None).cast("array<string>").alias("tools"), F.lit(None).cast("array<string>").alias("commands")))


def _act(when: Column, tools: Column, commands: Column) -> Column:
    return F.array(F.struct(F.when(when, "action").alias("kind"), F.lit(None).cast("string").alias("text"), tools.alias("tools"), commands.alias("commands")))


def _thoughts(texts: Column) -> Column:
    none = F.lit(None).cast("array<string>")
    return F.coalesce(F.transform(texts, lambda t: F.struct(F.lit("emission").alias("kind"), F.coalesce(t, F.lit("")).alias("text"), none.alias("tools"), none.alias("commands"))), F.array().cast("array<struct<kind:string,text:string,tools:array<string>,commands:array<string>>>"))


def events(files: DataFrame, family: str) -> DataFrame:
    """(stem, container, sub, kind, text, tools, commands) of files (stem, body): emissions and action steps in document order."""
    j = files.select("stem", F.from_json("body", SHAPES[family]).alias("b"))
    if family == "epam":
        e = j.select("stem", F.posexplode(F.map_values(F.element_at("b", 1))).alias("container", "s"))
        thought = F.col("s.author_name") == "Thoughts"
        return _rows(e, _emit(F.when(thought, F.coalesce("s.message", F.lit("")))), _act(~F.coalesce(thought, F.lit(False)), F.array("s.author_name"), F.array("s.input_text")))
    steps = {"thought": "b.trajectory", "sage": "b.messages"}.get(family, "b")
    e = j.select("stem", F.posexplode(steps).alias("container", "s"))
    if family == "thought":
        acts = F.coalesce(F.trim("s.action") != "", F.lit(False))
        return _rows(e, _emit(F.col("s.thought")), _act(acts, F.array(F.split_part(F.trim("s.action"), F.lit(" "), F.lit(1))), F.array("s.action")))
    e = e.filter("s.role = 'assistant'")
    if family == "sage":
        bodies = F.regexp_extract_all("s.content", F.lit(r"(?s)```bash\s*\n(.*?)```"), F.lit(1))
        return _rows(e.filter("s.content is not null"), _emit(shell.thought_span(F.col("s.content"))), _act(F.size(bodies) > 0, F.transform(bodies, lambda _: F.lit("bash")), bodies))
    if family == "trae":
        calls = shell.function_calls(F.col("s.content"))
        return _rows(e.filter("s.content is not null"), _emit(shell.think_span(F.col("s.content"))), _act(F.size(calls) > 0, calls, F.lit(None).cast("array<string>")))
    calls = F.coalesce(F.col("s.additional_kwargs.tool_calls" if family == "sonar" else "s.tool_calls"), F.array().cast(_CALL))
    if family == "sonar":
        said = F.transform(F.filter("s.blocks", lambda x: x["block_type"] == "thinking"), lambda x: x["content"])
    else:
        thinks = F.filter(calls, lambda c: c["function"]["name"] == "think")
        said = F.transform(F.filter(thinks, lambda c: F.try_parse_json(c["function"]["arguments"]).isNotNull()), lambda c: F.get_json_object(c["function"]["arguments"], "$.thought"))
        calls = F.filter(calls, lambda c: ~(c["function"]["name"].eqNullSafe("think")))
    return _rows(e, _thoughts(said), _act(F.size(calls) > 0, F.transform(calls, lambda c: c["function"]["name"]), F.transform(calls, lambda c: c["function"]["arguments"])))
