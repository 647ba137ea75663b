"""How paths, texts, numbers and sessions are shown and found: strip roots, display paths, redacted excerpts, folders of sessions."""

from __future__ import annotations

import json
import re
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOME = r"/(?:Users|home)/[^/\s]+"


def strip_roots(paths: DataFrame, slug: str, path: str = "path") -> DataFrame:
    """One row: ``root``, the folder that a slug ('-' for '/' or '-') spells at the start of the first path by name; null if none does."""
    body = slug.lstrip("-")
    pattern = "".join("[/-]" if c == "-" else re.escape(c) for c in body)
    hit = F.regexp_extract(path, f"^/?({pattern})(?=/|$)", 1)
    if not body:
        return paths.agg(F.lit(None).cast("string").alias("root"))
    return paths.agg(F.min_by(F.concat(F.lit("/"), hit), F.when(hit != "", F.col(path))).alias("root"))


def codebase_name(root: Column, slug: str) -> Column:
    """The root's last part, else the slug's."""
    return F.coalesce(F.element_at(F.split(root, "/"), -1), F.lit(slug.rpartition("-")[2]))


def display_path(path: Column, root: Column) -> Column:
    """Relative to the root below it, '' for the root itself, else with the home folder as '~'."""
    prefix = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    below = F.when(root != "", F.when(path == root, F.lit("")).when(path.startswith(prefix), F.substr(path, F.length(prefix) + 1)))
    return F.coalesce(below, F.regexp_replace(path, HOME, "~"))


def redacted(text: Column, highlights: Column) -> Column:
    """(text, highlights) with home folders as '~'; the places (start, end, marker) move by what was cut before them.

    A place inside of a cut keeps its distance to the text before, but never falls below 0.
    """
    pieces = F.split(text, HOME)
    cuts = F.transform(F.regexp_extract_all(text, F.lit(f"({HOME})")), F.length)
    # ends of the cuts in the old text, each with what had been lost up to it
    step = lambda acc, i: F.struct(
        (acc["at"] + F.length(F.element_at(pieces, i + 1)) + F.element_at(cuts, i + 1)).alias("at"), (acc["lost"] + F.element_at(cuts, i + 1) - 1).alias("lost"),
        F.concat(acc["marks"], F.array(F.struct((acc["at"] + F.length(F.element_at(pieces, i + 1)) + F.element_at(cuts, i + 1)).alias("end"), (acc["lost"] + F.element_at(cuts, i + 1) - 1).alias("lost")))).alias("marks"),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("lost"), F.array().cast("array<struct<end:int,lost:int>>").alias("marks"))
    index = F.when(F.size(cuts) > 0, F.sequence(F.lit(0), F.size(cuts) - 1)).otherwise(F.array().cast("array<int>"))
    marks = F.aggregate(index, start, step)["marks"]
    shift = lambda o: F.coalesce(F.array_max(F.transform(F.filter(marks, lambda m: m["end"] <= o), lambda m: m["lost"])), F.lit(0))
    moved = F.transform(highlights, lambda h: F.struct(F.greatest(h["start"] - shift(h["start"]), F.lit(0)).alias("start"), F.greatest(h["end"] - shift(h["end"]), F.lit(0)).alias("end"), h["marker"].alias("marker")))
    return F.struct(F.regexp_replace(text, HOME, "~").alias("text"), moved.alias("highlights"))


def match_session(sessions: DataFrame, wanted: str, session: str = "session_id", title: str = "title") -> DataFrame:
    """Sessions whose id begins with ``wanted`` (8 or more hexadecimal digits and hyphens), else those whose title holds it in any case.

    ``matched_by`` says which; titles are only looked at if no id fits. The check for an id is one row, so it is broadcast.
    """
    needle = wanted.lower()
    by_id = F.coalesce(F.lower(F.col(session)).startswith(needle), F.lit(False)) if re.match(r"[0-9a-f]{8}[0-9a-f-]*\Z", needle) else F.lit(False)
    by_title = F.coalesce(F.contains(F.lower(F.col(title)), F.lit(needle)), F.lit(False))
    any_id = F.broadcast(sessions.agg(F.coalesce(F.max(by_id), F.lit(False)).alias("_any")))
    hit = sessions.join(any_id, F.lit(True)).filter(F.when(F.col("_any"), by_id).otherwise(by_title))
    return hit.withColumn("matched_by", F.when(F.col("_any"), "uuid").otherwise("title")).drop("_any")


def shown_number(x: Column) -> Column:
    """Two decimals from 1 on, three below, a dash for null."""
    return F.when(x.isNull(), "–").when(F.abs(x) >= 1, F.format_string("%.2f", x.cast("double"))).otherwise(F.format_string("%.3f", x.cast("double")))


def percentage(part: Column, whole: Column, digits: int = 1) -> Column:
    """'12.5 %'; a dash for a whole of 0."""
    share = F.try_divide(part.cast("double") * 100, whole)
    return F.when(share.isNotNull(), F.format_string(f"%.{digits}f %%", share)).otherwise("–")


def markdown_table(rows: DataFrame, columns: list[str], order: list[str], most: int = 1000) -> str:
    """A small table as Markdown; more rows than ``most`` are refused."""
    got = rows.select(*columns, *(c for c in order if c not in columns)).orderBy(*order).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns), *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in got)]
    return "\n".join(lines) + "\n"


def json_arguments(raw: Column) -> Column:
    """Arguments written as a JSON object, member by member as text; anything else is an empty map."""
    return F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))


def shortened(value, most: int):
    """A JSON value with its strings cut to ``most`` characters and an ellipsis, at any depth."""
    if isinstance(value, str):
        return value if len(value) <= most else value[:most] + "…"
    if isinstance(value, list):
        return [shortened(v, most) for v in value]
    return {k: shortened(v, most) for k, v in value.items()} if isinstance(value, dict) else value


def shortened_json(raw: Column, most: int = 200) -> Column:
    """``shortened`` JSON texts; what can't be read is null."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(shortened(json.loads(t), most), ensure_ascii=False)
            except (ValueError, RecursionError):
                return None

        return texts.map(one, na_action=None)

    return run(raw)


def sentences(text: Column) -> Column:
    """(text, start, end) of each sentence: up to a sign that ends one and the white space after it; places are code points."""
    parts = F.filter(F.regexp_extract_all(text, F.lit(r"(?s)\S.*?(?:[.!?]+(?=\s|\z)|\z)"), F.lit(0)), lambda s: s != "")
    gaps = F.split(text, r"(?s)\S.*?(?:[.!?]+(?=\s|\z)|\z)")
    step = lambda acc, i: F.struct(
        (acc["at"] + F.length(F.element_at(gaps, i + 1)) + F.length(F.element_at(parts, i + 1))).alias("at"),
        F.concat(acc["out"], F.array(F.struct(F.element_at(parts, i + 1).alias("text"), (acc["at"] + F.length(F.element_at(gaps, i + 1))).alias("start"), (acc["at"] + F.length(F.element_at(gaps, i + 1)) + F.length(F.element_at(parts, i + 1))).alias("end")))).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))
    index = F.when(F.size(parts) > 0, F.sequence(F.lit(0), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(index, start, step)["out"]


def sentence_of(spans: Column, place: Column) -> Column:
    """The number (from 0) of the sentence that a place lies in, null for none: an interval join inside of a row."""
    hit = F.filter(F.transform(spans, lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"), s["end"].alias("end"))), lambda s: (s["start"] <= place) & (place < s["end"]))
    return F.try_element_at(hit, F.lit(1))["i"]


def sessions_folder(start: str, home: str) -> Path:
    """The folder under ``home`` named by the nearest folder at or above ``start`` with '/' as '-'; none is an error that says what was tried."""
    tried = []
    for folder in [Path(start), *Path(start).parents]:
        there = Path(home, str(folder).replace("/", "-"))
        tried.append(str(there))
        if there.is_dir():
            return there
    raise FileNotFoundError("no sessions folder; tried " + ", ".join(tried))


def ignore_file(start: str, name: str) -> Path | None:
    """The nearest file of that name at or above a folder."""
    return next((f for folder in [Path(start), *Path(start).parents] if (f := folder / name).is_file()), None)
