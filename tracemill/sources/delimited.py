"""Delimited exports with damaged rows: permissive split first, then a reason for each row that fails."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators.schema import EVENT_TYPES
from tracemill.runtime import checkpointed, looked_up, ship

#: Columns a header may name; a header's delimiter is its first character that is neither of a name nor a quote.
COLUMNS = ("type", "sessionId", "uuid", "timestamp", "content", "eventIndex", "model")
REASONS = ("quoting", "column_count", "invalid_value")

_SPLIT = T.StructType(
    [
        T.StructField("fields", T.ArrayType(T.StringType())),
        T.StructField("quoting_ok", T.BooleanType()),
        T.StructField("content_kind", T.StringType()),
    ]
)


def split_record(line: str, delimiter: str) -> tuple[list[str], bool]:
    """Fields of one record and whether it keeps RFC 4180; a broken record still gives what can be read of it."""
    if '"' not in line:
        return line.split(delimiter), True
    fields, pos, ok, n = [], 0, True, len(line)
    while True:
        if pos < n and line[pos] == '"':
            parts, start = [], pos + 1
            while True:
                end = line.find('"', start)
                if end < 0:
                    fields.append("".join(parts) + line[start:])
                    return fields, False
                if line.startswith('"', end + 1):
                    parts.append(line[start : end + 1])
                    start = end + 2
                    continue
                parts.append(line[start:end])
                pos = end + 1
                break
            value = "".join(parts)
            if pos < n and line[pos] != delimiter:
                ok = False
                stop = line.find(delimiter, pos)
                stop = n if stop < 0 else stop
                value += line[pos:stop]
                pos = stop
        else:
            stop = line.find(delimiter, pos)
            stop = n if stop < 0 else stop
            value = line[pos:stop]
            ok = ok and '"' not in value
            pos = stop
        fields.append(value)
        if pos >= n:
            return fields, ok
        pos += 1


def _refuse(token: str) -> None:
    raise ValueError(token)


_DECODER = json.JSONDecoder(parse_constant=_refuse, parse_int=str, parse_float=str)
_EDGE = " \t\n\r"


def json_kind(text: str | None) -> str | None:
    """'string', 'array' or 'other' for strict JSON (RFC 8259), None for anything else; nesting too deep to decode counts as not strict."""
    if text is None:
        return None
    try:
        value = _DECODER.decode(text.strip(_EDGE)) if text[:1] in _EDGE or text[-1:] in _EDGE else _DECODER.decode(text)
    except (ValueError, RecursionError):
        return None
    head = text.lstrip(_EDGE)[:1]
    return "string" if head == '"' else "array" if isinstance(value, list) else "other"


@F.pandas_udf(_SPLIT)
def _split(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for lines, delimiters, at in batches:
        rows = []
        for line, delimiter, k in zip(lines, delimiters, at, strict=True):
            if line is None:
                rows.append((None, None, None))
                continue
            fields, ok = split_record(line, delimiter) if delimiter else ([line], '"' not in line)
            kind = json_kind(fields[int(k)]) if ok and k == k and k is not None and 0 <= k < len(fields) else None
            rows.append((fields, ok, kind))
        yield pd.DataFrame(rows, columns=["fields", "quoting_ok", "content_kind"])


# else a filter on what it gives is pushed below it, and it runs twice
_split = _split.asNondeterministic()


def headers(lines: DataFrame) -> DataFrame:
    """One row a file: its delimiter and its column names in order; of several line_no 0 the lowest line_id counts."""
    h = lines.filter(F.col("line_no") == 0).groupBy("file_name").agg(F.min_by("raw_line", "line_id").alias("header"))
    bare = F.regexp_replace("header", '^\\x{FEFF}|"', "")
    delimiter = F.regexp_extract(bare, r"^\s*[A-Za-z_]\w*\s*?([^\w])", 1)
    names = F.when(F.length(delimiter) == 0, F.array(F.trim(bare))).otherwise(
        F.transform(F.split(bare, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))), lambda c: F.trim(c))
    )
    return h.select("file_name", F.when(F.length(delimiter) > 0, delimiter).alias("delimiter"), names.alias("names"))


def _real_instant(text) -> F.Column:
    """ISO 8601 date, T, time with seconds and at most six decimals, Z or an offset, naming a real instant."""
    shape = text.rlike(r"\A\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6})?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)\z")
    day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    return shape & ~text.startswith("0000") & day.isNotNull()


_UUID = r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"


def read_delimited(lines: DataFrame) -> DataFrame:
    """Read raw records (line_id, file_name, line_no, raw_line) permissively under each file's header.

    Each record that is neither header nor blank comes out once, with its values by column name, ``reason`` (null if valid, else
    the first that applies of quoting, column_count, invalid_value) and, for failed records, the raw text in ``corrupt_record``.
    Null or white-space-only lines are blank. A file without a header row has no columns, so all its records that keep the
    quoting rules fail by column_count. Repeated records are kept, as line_id tells them apart. Extra input columns are ignored.
    The headers are one row a file and are counted: few are broadcast, so that the records stay where they are (see ``looked_up``).
    """
    ship(lines.sparkSession)
    base = lines.select("line_id", "file_name", "line_no", "raw_line")
    body = base.filter(F.coalesce(F.col("line_no"), F.lit(-1)) != 0).filter(F.col("raw_line").rlike(r"\S"))
    h = checkpointed(headers(base))
    at = (F.array_position("names", F.lit("content")) - 1).cast("double")
    split = looked_up(body, h, ["file_name"], how="left").withColumn("s", _split("raw_line", "delimiter", at))
    col = {c: F.try_element_at(F.col("s.fields"), F.when(F.array_contains("names", c), F.array_position("names", F.lit(c)).cast("int")).otherwise(F.lit(10**6))) for c in COLUMNS}
    split = split.select("*", *(col[c].alias(f"v_{c}") for c in COLUMNS))
    has = lambda c: F.array_contains("names", c)
    good = (
        F.coalesce(F.col("v_type").isin(*EVENT_TYPES), F.lit(False))
        & F.coalesce(F.col("v_sessionId").rlike(_UUID), F.lit(False))
        & F.coalesce(F.col("v_uuid").rlike(_UUID), F.lit(False))
        & F.coalesce(_real_instant(F.col("v_timestamp")), F.lit(False))
        & F.coalesce(F.col("s.content_kind").isin("string", "array"), F.lit(False))
        & (~has("eventIndex") | F.coalesce(F.col("v_eventIndex").rlike(r"\A[0-9]+\z"), F.lit(False)))
    )
    reason = (
        F.when(~F.col("s.quoting_ok"), "quoting")
        .when(F.col("names").isNull() | (F.size("s.fields") != F.size("names")), "column_count")
        .when(~F.coalesce(good, F.lit(False)), "invalid_value")
    )
    return split.select(
        "line_id", "file_name", "line_no", reason.alias("reason"), F.when(reason.isNotNull(), F.col("raw_line")).alias("corrupt_record"), *(F.when(reason.isNull(), F.col(f"v_{c}")).alias(c) for c in COLUMNS)
    )


def failed_lines(lines: DataFrame) -> DataFrame:
    """(line_id, reason) of the records that fail."""
    return read_delimited(lines).filter("reason is not null").select("line_id", "reason")


def valid_records(lines: DataFrame) -> DataFrame:
    """Typed valid records: timestamp as an instant, eventIndex as a decimal of any usual length."""
    r = read_delimited(lines).filter("reason is null")
    return r.select(
        "line_id", "file_name", "line_no", "type", F.lower("sessionId").alias("session_id"), F.lower("uuid").alias("event_uuid"), F.to_timestamp("timestamp").alias("event_time"), "content", F.expr("try_cast(eventIndex as decimal(38,0))").alias("event_index"), "model"
    )
