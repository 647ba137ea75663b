"""Reading judges' answers: the first JSON object of a text, score coercion and the outcome of an answer."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DECODER = json.JSONDecoder()
ANSWER = T.StructType([*(T.StructField(n, T.BooleanType()) for n in ("has_object", "has_score")), *(T.StructField(n, T.StringType()) for n in ("score_text", "score_kind", "justification"))])


def first_object(text: str | None) -> dict | None:
    at = (text or "").find("{")
    while at >= 0:
        try:
            value, _ = _DECODER.raw_decode(text, at)
            return value
        except (ValueError, RecursionError):
            at = text.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def first_json_object(texts: pd.Series) -> pd.Series:
    """The first JSON object in free text, as JSON."""
    return texts.map(lambda t: None if (o := first_object(t)) is None else json.dumps(o, ensure_ascii=False), na_action=None)


@F.pandas_udf(ANSWER)
def answer_parts(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        o = first_object(t)
        s = (o or {}).get("score")
        why = (o or {}).get("justification")
        rows.append((o is not None, "score" in (o or {}), None if s is None else str(s), type(s).__name__, why if isinstance(why, str) else None))
    return pd.DataFrame(rows, columns=ANSWER.names)


def score_of(kind: Column, text: Column) -> Column:
    """An int 0-3, or a text that is one such digit; booleans, floats and longer numbers are none."""
    ok = ((kind == "int") & text.rlike(r"^[0-3]$")) | ((kind == "str") & F.trim(text).rlike(r"^[0-3]$"))
    return F.when(ok, F.trim(text).cast("int"))


def outcome(answer: Column, stop_reason: Column) -> Column:
    """valid, refusal, no_json_object, score_missing or score_invalid."""
    score = score_of(answer["score_kind"], answer["score_text"])
    return F.when(stop_reason.eqNullSafe("refusal"), "refusal").when(~answer["has_object"], "no_json_object").when(~answer["has_score"], "score_missing").when(score.isNull(), "score_invalid").otherwise("valid")
