"""The report: one nested row as JSON, an escaped page, the baseline cache, and the layout of a treemap."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Report schema version (fixed value).
SCHEMA_VERSION = "1.4"
_BASE = "signal string, kind string, median double, mad double, n long, low_confidence boolean"


def report_json(scores: DataFrame, baselines: DataFrame, most: int = 1000) -> str:
    """The report for a page: the ``most`` leading files (``n_shown``) of ``n_files`` in all, and every baseline, one row a signal.

    All files are in the report that ``write_report`` leaves.
    """
    files = [r.asDict(recursive=True) for r in scores.orderBy(F.desc("score"), "path").limit(most).collect()]
    base = [r.asDict(recursive=True) for r in baselines.orderBy(*(c for c in ("signal", "kind") if c in baselines.columns)).collect()]
    n = scores.count() if len(files) >= most else len(files)
    return json.dumps({"meta": {"schema_version": SCHEMA_VERSION, "n_files": n, "n_shown": len(files)}, "baselines": base, "files": files}, ensure_ascii=False, default=str)


def write_report(scores: DataFrame, baselines: DataFrame, path: str) -> None:
    """The whole report as JSON lines below ``path``: meta (one line), baselines and files, every one, written by the executors, nulls kept."""
    meta = scores.agg(F.count("*").alias("n_files")).select(F.lit(SCHEMA_VERSION).alias("schema_version"), "n_files")
    for name, rows in (("meta", meta), ("baselines", baselines), ("files", scores.orderBy(F.desc("score"), "path"))):
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def page(report: str, template: str, marker: str = "__REPORT__") -> str:
    """The report inside a page: '<' is escaped, so no text can close the script element."""
    return template.replace(marker, report.replace("<", "\\u003c"))


def save_baselines(baselines: DataFrame, path: str) -> None:
    baselines.coalesce(1).write.mode("overwrite").json(path)


def load_baselines(spark: SparkSession, path: str) -> DataFrame | None:
    """The cached baselines, or None if there are none or they have an older form (no kind)."""
    if not Path(path).exists():
        return None
    b = spark.read.schema(_BASE).json(path)
    return None if b.filter("kind is null").limit(1).count() else b


def squarify(sizes: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Rectangles (x, y, width, height) for sizes in descending order, rows kept as square as can be."""
    total = sum(sizes)
    areas = [s * w * h / total for s in sizes] if total > 0 else []
    out: list[tuple[float, float, float, float]] = []
    i = 0
    while i < len(areas):
        side, row, best = min(w, h), [], float("inf")
        while i + len(row) < len(areas):
            trial = [*row, areas[i + len(row)]]
            s = sum(trial)
            worst = max(max(side * side * a / (s * s), s * s / (side * side * a)) if a > 0 and side > 0 else float("inf") for a in trial)
            if row and worst > best:
                break
            row, best = trial, worst
        s = sum(row)
        thick = s / side if side > 0 else 0.0
        at = 0.0
        for a in row:
            long = a / thick if thick > 0 else 0.0
            out.append((x, y + at, thick, long) if w >= h else (x + at, y, long, thick))
            at += long
        x, y, w, h = (x + thick, y, w - thick, h) if w >= h else (x, y + thick, w, h - thick)
        i += len(row)
    return out
