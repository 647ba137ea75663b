"""Schemas that drift between the files of a stream: profiles, a change report, and rescue-column ingestion."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.runtime import checkpointed, ship

#: Changed fields up to this number (files x fields) are told to the Python workers; more are joined.
MOST_TOLD = 50_000
#: Fields of unlike size hold the same data if so many distinct values, and this share of the smaller one's, occur in both.
LEAST_SHARED, LEAST_WITHIN = 20, 0.8

PROFILE = "export_stream string, export_file string, exported_at timestamp, field string, kind string, n bigint"
VALUES = "export_stream string, export_file string, field string, h bigint, shape bigint, structured boolean, truth boolean, number double, n bigint"
LEAVES = "record_id bigint, export_stream string, export_file string, exported_at timestamp, readable boolean, leaves map<string,struct<kind:string,text:string>>"
FOUND = "export_file string, change_kind string, field_name string, old_field_name string"


def kind_of(value) -> str:
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "array" if isinstance(value, list) else "string"


def leaves(value: dict) -> Iterator[tuple[str, object]]:
    """Dotted leaf names with values that are not null; an iterative walk, so depth is no limit."""
    stack = [("", value)]
    while stack:
        prefix, o = stack.pop()
        for k, v in o.items():
            if isinstance(v, dict):
                stack.append((f"{prefix}{k}.", v))
            elif v is not None:
                yield prefix + k, v


#: JSON types by Python's.
KINDS = {bool: "boolean", int: "number", float: "number", list: "array", str: "string"}


def _signature(value: dict) -> tuple:
    """Leaf names with the classes of their values."""
    return tuple((k, type(v)) for k, v in leaves(value))


def _decode(text: str | None) -> dict | None:
    try:
        o = json.loads(text) if text is not None else None
    except (ValueError, RecursionError):
        return None
    return o if isinstance(o, dict) else None


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial profiles: a row for each file (field null) and for each kind of each field, with the count of its values."""
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("export_stream", "export_file", "payload")]
        at = batch.column("exported_at")
        first: dict[tuple, int] = {}
        alike: dict[tuple, Counter] = {}
        for i, (stream, file, text) in enumerate(zip(*cols, strict=True)):
            first.setdefault((stream, file), i)
            # records of one file mostly have the same fields and kinds, so these are counted as a whole
            alike.setdefault((stream, file), Counter())[_signature(_decode(text) or {})] += 1
        rows = [(s, f, None, None, 0, first[s, f]) for s, f in first]
        for (s, f), signatures in alike.items():
            kinds: Counter = Counter()
            for signature, n in signatures.items():
                for x in signature:
                    kinds[x] += n
            rows += [(s, f, field, KINDS.get(kind, "string"), n, first[s, f]) for (field, kind), n in kinds.items()]
        c = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), at.take(pa.array(c[5], pa.int64())), pa.array(c[2], pa.string()), pa.array(c[3], pa.string()), pa.array(c[4], pa.int64())], names=["export_stream", "export_file", "exported_at", "field", "kind", "n"])


def field_profiles(exports: DataFrame) -> DataFrame:
    """One row per stream, file and field: number of values and majority kind.

    Batches are profiled before the shuffle, so what is shuffled is bounded by files x fields a batch, however large or hot a
    file is. A file without any readable record still has one row, with a null field. Kinds that tie go by name.
    """
    ship(exports.sparkSession)
    part = exports.select("export_stream", "export_file", "exported_at", "payload").mapInArrow(_profile, PROFILE)
    file = ["export_stream", "export_file"]
    merged = part.groupBy(*file, "field", "kind").agg(F.min("exported_at").alias("exported_at"), F.sum("n").alias("n"))
    return merged.groupBy(*file, "field").agg(
        F.min("exported_at").alias("exported_at"),
        F.sum(F.when(F.col("kind").isNotNull(), F.col("n"))).alias("n_values"),
        F.min_by("kind", F.when(F.col("kind").isNotNull(), F.struct(-F.col("n"), F.col("kind")))).alias("kind"),
    )


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _shown(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _traits(text: str) -> tuple:
    """What likeness asks of a value in lower case: hashes of the whole value and of its shape, whether that is structured, its truth and number."""
    shape = _shape(text)
    return _hash(text), _hash(shape), len(re.findall(r"[^w\s]", shape)) >= 2, True if text in _TRUE else False if text in _FALSE else None, _number(text)


def _values(batches: Iterator[pa.RecordBatch], wanted: set[tuple] | None) -> Iterator[pa.RecordBatch]:
    """Every distinct value of the unknown fields (of all, if None) of each file with its count, a batch at a time."""
    for batch in batches:
        seen: dict[tuple, Counter] = {}
        for stream, file, text in zip(*(batch.column(c).to_pylist() for c in ("export_stream", "export_file", "payload")), strict=True):
            for field, value in leaves(_decode(text) or {}):
                key = (stream or "", file, field)
                if wanted is None or key in wanted:
                    mine = seen.setdefault(key, Counter())
                    for v in value if isinstance(value, list) else (value,):
                        mine[_shown(v).lower()] += 1
        rows = [(*key, *_traits(v), n) for key, mine in seen.items() for v, n in mine.items()]
        c = list(zip(*rows, strict=True)) if rows else [()] * 9
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["export_stream", "export_file", "field", "h", "shape", "structured", "truth", "number", "n"])


def _tokens(name: str) -> list[str]:
    return [t.lower() for t in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name.rpartition(".")[2])]


def _same_word(a: str, b: str) -> bool:
    if a == b:
        return True
    s, t = sorted((a, b), key=len)
    if len(s) < 2 or s[0] != t[0]:
        return False
    i = iter(t)
    return all(c in i for c in s)


def name_likeness(a: str, b: str) -> float:
    """0 to 1 by the words of the last level, abbreviations counting; a pure move between levels gives 1."""
    x, y = _tokens(a), _tokens(b)
    if not x or not y:
        return 0.0
    if "".join(x) == "".join(y):
        return 1.0
    return 0.9 * sum(any(_same_word(s, t) for t in y) for s in x) / max(len(x), len(y)) if len(x) <= len(y) else name_likeness(b, a)


_FALSE, _TRUE = {"false", "no", "0", "n"}, {"true", "yes", "1", "y"}


def _number(text: str) -> float | None:
    try:
        v = float(text)
    except ValueError:
        return None
    return v if v == v and abs(v) != float("inf") else None


def _shape(text: str) -> str:
    return re.sub(r"[^\W_]+", "w", text)


def _share(a: Counter, b: Counter) -> float:
    na, nb = sum(a.values()), sum(b.values())
    return sum(min(v / na, b[k] / nb) for k, v in a.items()) if na and nb else 0.0


def judged(p: dict) -> tuple[float, bool]:
    """How far two fields hold the same data (0 to 1), and whether that alone can tell one from another.

    Of each side (0, 1): n values, d distinct ones, n_truth and n_true, n_number, n_structured. Of both: exact and forms, the shares that values
    and shapes have in common; ks, the distance of the numbers' distributions; shared, the distinct values in both; within, their share of
    the side with fewer distinct values.
    """
    n = p["n0"], p["n1"]
    if p["n_truth0"] == n[0] and p["n_truth1"] == n[1]:
        return 1 - abs(p["n_true0"] / n[0] - p["n_true1"] / n[1]), False
    if all(p[f"n_number{i}"] > 0.8 * n[i] for i in (0, 1)):
        return max(p["exact"], 1 - p["ks"]), False
    structured = p["n_structured0"] > 0.5 * n[0]
    many = min(p["d0"] / n[0], p["d1"] / n[1]) > 0.4
    if many and structured and p["forms"] > 0.7:
        return max(p["exact"], p["forms"]), True
    if p["shared"] >= LEAST_SHARED and p["within"] >= LEAST_WITHIN:
        return max(p["exact"], p["within"]), True
    return max(p["exact"], 0.6 * p["forms"]), p["exact"] >= 0.35


def data_likeness(a: list, b: list) -> tuple[float, bool]:
    """``judged`` for two lists of (value, count)."""
    x, y = Counter(), Counter()
    for z, c in ((a, x), (b, y)):
        for s, n in z:
            c[s.lower()] += n
    x, y = +x, +y
    if not x or not y:
        return 0.0, False
    p, shapes, numbers = {}, [Counter(), Counter()], []
    for i, z in enumerate((x, y)):
        traits = [(*_traits(s)[2:], n) for s, n in z.items()]
        p |= {f"n{i}": sum(z.values()), f"d{i}": len(z), f"n_truth{i}": sum(n for _, t, _, n in traits if t is not None), f"n_true{i}": sum(n for _, t, _, n in traits if t), f"n_structured{i}": sum(n for k, _, _, n in traits if k)}
        numbers.append([(f, n) for _, _, f, n in traits if f is not None])
        p[f"n_number{i}"] = sum(n for _, n in numbers[i])
        for s, n in z.items():
            shapes[i][_shape(s)] += n
    ks = 1.0
    if all(numbers):
        v, w = (np.sort(np.repeat([f for f, _ in z], [n for _, n in z])) for z in numbers)
        grid = np.concatenate([v, w])
        ks = np.abs(np.searchsorted(v, grid, "right") / len(v) - np.searchsorted(w, grid, "right") / len(w)).max()
    both = set(x) & set(y)
    small = x if len(x) <= len(y) else y
    return judged(p | {"exact": _share(x, y), "forms": _share(*shapes), "ks": ks, "shared": len(both), "within": sum(small[s] for s in both) / sum(small.values())})


def best_pairs(likeness: Iterable[tuple[str, str, float, bool]]) -> list[tuple[str, str]]:
    """Pairs (old, new) that hold the same data, best first, each name in one pair at most."""
    scored = []
    for old, new, data, telling in likeness:
        name = name_likeness(old, new)
        if (telling and data >= 0.4) or (name >= 0.3 and data >= 0.45):
            scored.append((-round(data + name, 9), old, new))
    pairs, gone = [], set()
    for _, old, new in sorted(scored):
        if ("-", old) not in gone and ("+", new) not in gone:
            gone |= {("-", old), ("+", new)}
            pairs.append((old, new))
    return pairs


def match_renames(removed: dict[str, list], added: dict[str, list]) -> list[tuple[str, str]]:
    """The renames among fields given by lists of (value, count)."""
    return best_pairs((old, new, *data_likeness(x, y)) for old, x in removed.items() for new, y in added.items())


def rescued_values(exports: DataFrame, unknown: DataFrame, most_told: int = MOST_TOLD) -> DataFrame:
    """(export_stream, source, field, h, ..., n): the values that ingesting each file under its neighbours' schemas rescues, counted.

    ``unknown`` (export_stream, source, field) names the fields of a file (source) that the schema of the file before or after it doesn't know. Values
    go by the hash of the whole value, so nothing is sampled or cut; texts don't leave the batch they are read in.
    """
    ship(exports.sparkSession)
    told = {(r[0], r[1], r[2]) for r in unknown.limit(most_told + 1).collect()}
    wanted = told if len(told) <= most_told else None
    raw = exports.select("export_stream", "export_file", "payload").mapInArrow(lambda b: _values(b, wanted), VALUES).withColumnRenamed("export_file", "source")
    if wanted is None:
        raw = raw.join(unknown, ["export_stream", "source", "field"], "left_semi")
    return raw.groupBy("export_stream", "source", "field", "h").agg(F.first("shape").alias("shape"), F.first("structured").alias("structured"), F.first("truth").alias("truth"), F.first("number").alias("number"), F.sum("n").alias("n"))


def pair_likeness(exports: DataFrame, side: DataFrame, most_told: int = MOST_TOLD) -> DataFrame:
    """What ``judged`` asks of every pair (old, new) of a removed and an added field of a file, from all values that ingestion rescues of them.

    ``side`` (export_stream, export_file, source, field, side) names the changed fields and the file that holds their values: an added field is rescued
    from its file under the schema of the file before, a removed one from that file under the schema of this one.
    """
    counted = rescued_values(exports, side.select("export_stream", "source", "field").distinct(), most_told)
    file, of = ["export_stream", "export_file"], ["export_stream", "export_file", "side", "field"]
    values = checkpointed(counted.join(side.select(*of, "source"), ["export_stream", "source", "field"]).drop("source"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    totals = checkpointed(values.groupBy(*of).agg(F.sum("n").alias("n"), F.count("*").alias("d"), total(F.col("truth").isNotNull()).alias("n_truth"), total(F.col("truth")).alias("n_true"), total(F.col("number").isNotNull()).alias("n_number"), total(F.col("structured")).alias("n_structured")))
    half = lambda df, i: df.filter(F.col("side") == ("removed", "added")[i]).drop("side").select(*file, F.col("field").alias(("old", "new")[i]), *(F.col(c).alias(f"{c}{i}") for c in df.columns if c not in of))
    pairs = half(totals, 0).join(half(totals, 1), file)
    pair, sizes = [*file, "old", "new"], pairs.select(*file, "old", "new", "n0", "n1", "d0", "d1")

    def common(key: str) -> DataFrame:
        k = values.groupBy(*of, key).agg(F.sum("n").alias("m"))
        k = half(k, 0).withColumnRenamed(f"{key}0", key).join(half(k, 1).withColumnRenamed(f"{key}1", key), [*file, key])
        return k.join(sizes, pair)

    least = F.sum(F.least(F.col("m0") / F.col("n0"), F.col("m1") / F.col("n1")))
    exact = common("h").groupBy(*pair).agg(least.alias("exact"), F.count("*").alias("shared"), F.sum(F.when(F.col("d0") <= F.col("d1"), F.col("m0") / F.col("n0")).otherwise(F.col("m1") / F.col("n1"))).alias("within"))
    forms = common("shape").groupBy(*pair).agg(least.alias("forms"))
    truths = (F.col("n_truth0") == F.col("n0")) & (F.col("n_truth1") == F.col("n1"))
    numeric = pairs.filter((F.col("n_number0") > 0.8 * F.col("n0")) & (F.col("n_number1") > 0.8 * F.col("n1")) & ~truths).select(*pair, "n_number0", "n_number1")
    numbers = values.filter("number is not null").groupBy(*of, "number").agg(F.sum("n").alias("m"))
    steps = [half(numbers, i).join(numeric, [*file, ("old", "new")[i]]).select(*pair, F.col(f"number{i}").alias("number"), ((1 - 2 * i) * F.col(f"m{i}") / F.col(f"n_number{i}")).alias("step")) for i in (0, 1)]
    climb = steps[0].unionByName(steps[1]).groupBy(*pair, "number").agg(F.sum("step").alias("step"))
    apart = climb.withColumn("apart", F.abs(F.sum("step").over(Window.partitionBy(*pair).orderBy("number").rowsBetween(Window.unboundedPreceding, 0))))
    ks = apart.groupBy(*pair).agg(F.max("apart").alias("ks"))
    return pairs.join(exact, pair, "left").join(forms, pair, "left").join(ks, pair, "left").na.fill(0, ["exact", "shared", "within", "forms"]).na.fill(1.0, ["ks"])


def _changes_of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Renames, and what else came, went or changed its type, from each file's fields and the pairs of them that ``judged`` is asked of."""
    names = ["export_stream", "export_file", "change_kind", "field_name", "old_field_name"]
    for batch in batches:
        out = []
        for file in batch.to_pylist():
            at = file["export_stream"], file["export_file"]
            kind = {(r["side"], r["field"]): r["kind"] for r in file["fields"]}
            found = best_pairs((p["old"], p["new"], *judged(p)) for p in file["pairs"] or ())
            for old, new in found:
                out.append((*at, "renamed", new, old))
                if kind["removed", old] != kind["added", new]:
                    out.append((*at, "retyped", new, old))
            gone = {("removed", p[0]) for p in found} | {("added", p[1]) for p in found}
            out += [(*at, side, f, "") for side, f in kind if (side, f) not in gone]
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=names)


def file_changes(exports: DataFrame) -> DataFrame:
    """(export_stream, export_file, change_kind, field_name, old_field_name) between the consecutive files of each stream.

    Files of a stream go by exported_at, then name. ``renamed`` and also ``retyped`` rows of one field carry the former name; a
    plain ``retyped`` row has ''. Rows with a null stream are a stream of their own; null or unreadable payloads hold no fields; an
    empty table gives no rows. The profile is written once to the checkpoint folder, as four branches read it. Renames are decided by all
    values of the fields that come and go (see ``pair_likeness``), which are read in a second pass over the payloads; all else is files x fields in size.
    """
    prof = checkpointed(field_profiles(exports).withColumn("export_stream", F.coalesce("export_stream", F.lit(""))))
    file = ["export_stream", "export_file"]
    order = Window.partitionBy("export_stream").orderBy("exported_at", "export_file")
    files = prof.groupBy(*file).agg(F.min("exported_at").alias("exported_at")).withColumn("previous", F.lag("export_file").over(order)).withColumn("next", F.lead("export_file").over(order))
    fields = prof.filter("field is not null").select(*file, "field", "kind")
    cur = fields.join(files.filter("previous is not null").select(*file), file)
    old = fields.join(files.filter("next is not null").select(*file, "next"), file).select("export_stream", F.col("next").alias("export_file"), "field", F.col("kind").alias("old_kind"))
    both = cur.join(old, [*file, "field"], "full_outer")
    plain = both.filter("kind <> old_kind").select(*file, F.lit("retyped").alias("change_kind"), F.col("field").alias("field_name"), F.lit("").alias("old_field_name"))
    side = both.filter("kind is null or old_kind is null").select(*file, "field", F.when(F.col("kind").isNull(), "removed").otherwise("added").alias("side"), F.coalesce("kind", "old_kind").alias("kind"))
    side = side.join(files.select(*file, "previous"), file).withColumn("source", F.when(F.col("side") == "removed", F.col("previous")).otherwise(F.col("export_file"))).drop("previous")
    side = checkpointed(side)
    turned = side.groupBy(*file).agg(F.countDistinct("side").alias("n")).filter("n = 2").select(*file)
    pairs = pair_likeness(exports, checkpointed(side.join(turned, file)))
    fields_of = side.groupBy(*file).agg(F.collect_list(F.struct("side", "field", "kind")).alias("fields"))
    pairs_of = pairs.groupBy(*file).agg(F.collect_list(F.struct(*(c for c in pairs.columns if c not in file))).alias("pairs"))
    moved = fields_of.join(pairs_of, file, "left").mapInArrow(_changes_of_files, f"export_stream string, {FOUND}")
    return plain.unionByName(moved)


def found(exports: DataFrame) -> DataFrame:
    c = file_changes(exports)
    return c.select("export_file", "change_kind", "field_name", "old_field_name").distinct()


def _named_once(found: Iterable[tuple[str, object]]) -> Iterator[tuple[str, object]]:
    """Leaves with names of their own: where 'a.b' stands beside {"a": {"b": ...}}, the second is 'a.b#2'."""
    seen: Counter = Counter()
    for k, v in found:
        seen[k] += 1
        yield (k if seen[k] == 1 else f"{k}#{seen[k]}"), v


def _leaf_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("kind", pa.string()), ("text", pa.string())])
    for batch in batches:
        maps, ok = [], []
        for text in batch.column("payload").to_pylist():
            o = _decode(text)
            ok.append(o is not None)
            if o is None:
                maps.append([] if text is None else [("", {"kind": "unreadable", "text": text})])
            else:
                maps.append([(k, {"kind": kind_of(v), "text": _shown(v)}) for k, v in dict(_named_once(leaves(o))).items()])
        keep = [batch.column(c) for c in ("record_id", "export_stream", "export_file", "exported_at")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(ok), pa.array(maps, pa.map_(pa.string(), item))], names=["record_id", "export_stream", "export_file", "exported_at", "readable", "leaves"])


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Canonical names of one stream: the first name of each chain of renames, per file where it differs."""
    now: dict[str, str] = {}
    out = []
    for (_, file), rows in pdf.sort_values(["exported_at", "export_file"]).groupby(["exported_at", "export_file"], sort=False):
        renames = [(r.old_field_name, r.field_name) for r in rows.itertuples() if r.change_kind == "renamed"]
        gone = {r.field_name for r in rows.itertuples() if r.change_kind == "removed"}
        fresh = {new: now.get(old, old) for old, new in renames}
        now = {k: v for k, v in now.items() if k not in gone and k not in {o for o, _ in renames}} | fresh
        out.append((pdf["export_stream"].iloc[0], file, {k: v for k, v in now.items() if k != v}))
    return pd.DataFrame(out, columns=["export_stream", "export_file", "canonical"])


def canonical_names(exports: DataFrame, changes: DataFrame) -> DataFrame:
    """(export_stream, export_file, canonical map<field, first name>) for every file; size files x renamed fields."""
    files = exports.groupBy(F.coalesce("export_stream", F.lit("")).alias("export_stream"), "export_file").agg(F.min("exported_at").alias("exported_at"))
    rows = files.join(changes, ["export_stream", "export_file"], "left").select("export_stream", "export_file", "exported_at", "change_kind", "field_name", "old_field_name")
    return rows.groupBy("export_stream").applyInPandas(_chain, "export_stream string, export_file string, canonical map<string,string>")


def _cast(leaf: Column, want: str) -> Column:
    """A leaf under a target type, null where it doesn't fit: arrays fit array targets only and scalars scalar ones."""
    array = leaf["kind"] == "array"
    if want.startswith("array<"):
        return F.when(array, F.from_json(leaf["text"], want))
    return F.when(~array, leaf["text"] if want == "string" else leaf["text"].try_cast(want))


def ingest(exports: DataFrame, target: dict[str, str], changes: DataFrame | None = None) -> DataFrame:
    """Every record once under the target schema (dotted field -> Spark type), with ``rescued``: JSON of what did not fit.

    Renamed fields arrive under their first name. A leaf that the target does not name, or whose value its type can't take, stays
    in ``rescued`` under its canonical name with its kind, so that nothing is lost; columns are named with '_' for '.'. A payload that can't be
    read is rescued whole, under the empty name. Where two fields of a record lead back to one first name, or that name is there itself,
    one has it and the others keep their own.
    """
    ship(exports.sparkSession)
    maps = exports.select("record_id", "export_stream", "export_file", "exported_at", "payload").mapInArrow(_leaf_maps, LEAVES)
    names = canonical_names(exports, file_changes(exports) if changes is None else changes)
    j = maps.withColumn("stream_key", F.coalesce("export_stream", F.lit(""))).join(names.withColumnRenamed("export_stream", "stream_key"), ["stream_key", "export_file"], "left")
    known = lambda x: F.map_contains_key("leaves", x)
    moved = F.filter(F.map_entries(F.coalesce("canonical", F.create_map().cast("map<string,string>"))), lambda x: known(x["key"]) & ~known(x["value"]))
    first = F.filter(moved, lambda x: ~F.exists(moved, lambda y: (y["value"] == x["value"]) & (y["key"] < x["key"])))
    j = j.withColumn("led", F.map_from_entries(first))
    lead = F.transform(F.map_entries("leaves"), lambda e: F.struct(F.coalesce(F.try_element_at("led", e["key"]), e["key"]).alias("key"), e["value"].alias("value")))
    return _typed(j.withColumn("leaves", F.map_from_entries(lead)), target)


def _typed(j: DataFrame, target: dict[str, str]) -> DataFrame:
    at = lambda f: F.try_element_at(F.col("leaves"), F.lit(f))
    cast = {f: _cast(at(f), want) for f, want in target.items()}
    fits = lambda k: F.coalesce(F.try_element_at(F.create_map(*[x for f in target for x in (F.lit(f), cast[f].isNotNull())]), k), F.lit(False))
    kept = F.map_filter("leaves", lambda k, v: ~fits(k)) if target else F.col("leaves")
    return j.select("record_id", "export_stream", "export_file", "exported_at", "readable", *(cast[f].alias(f.replace(".", "_")) for f in target), F.when(F.size(kept) > 0, F.to_json(kept)).alias("rescued"))


def replay(ingested: DataFrame, promoted: dict[str, str]) -> DataFrame:
    """Promote approved fields: their rescued values move into typed columns, the rest stays rescued. No source is read again."""
    leaf = F.from_json("rescued", "map<string,struct<kind:string,text:string>>")
    j = ingested.withColumn("leaves", F.coalesce(leaf, F.create_map().cast("map<string,struct<kind:string,text:string>>")))
    typed = {f.replace(".", "_"): f for f in promoted}
    at = lambda f: F.try_element_at(F.col("leaves"), F.lit(f))
    cast = {c: _cast(at(f), promoted[f]) for c, f in typed.items()}
    fits = lambda k: F.coalesce(F.try_element_at(F.create_map(*[x for c, f in typed.items() for x in (F.lit(f), cast[c].isNotNull())]), k), F.lit(False))
    kept = F.map_filter("leaves", lambda k, v: ~fits(k))
    return j.select(*(c for c in ingested.columns if c != "rescued" and c not in typed), *(F.coalesce(cast[c], F.col(c)).alias(c) if c in ingested.columns else cast[c].alias(c) for c in typed), F.when(F.size(kept) > 0, F.to_json(kept)).alias("rescued"))


#: The consistent table of the attribution exports (dotted source field -> type).
EXPORT_TARGET = {
    "uuid": "string", "sessionId": "string", "type": "string", "timestamp": "string", "cwd": "string", "model": "string", "blockIndex": "bigint", "length_words": "bigint", "agentSourced": "boolean",
    "attribution.tier": "string", "attribution.file_path": "string", "attribution.proximity_distance": "bigint",
}
