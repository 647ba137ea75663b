"""Consensus of several annotators' labels by a community confusion model, fitted by variational updates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.runtime import checkpointed, looked_up

#: Scores run from 0 to CLASSES - 1.
CLASSES = 4
#: Raters whose matrices are broadcast (16 doubles each, so 3 MB) and whose counts come to the driver each round; with more, both stay tables.
MAX_BROADCAST_RATERS = 20_000
ROUNDS, TOLERANCE = 40, 1e-3


def _digamma(x: np.ndarray) -> np.ndarray:
    x, shift = np.array(x, float), 0.0
    for _ in range(6):
        shift = shift - np.where(x < 6, 1 / x, 0)
        x = np.where(x < 6, x + 1, x)
    i = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def prototypes(k: int = CLASSES) -> np.ndarray:
    """First guesses of the annotator types: careful, fair, one too high, one too low, cautious (towards the middle), reversed, uninformative."""
    s = np.arange(k)
    near = lambda at, width: np.exp(-np.abs(s[None, :] - np.clip(at, 0, k - 1)[:, None]) / width)
    kinds = [near(s, 0.35), near(s, 0.9), near(s + 0.75, 0.5), near(s - 0.75, 0.5), near((s + (k - 1) / 2) / 2, 0.6), near(k - 1 - s, 0.5), np.ones((k, k))]
    return np.stack([m / m.sum(1, keepdims=True) for m in kinds])


@dataclass
class Model:
    """Shared matrices of the communities, their shares and the classes' shares; ``strength`` counts as labels per row of a matrix."""

    communities: np.ndarray = field(default_factory=prototypes)
    shares: np.ndarray = field(default_factory=lambda: np.full(len(prototypes()), 1 / len(prototypes())))
    prior: np.ndarray = field(default_factory=lambda: np.full(CLASSES, 1 / CLASSES))
    strength: float = 4.0
    hold: float = 12.0

    def raters(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(type responsibilities, expected log matrices, mean matrices) for expected counts [raters, true, given]."""
        a = self.strength * self.communities[None]
        n = counts[:, None]
        fit = (_lgamma(a.sum(-1)) - _lgamma((a + n).sum(-1)) + (_lgamma(a + n) - _lgamma(a)).sum(-1)).sum(-1) + np.log(self.shares)
        fit -= fit.max(1, keepdims=True)
        r = np.exp(fit)
        r /= r.sum(1, keepdims=True)
        post = counts + self.strength * np.einsum("wc,ckl->wkl", r, self.communities)
        return r, _digamma(post) - _digamma(post.sum(-1, keepdims=True)), post / post.sum(-1, keepdims=True)

    def update(self, pooled: np.ndarray, sizes: np.ndarray, classes: np.ndarray) -> float:
        """New shared matrices from the counts pooled by type, with the first guesses as prior; returns the largest change."""
        new = pooled + self.hold * prototypes()
        new /= new.sum(-1, keepdims=True)
        change = float(np.abs(new - self.communities).max())
        self.communities, self.shares = new, (sizes + 1) / (sizes + 1).sum()
        self.prior = (classes + 1) / (classes + 1).sum()
        return change


def _units(labels: DataFrame) -> DataFrame:
    """One row a unit: its raters' numbers and their scores; a rater labels a unit once, so a row is no longer than the raters."""
    return labels.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("rater_no", "label"))).alias("x")).select("unit", F.col("x.rater_no").alias("raters"), F.col("x.label").alias("labels"))


def _posterior(offsets: np.ndarray, rater: np.ndarray, label: np.ndarray, log_matrix: np.ndarray, log_prior: np.ndarray) -> np.ndarray:
    parts = log_matrix[rater, :, label]
    ll = np.add.reduceat(parts, offsets[:-1], axis=0) + log_prior
    ll -= ll.max(1, keepdims=True)
    t = np.exp(ll)
    return t / t.sum(1, keepdims=True)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, x = batch.column("raters"), batch.column("labels")
    off = r.offsets.to_numpy()
    return off - off[0], r.flatten().to_numpy(), x.flatten().to_numpy()


@dataclass
class Fitted:
    """What a fit gives: posteriors per unit, reliability per rater, the shared matrices and the rounds taken."""

    units: DataFrame
    raters: DataFrame
    model: Model
    rounds: int


def _rater_rows(names: list, r: np.ndarray, mean: np.ndarray, n: np.ndarray, prior: np.ndarray) -> pd.DataFrame:
    """Reliability: expected exact agreement with the truth, mean shift, and information given (bits), under the class shares."""
    joint = prior[None, :, None] * mean
    given = joint.sum(1, keepdims=True)
    bits = (joint * np.log2(mean / given)).sum((1, 2))
    s = np.arange(mean.shape[1])
    return pd.DataFrame(
        {"rater": names, "n_labels": n.astype(np.int64), "accuracy": np.einsum("wkk,k->w", mean, prior), "bias": (joint * (s[None, None, :] - s[None, :, None])).sum((1, 2)), "information_bits": bits, "community": r.argmax(1).astype(np.int32), "community_probability": r.max(1), "confusion": [m.ravel().tolist() for m in mean]}
    )


_RATER = "rater string, n_labels bigint, accuracy double, bias double, information_bits double, community int, community_probability double, confusion array<double>"
_UNIT = "unit string, label int, probability double, posterior array<double>, n_raters int"


def fit(labels: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE, max_broadcast: int = MAX_BROADCAST_RATERS) -> Fitted:
    """Fit on (unit, rater, label): strings and INT 0..3, one row for each unit and rater.

    Each rater has an own confusion matrix drawn around one of seven shared ones (the communities), so a rater with few labels is
    judged mostly by type. Updates alternate: units' posteriors from the expected log matrices; raters' expected counts; each
    rater's type and matrix; the shared matrices, pooled over all raters. A round is one pass over the units, kept with their
    labels in the shared folder, and brings raters x 16 sums to the driver while there are at most ``max_broadcast`` raters;
    with more, matrices stay distributed and join the labels. No labels give no units.
    """
    names = checkpointed(labels.groupBy("rater").agg(F.count("*").alias("n")))
    total = names.count()
    if total > max_broadcast:
        return _fit_joined(labels, names, rounds, tolerance)
    listed = names.orderBy("rater").collect()
    spark = labels.sparkSession
    numbers = spark.createDataFrame([(x.rater, i) for i, x in enumerate(listed)], "rater string, rater_no int")
    units = checkpointed(_units(labels.join(F.broadcast(numbers), "rater").select("unit", "rater_no", "label")))
    model, n_raters = Model(), len(listed)
    counts = np.zeros((n_raters, CLASSES, CLASSES))
    _, log_matrix, _ = model.raters(counts)
    # the first pass starts from careful readers: with no counts, all raters' matrices are the mean of the types
    done = 0
    for done in range(1, rounds + 1 if n_raters else 1):
        sent = spark.sparkContext.broadcast((log_matrix, np.log(model.prior)))

        def step(batches: Iterator[pa.RecordBatch], sent=sent, n_raters=n_raters) -> Iterator[pa.RecordBatch]:
            matrix, log_prior = sent.value
            sums = np.zeros((n_raters, CLASSES, CLASSES))
            classes = np.zeros(CLASSES)
            for batch in batches:
                if batch.num_rows:
                    off, rater, label = _flat(batch)
                    t = _posterior(off, rater, label, matrix, log_prior)
                    np.add.at(sums, (rater, slice(None), label), np.repeat(t, np.diff(off), axis=0))
                    classes += t.sum(0)
            cells = np.append(sums.ravel(), classes)
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], names=["cell", "v"])

        got = units.mapInArrow(step, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
        sent.unpersist()
        cells = np.zeros(n_raters * CLASSES**2 + CLASSES)
        cells[got["cell"].to_numpy(np.int64)] = got["v"].to_numpy()
        new, classes = cells[:-CLASSES].reshape(n_raters, CLASSES, CLASSES), cells[-CLASSES:]
        moved = float(np.abs(new - counts).sum() / max(1.0, new.sum()))
        counts = new
        r, _, _ = model.raters(counts)
        model.update(np.einsum("wc,wkl->ckl", r, counts), r.sum(0), classes)
        r, log_matrix, mean = model.raters(counts)
        if moved < tolerance:
            break
    final = spark.sparkContext.broadcast((log_matrix, np.log(model.prior)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, log_prior = final.value
        for batch in batches:
            if batch.num_rows:
                off, rater, label = _flat(batch)
                t = _posterior(off, rater, label, matrix, log_prior)
                yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(t.argmax(1).astype(np.int32)), pa.array(t.max(1)), pa.array(list(t), pa.list_(pa.float64())), pa.array(np.diff(off).astype(np.int32))], names=["unit", "label", "probability", "posterior", "n_raters"])

    rows = _rater_rows([x.rater for x in listed], r, mean, np.array([x.n for x in listed]), model.prior) if n_raters else pd.DataFrame(columns=[c.split()[0] for c in _RATER.split(", ")])
    return Fitted(units.mapInArrow(judge, _UNIT), spark.createDataFrame(rows, _RATER) if n_raters else spark.createDataFrame([], _RATER), model, done)


def _moved(counts: DataFrame, former: DataFrame) -> float:
    """Movement of the raters' counts relative to their sum: what ends the rounds, however many raters there are."""
    both = counts.join(former.select("rater", F.col("counts").alias("old")), "rater", "left")
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    old = F.coalesce("old", F.transform("counts", lambda x: F.lit(0.0)))
    got = both.agg(F.sum(add(F.zip_with("counts", old, lambda x, y: F.abs(x - y)))), F.sum(add(F.col("counts")))).first()
    return float(got[0] / max(1.0, got[1])) if got[0] is not None else 0.0


def _fit_joined(labels: DataFrame, names: DataFrame, rounds: int, tolerance: float) -> Fitted:
    """The same updates with the raters' matrices as a table of their own, for more raters than may be broadcast."""
    labels, model = checkpointed(labels.select("unit", "rater", "label")), Model()
    _, start, _ = model.raters(np.zeros((1, CLASSES, CLASSES)))
    params = names.select("rater", F.lit(None).cast("array<double>").alias("counts"), F.array(*map(F.lit, start.ravel().tolist())).alias("log_matrix"))

    def posteriors(params: DataFrame) -> DataFrame:
        seen = looked_up(labels, params.select("rater", "log_matrix"), ["rater"], most=0)
        at = lambda k: F.sum(F.element_at("log_matrix", F.col("label") + k * CLASSES + 1)) + F.lit(float(np.log(model.prior[k])))
        ll = seen.groupBy("unit").agg(F.array(*map(at, range(CLASSES))).alias("ll"), F.count("*").cast("int").alias("n_raters"))
        e = F.transform("ll", lambda x: F.exp(x - F.array_max("ll")))
        return ll.select("unit", "n_raters", F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y)).alias("posterior"))

    def matrices(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                c = np.array(pdf["counts"].to_list()).reshape(-1, CLASSES, CLASSES)
                r, log_matrix, mean = model.raters(c)
                yield pd.DataFrame({"rater": pdf["rater"], "counts": list(c.reshape(len(c), -1)), "log_matrix": list(log_matrix.reshape(len(c), -1)), "r": list(r), "mean": list(mean.reshape(len(c), -1))})

    shape, done = "rater string, counts array<double>, log_matrix array<double>, r array<double>, mean array<double>", 0
    for done in range(1, rounds + 1):
        post = checkpointed(posteriors(params))
        pair = labels.join(post, "unit")
        counts = checkpointed(pair.groupBy("rater").agg(F.array(*(F.sum(F.when(F.col("label") == x, F.element_at("posterior", k + 1)).otherwise(0.0)) for k in range(CLASSES) for x in range(CLASSES))).alias("counts")))
        moved = _moved(counts, params)
        classes = np.array(post.select(*(F.sum(F.element_at("posterior", k + 1)) for k in range(CLASSES))).first(), float)
        fitted = counts.mapInPandas(lambda b, m=model: matrices(b, m), shape)
        n = len(model.shares)
        sums = fitted.select(*(F.sum(F.element_at("r", c + 1)) for c in range(n)), *(F.sum(F.element_at("r", c + 1) * F.element_at("counts", i + 1)) for c in range(n) for i in range(CLASSES**2))).first()
        model.update(np.array(sums[n:], float).reshape(n, CLASSES, CLASSES), np.array(sums[:n], float), classes)
        params = checkpointed(counts.mapInPandas(lambda b, m=Model(model.communities, model.shares, model.prior): matrices(b, m), shape))
        if moved < tolerance:
            break
    post = posteriors(params)
    best = F.array_position("posterior", F.array_max("posterior")).cast("int") - 1
    prior = model.prior
    rows = lambda batches: (_rater_rows(p["rater"].to_list(), np.array(p["r"].to_list()), np.array(p["mean"].to_list()).reshape(-1, CLASSES, CLASSES), p["n"].to_numpy(), prior) for p in batches if len(p))
    return Fitted(post.select("unit", best.alias("label"), F.array_max("posterior").alias("probability"), "posterior", "n_raters"), params.join(names, "rater").mapInPandas(rows, _RATER), model, done)


def agreement(labels: DataFrame) -> DataFrame:
    """One row: Krippendorff's alpha (nominal and interval), units and labels that can be paired, and the share of agreeing pairs."""
    per = labels.groupBy("unit").agg(*(F.count_if(F.col("label") == k).cast("double").alias(f"c{k}") for k in range(CLASSES)), F.count("*").cast("double").alias("m")).filter("m >= 2")
    pair = {(a, b): F.sum(F.col(f"c{a}") * (F.col(f"c{b}") - (1 if a == b else 0)) / (F.col("m") - 1)) for a in range(CLASSES) for b in range(CLASSES)}
    o = per.agg(*(e.alias(f"o{a}{b}") for (a, b), e in pair.items()), F.count("*").alias("n_units"), F.coalesce(F.sum("m"), F.lit(0.0)).alias("n"))
    mass = {a: sum((F.col(f"o{a}{b}") for b in range(CLASSES)), F.lit(0.0)) for a in range(CLASSES)}

    def alpha(distance) -> F.Column:
        seen = sum((F.col(f"o{a}{b}") * distance(a, b) for a in range(CLASSES) for b in range(CLASSES)), F.lit(0.0))
        chance = sum((mass[a] * mass[b] * distance(a, b) for a in range(CLASSES) for b in range(CLASSES)), F.lit(0.0))
        return F.lit(1.0) - F.try_divide((F.col("n") - 1) * seen, chance)

    return o.select(
        "n_units", F.col("n").cast("bigint").alias("n_labels"), F.try_divide(sum((F.col(f"o{a}{a}") for a in range(CLASSES)), F.lit(0.0)), F.col("n")).alias("pair_agreement"), alpha(lambda a, b: float(a != b)).alias("alpha_nominal"), alpha(lambda a, b: float((a - b) ** 2)).alias("alpha_interval")
    )


def score_labels(attempts: DataFrame, pass1: DataFrame, relabels: DataFrame) -> DataFrame:
    """(session_id, block_index, unit, rater, label) of all raters: each judge pass's first valid attempt, v1-pass1 and people, once a unit.

    Scores outside 0-3 and rows without session, block or rater are no labels; of repeated rows with different scores the least counts.
    """
    key = ["session_id", "block_index"]
    ok = F.col("label").between(0, CLASSES - 1)
    a = attempts.filter("valid").select(*key, F.col("pass_id").alias("rater"), F.col("score").alias("label"), "attempt").filter(ok)
    a = a.groupBy(*key, "rater").agg(F.min_by("label", F.struct("attempt", "label")).alias("label"))
    p = pass1.select(*key, F.lit("v1-pass1").alias("rater"), F.col("score").alias("label"))
    h = relabels.select(*key, F.col("rater_id").alias("rater"), F.col("relabel_score").alias("label"))
    rest = p.unionByName(h).filter(ok).groupBy(*key, "rater").agg(F.min("label").alias("label"))
    both = a.unionByName(rest).dropna(subset=[*key, "rater"])
    return both.select(*key, F.concat_ws("\t", F.col("block_index").cast("string"), "session_id").alias("unit"), "rater", F.col("label").cast("int").alias("label"))


def by_unit(units: DataFrame) -> DataFrame:
    cut = F.split("unit", "\t", 2)
    return units.select(cut[1].alias("session_id"), cut[0].cast("int").alias("block_index"), F.col("label").alias("score"), "probability", "posterior", "n_raters")
