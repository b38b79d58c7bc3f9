"""Problem 3: consensus of several answerers by a community confusion model.

Every answerer belongs, with a probability, to one of a few types; a type shares one
confusion matrix. An answerer's own matrix is its type's matrix as a prior plus its
own counts, so that one with few answers is judged like its type. All posteriors
follow from variational updates. One update is one pass over the grouped answers:
tasks sum expected counts (answerers x levels x answers numbers), the driver only
sees those sums. Items never leave the executors.

Defined results: only the latest answer per item and answerer counts (of equal times
the largest text; a null time is earliest); an answer that is no number in range is
none; items without a valid answer are not in the output; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import materialise, table

#: Number words of answers.
WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5}
NUMBER = r'^"?\s*(?:y\d\s*[:=]\s*)?(-?\d+(?:\.\d+)?)\s*(?:%|(?:/|out of|of)\s*(\d+))?\s*"?$'


def number(answer: Column, low: int, high: int) -> Column:
    """The answer's number if some notation gives one within low..high, else null."""
    text = F.lower(F.trim(F.regexp_replace(answer, r"(?U)\s+", " ")))
    words = F.create_map(*(x for w, v in WORDS.items() for x in (F.lit(w), F.lit(float(v)))))
    # The pattern's second group is what the number is out of; only the range's upper end is a notation.
    value = F.regexp_extract(F.regexp_replace(text, NUMBER, "$1#$2"), rf"^(-?\d+(?:\.\d+)?)#(?:{high})?$", 1)
    plain = F.coalesce(F.nullif(value, F.lit("")).try_cast("double"), F.try_element_at(words, text))
    # A filter over one element keeps the number from being worked out twice.
    return F.get(F.filter(F.array(plain), lambda x: x.between(low, high)), F.lit(0))


@dataclass(frozen=True)
class Field:
    """A field: its range, the levels answers fall into, and each level's label.

    `edges` are the upper ends of the levels; `labels` the label of each level.
    """

    name: str
    low: int
    high: int
    edges: tuple[float, ...]
    labels: tuple[int, ...]

    def level(self, value: Column) -> Column:
        """0-based level of a number; null stays null."""
        return sum((value > e).cast("int") for e in self.edges[:-1])


Y4 = Field("y4", 1, 5, (1.5, 2.5, 3.5, 4.5, 5.0), (1, 2, 3, 4, 5))
Y2 = Field("y2", 0, 100, (33.5, 66.5, 100), (0, 1, 2))
FIELDS = (Y4, Y2)


@dataclass
class Model:
    """Variational state of one field; `counts` are expected (answerer, true level, answer) counts."""

    levels: int
    types: int = 4
    prior_type: float = 8.0
    strength: float = 20.0
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: np.ndarray = field(default_factory=lambda: np.zeros(0))
    belongs: np.ndarray = field(default_factory=lambda: np.zeros(0))
    log_theta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    log_prior: np.ndarray = field(default_factory=lambda: np.zeros(0))
    converged: bool = False

    def start(self, answerers: int) -> None:
        k = self.levels
        near = np.exp(-1.5 * np.abs(np.subtract.outer(np.arange(k), np.arange(k))))
        self.counts = np.tile(near / near.sum(1, keepdims=True) * 10, (answerers, 1, 1))
        self.prior = np.ones(k)
        self.belongs = np.full((answerers, self.types), 1 / self.types)
        self.log_theta = _log_mean(self.counts + 0.1)
        self.log_prior = np.log(np.full(k, 1 / k))

    def update(self, counts: np.ndarray, prior: np.ndarray) -> float:
        """One variational update from the expected counts of a pass; returns how far the matrices moved."""
        n, k = len(counts), self.levels
        self.counts, self.prior = counts, prior
        near = np.exp(-1.5 * np.abs(np.subtract.outer(np.arange(k), np.arange(k))))
        base = near / near.sum(1, keepdims=True) * self.prior_type
        if not self.belongs.any() or np.allclose(self.belongs, 1 / self.types):
            # Types start from answerers spread by how often they confirm the estimate.
            hit = np.array([np.trace(c) / max(c.sum(), 1e-9) for c in counts])
            order = np.argsort(np.argsort(-hit, kind="stable"), kind="stable")
            self.belongs = np.full((n, self.types), 0.1 / self.types)
            self.belongs[np.arange(n), order * self.types // max(n, 1)] += 0.9
        for _ in range(5):
            shared = base + np.einsum("am,akl->mkl", self.belongs, counts)
            weight = _log_mean(1.0 + self.belongs.sum(0))
            score = weight + np.einsum("akl,mkl->am", counts, _log_mean(shared))
            score -= score.max(1, keepdims=True)
            self.belongs = np.exp(score) / np.exp(score).sum(1, keepdims=True)
        mean = shared / shared.sum(2, keepdims=True)
        own = counts + self.strength * np.einsum("am,mkl->akl", self.belongs, mean)
        new = _log_mean(own + 1e-3)
        moved = float(np.abs(np.exp(new) - np.exp(self.log_theta)).max())
        self.log_theta, self.log_prior = new, _log_mean(prior + 1.0)
        return moved


def _log_mean(counts: np.ndarray) -> np.ndarray:
    """E[log p] under Dirichlet(counts) along the last axis."""
    return _digamma(counts) - _digamma(counts.sum(-1, keepdims=True))


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out -= np.where(low, 1 / x, 0)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def latest_answers(df: DataFrame) -> DataFrame:
    """(id, llm, y2, y4) of the latest row per item and answerer, by a combining aggregate."""
    order = F.struct("answered_at", "y2", "y4")
    keyed = df.filter(F.col("id").isNotNull() & F.col("llm").isNotNull())
    return keyed.groupBy("id", "llm").agg(F.max_by(F.struct("y2", "y4"), order).alias("a")).select("id", "llm", "a.y2", "a.y4")


def grouped(df: DataFrame, names: list[str], fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """One row per item and field with its valid answers: (id, field, who array, what array)."""
    index = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("llm")) - 1
    numbers = [F.struct(F.lit(i).alias("field"), number(F.col(f.name), f.low, f.high).alias("value")) for i, f in enumerate(fields)]
    valid = df.select("id", index.cast("int").alias("who"), F.explode(F.array(*numbers)).alias("v")).filter(F.col("v.value").isNotNull())
    field, value = F.col("v.field"), F.col("v.value")
    level = F.coalesce(*(F.when(field == i, f.level(value)) for i, f in enumerate(fields)))
    rows = valid.select("id", "who", field.alias("field"), level.alias("what"))
    return (
        rows.groupBy("id", "field")
        .agg(F.sort_array(F.collect_list(F.struct("who", "what"))).alias("a"))
        .select("id", "field", F.col("a.who").alias("who"), F.col("a.what").alias("what"))
    )


def _posterior(model: Model, who: np.ndarray, what: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Posterior of the true level of each item of a ragged batch."""
    n = len(offsets) - 1
    item = np.repeat(np.arange(n), np.diff(offsets))
    score = np.tile(model.log_prior, (n, 1))
    np.add.at(score, item, model.log_theta[who, :, what])
    score -= score.max(1, keepdims=True)
    p = np.exp(score)
    return p / p.sum(1, keepdims=True)


def _ragged(batch: pa.RecordBatch, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    taken = batch.filter(pa.array(pick))
    who, what = taken.column("who"), taken.column("what")
    offsets = np.asarray(who.offsets)
    flat = lambda a: np.asarray(a.flatten())
    return flat(who), flat(what), offsets - offsets[0]


def fit(items: DataFrame, answerers: int, fields: tuple[Field, ...] = FIELDS, rounds: int = 12, enough: float = 2e-3) -> list[Model]:
    """Variational fit; each round is one job whose result is one row of sums per task and field.

    `converged` of a model says whether the last round moved no probability by `enough`.
    """
    models = [Model(len(f.edges)) for f in fields]
    for m in models:
        m.start(answerers)
    for _ in range(rounds if answerers else 0):

        def step(batches: Iterator[pa.RecordBatch], models: list[Model] = models) -> Iterator[pa.RecordBatch]:
            sums = [(np.zeros((answerers, m.levels, m.levels)), np.zeros(m.levels)) for m in models]
            for batch in batches:
                kind = np.asarray(batch.column("field"))
                for i, m in enumerate(models):
                    who, what, offsets = _ragged(batch, kind == i)
                    if len(offsets) > 1:
                        p = _posterior(m, who, what, offsets)
                        each = np.repeat(p, np.diff(offsets), axis=0)
                        np.add.at(sums[i][0].transpose(0, 2, 1), (who, what), each)
                        sums[i][1][:] += p.sum(0)
            parts = [(i, np.concatenate([c.ravel(), p])) for i, (c, p) in enumerate(sums)]
            for i, flat in parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(flat), pa.int32()), pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["field", "cell", "value"]
                )

        sums = items.mapInArrow(step, "field int, cell int, value double").groupBy("field", "cell").agg(F.sum("value").alias("value")).toPandas()
        moved = 0.0
        for i, m in enumerate(models):
            own = sums[sums.field == i].sort_values("cell").value.to_numpy()
            if len(own):
                k = m.levels
                moved = max(moved, m.update(own[:-k].reshape(answerers, k, k), own[-k:]))
        for m in models:
            m.converged = moved < enough
        if moved < enough:
            break
    return models


def consensus(items: DataFrame, models: list[Model], fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """(id, field, label, confidence, agreement, n_answers, differ) of each item and field.

    `agreement` is the share of answers whose label is the consensus; `differ` says
    whether the answers' labels are not all equal.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = np.asarray(batch.column("field"))
            for i, (f, m) in enumerate(zip(fields, models)):
                pick = kind == i
                who, what, offsets = _ragged(batch, pick)
                if len(offsets) < 2:
                    continue
                of = np.asarray(f.labels)
                distinct = np.unique(of)
                p = _posterior(m, who, what, offsets) @ (of[:, None] == distinct)
                best = distinct[p.argmax(1)]
                n = np.diff(offsets)
                got = of[what]
                same = np.add.reduceat((got == np.repeat(best, n)).astype(float), offsets[:-1]) / n
                differ = np.maximum.reduceat(got, offsets[:-1]) != np.minimum.reduceat(got, offsets[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").filter(pa.array(pick)), pa.array([f.name] * len(n)), pa.array(best, pa.int32()), pa.array(p.max(1)), pa.array(same), pa.array(n, pa.int32()), pa.array(differ)],
                    ["id", "field", "label", "confidence", "agreement", "n_answers", "differ"],
                )

    return items.mapInArrow(label, "id string, field string, label int, confidence double, agreement double, n_answers int, differ boolean")


def run(answers: DataFrame, fields: tuple[Field, ...] = FIELDS, max_answerers: int = 10_000) -> tuple[DataFrame, list[Model], list[str]]:
    """Items, fitted models and the answerers' names. Names are few by nature; more than the bound is an error."""
    latest = latest_answers(answers)
    names = [r[0] for r in answers.select("llm").distinct().filter("llm IS NOT NULL").orderBy("llm").limit(max_answerers + 1).collect()]
    if len(names) > max_answerers:
        raise ValueError(f"more than {max_answerers} answerers")
    items = materialise(grouped(latest, names, fields), "p3")
    return items, fit(items, len(names), fields), names


def p3_consensus(spark, sf_dir):
    items, models, _ = run(table(spark, sf_dir, "report_analysis"))
    return consensus(items, models).drop("differ")


def p3_found(spark, sf_dir):
    items, models, _ = run(table(spark, sf_dir, "report_analysis"))
    return consensus(items, models).filter("n_answers >= 3 AND differ").select("id", "field", "label")


def reliability(models: list[Model], names: list[str], fields: tuple[Field, ...] = FIELDS) -> list[tuple]:
    """(llm, field, expected answers, probability of a right label, type, its probability, converged) per answerer and field."""
    rows = []
    for f, m in zip(fields, models):
        of = np.asarray(f.labels)
        theta = np.exp(m.log_theta)
        theta /= theta.sum(-1, keepdims=True)
        right = (theta * (of[:, None] == of[None, :])).sum(-1)
        share = m.prior / max(m.prior.sum(), 1e-9)
        for a, name in enumerate(names):
            t = int(m.belongs[a].argmax())
            rows.append((name, f.name, float(m.counts[a].sum()), float(right[a] @ share), t, float(m.belongs[a, t]), m.converged))
    return rows


def p3_reliability(spark, sf_dir):
    _, models, names = run(table(spark, sf_dir, "report_analysis"))
    return spark.createDataFrame(reliability(models, names), "llm string, field string, n_answers double, reliability double, type int, type_probability double, converged boolean")
