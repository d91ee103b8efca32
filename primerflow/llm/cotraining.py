"""Quality classifier by co-training: two views of a document teach each other.

The text view is a logistic regression on hashed word and character n-grams (``text_model``), the page view one on
page metadata: language, source, length class and their pairs. Both start from up to ``LABELLED`` labelled documents
(half of either class, those with the smallest hashes of their ids, with at most ``FEATURES`` features). In each of
``ROUNDS`` rounds both are fitted and calibrated on labelled rows that fit neither, and score every unlabelled document
in Arrow batches; each then labels those of the whole table of which it is most certain (probability over ``CERTAIN``
for or against, at most ``GIVEN`` per class and round, ties by hash) for the other. Only these come to the driver. Last,
the two calibrated log-odds are combined by a logistic regression on further rows held out (a tenth fits it, a tenth
calibrates), and every document is scored.

Null texts count as empty; null metadata are a value of their own, missing columns are null. Without labels of both
classes every document is kept with a null probability. One row out per row in.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, bytes_of, only, written
from .labelled import Sample, column_or_null, gather, held_out, labelled
from .quality_rules import kept_rows
from .text_model import BITS, Fit, Linear, Parts, Scorer, calibrate, in_parts, sums

LABELLED, ROUNDS, CERTAIN, GIVEN = 4000, 3, 0.98, 200
#: Steps of the first fit of a view, and of each later one, which goes on from there.
FIRST, MORE = 120, 30
THRESHOLD = 0.5
PAGE_BITS = 12
META = ("lang", "source", "n_chars")


def page_places(lang, source, n_chars) -> list[int]:
    """Places of a page's features."""
    size = "none" if n_chars is None else str(int(n_chars).bit_length())
    names = [f"l={lang}", f"s={source}", f"n={size}", f"l={lang},n={size}", f"s={source},n={size}", f"l={lang},s={source}"]
    return [zlib.crc32(n.encode()) % 2**PAGE_BITS for n in names]


@dataclass
class Model:
    """Both views, calibrated, and the weights of their log-odds."""

    text: Linear
    page: Linear
    mix: tuple[float, float, float]

    def probability(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        z = self.mix[0] * self.text.odds(text) + self.mix[1] * self.page.odds(page) + self.mix[2]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class View:
    """One view's features of all sample rows, in the arrays that they came in: those of the sample are not copied."""

    def __init__(self, row: np.ndarray, place: np.ndarray, value: np.ndarray, size: int):
        self.parts: Parts = [(row, place, value)]
        self.size = size
        self.learner: Fit | None = None

    def fit(self, y: np.ndarray, weight: np.ndarray, test: np.ndarray, truth: np.ndarray, test_weight: np.ndarray) -> tuple[Linear, np.ndarray]:
        """The model, and the scores of all rows; ``test`` speaks of the first ones. The first call fits in ``FIRST`` steps;
        further ones, with the labels that have come since, go on for ``MORE``. Rows without weight pull at nothing."""
        steps = MORE if self.learner else FIRST
        self.learner = self.learner or Fit(self.size)
        w = self.learner.run_parts(self.parts, y, weight, steps)
        scores = sum(sums(*p, w, y.size) for p in self.parts)
        return Linear(w, *calibrate(scores[: test.size][test], truth[test], test_weight[test])), scores

    def add(self, first: int, row: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
        """Further rows, numbered from ``first``."""
        self.parts.append((row.astype(np.int32) + first, place, value))


@dataclass
class Found:
    """Documents that one view labels for the other, with the other's features."""

    ids: list[int]
    label: np.ndarray
    row: np.ndarray
    place: np.ndarray
    value: np.ndarray


Search = Callable[[tuple[Linear, Linear], list[list[int]]], dict[int, Found]]


def page_features(meta: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of pages."""
    places = np.array([page_places(*m) for m in meta])
    each = places.shape[1]
    return np.repeat(np.arange(len(meta)), each), places.ravel(), np.full(places.size, 1 / each)


def _mix(odds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weights of the views' log-odds and a shift, by Newton steps; each is drawn to 1, the shift to 0."""
    x, b, prior = np.concatenate([np.clip(odds, -8, 8), np.ones((len(y), 1))], 1), np.array([1.0, 1.0, 0.0]), np.array([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(3), x.T @ (weight * (p - y)) + (b - prior))
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def teach(sample: Sample, known: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, search: Search | None = None) -> Model | None:
    """Co-trains on the rows of ``sample``; ``known`` says which have a label ``y``. ``search`` finds further documents
    by the two models and the ids that either view (text, page) has got."""
    test = known & held_out(sample.ids)
    learn = known & ~test
    if not all(0 < y[part].sum() < part.sum() for part in (test, learn)):
        test = learn = known
    if not 0 < y[known].sum() < known.sum():
        return None
    mixed = test & held_out(sample.ids, 1, 2)  # rows that neither fit nor calibrate a view
    sure_of = test & ~mixed
    if not all(0 < y[part].sum() < part.sum() for part in (mixed, sure_of)):
        mixed = sure_of = test
    page = page_features(list(zip(*(sample.extra[c] for c in META))))
    views = [View(sample.row, sample.place, sample.value, 2**BITS), View(*page, 2**PAGE_BITS)]
    labels = [np.where(learn, y, 0.0) for _ in views]
    weights = [np.where(learn, weight, 0.0) for _ in views]
    taken: list[list[int]] = [[], []]
    for turn in range(rounds + 1):
        models, scores = zip(*(v.fit(l, w, sure_of, y, weight) for v, l, w in zip(views, labels, weights)))
        if turn == rounds:
            break
        for teacher, pupil in ((0, 1), (1, 0)):
            p = models[teacher].probability(scores[teacher][: y.size])
            for good in (0, 1):
                sure = p if good else 1 - p
                free = np.flatnonzero(~known & (weights[pupil][: y.size] == 0) & (sure >= CERTAIN))
                give = free[np.argsort(-sure[free], kind="stable")[:GIVEN]]
                labels[pupil][give], weights[pupil][give] = good, 1.0
        found = search(models, taken) if search else {}
        for pupil, new in found.items():
            views[pupil].add(labels[pupil].size, new.row, new.place, new.value)
            labels[pupil] = np.concatenate([labels[pupil], new.label])
            weights[pupil] = np.concatenate([weights[pupil], np.ones(new.label.size)])
            taken[pupil] += new.ids
        if search and not found:
            break  # a further round would be the same
    odds = np.stack([m.odds(s[: y.size]) for m, s in zip(models, scores)], 1)
    return Model(*models, _mix(odds[mixed], y[mixed], weight[mixed]))


def searched(docs: DataFrame, labels: DataFrame) -> Search:
    """Finds documents among all without a label. Only ids, probabilities and metadata are written or shuffled."""
    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text", *[column_or_null(docs, c).alias(c) for c in META])

    def search(models: tuple[Linear, Linear], taken: list[list[int]]) -> dict[int, Found]:
        scored = score(named, Model(*models, (1.0, 1.0, 0.0)), THRESHOLD, *META).select("doc_id", "p_text", "p_page", *META)
        scored = written(scored.where(F.greatest("p_text", "p_page", 1 - F.col("p_text"), 1 - F.col("p_page")) >= CERTAIN).join(only(labels, "doc_id"), "doc_id", "left_anti"), "scored")
        parts = []
        for pupil, p in ((1, "p_text"), (0, "p_page")):
            free = scored.where(~F.col("doc_id").isin(taken[pupil]))
            for good in (0, 1):
                sure = F.col(p) if good else 1 - F.col(p)
                best = free.where(sure >= CERTAIN).orderBy(sure.desc(), F.xxhash64("doc_id"), "doc_id").limit(GIVEN)
                parts.append(best.select("doc_id", *META, F.lit(pupil).alias("pupil"), F.lit(good).alias("quality")))
        rows: list[dict] = [{}, {}]
        for r in reduce(DataFrame.unionByName, parts).collect():
            rows[r["pupil"]].setdefault(r["doc_id"], r)
        out = {}
        if rows[0]:
            chosen = docs.sparkSession.createDataFrame([(i, r["quality"]) for i, r in rows[0].items()], "doc_id long, quality int")
            s = gather(named, chosen)
            out[0] = Found(s.ids.tolist(), np.array(s.extra["quality"], float), s.row, s.place, s.value)
        if rows[1]:
            given = list(rows[1].values())
            out[1] = Found(list(rows[1]), np.array([r["quality"] for r in given], float), *page_features([tuple(r[c] for c in META) for r in given]))
        return out

    return search


def train(docs: DataFrame, labels: DataFrame, size: int = LABELLED) -> Model | None:
    sample = gather(docs, labelled(docs, labels, size), *META)
    y = np.array(sample.extra["quality"], float)
    return teach(sample, np.ones(y.size, bool), y, np.array(sample.extra["weight"], float), search=searched(docs, labels)) if y.size else None


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, *carried: str) -> DataFrame:
    """doc_id, p_text, p_page, probability, kept, and carried columns, of every document."""
    own = docs.select("doc_id", "text", *[column_or_null(docs, c).alias(c) for c in META], *[F.col(f"`{c}`").alias(f"__carried_{k}") for k, c in enumerate(carried) if c != "text"])
    kinds = dict(docs.dtypes)
    light = Model(Linear(model.text.weights.astype(np.float32), model.text.slope, model.text.shift), model.page, model.mix) if model else None

    scorers: list[Scorer] = []  # made by the task, whose own copy of the list this is

    def run(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": batch.column(0)} | {c: batch.column(batch.schema.get_field_index("text" if c == "text" else f"__carried_{k}")) for k, c in enumerate(carried)}
        n = batch.num_rows
        if not light:
            return out | {"p_text": [None] * n, "p_page": [None] * n, "probability": [None] * n, "kept": [True] * n}
        if not scorers:
            scorers.append(Scorer(light.text.weights))
        text = np.concatenate([scorers[0].scores(part) for _, part in in_parts(bytes_of(batch.column(1)))])
        memo: dict[tuple, float] = {}
        page = np.zeros(n)
        for k, m in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
            if m not in memo:
                memo[m] = light.page.weights[page_places(*m)].mean()
            page[k] = memo[m]
        p = light.probability(text, page)
        return out | {"p_text": light.text.probability(text), "p_page": light.page.probability(page), "probability": p, "kept": p >= threshold}

    schema = "doc_id long, p_text double, p_page double, probability double, kept boolean" + "".join(f", `{c}` {kinds[c]}" for c in carried)
    return by_batch(own, run, schema)


def keep(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    return kept_rows(docs, lambda own, names: score(own, model, threshold, *names))
