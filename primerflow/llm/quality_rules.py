"""Quality rules: measures of a text, and a calibrated n-gram classifier, against fixed thresholds.

The classifier is a logistic regression on hashed word and character n-grams (``text_model``), fitted on up to
``SAMPLE`` labelled documents (half of either class, those with the smallest hash of their id) and ``FEATURES``
features of them, weighted to the class frequencies of all labelled documents and calibrated on a fifth that it has not seen. Documents are scored in Arrow batches;
what is sent to the executors is one weight for each of ``2**BITS`` places.

A null text counts as empty: no words, so the base rules reject it. Without labels of both classes the verdict
is that of the base rules alone. One row out per row in, null and repeated ids included. A task holds the places of one
text's words, or of as many short texts as have about 16,000 words, so memory follows the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, texts_of
from .labelled import Sample, gather, held_out, labelled
from .text_model import BITS, Linear, Words, calibrate, fit, in_parts, sums

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 4000
#: A document stays if its probability of good quality is at least this.
THRESHOLD = 0.5
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def fit_sample(sample: Sample, y: np.ndarray, weight: np.ndarray) -> Linear | None:
    """Fitted on four fifths, calibrated on the rest; with too few of the rest, on all. None without both classes."""
    if not sample.ids.size or not 0 < y.sum() < y.size:
        return None
    out = held_out(sample.ids)
    if not (0 < y[out].sum() < out.sum() and 0 < y[~out].sum() < (~out).sum()):
        out[:] = False
    weights = fit(sample.row, sample.place, sample.value, y, np.where(out, 0, weight), 2**BITS)  # rows without weight pull at nothing
    scores = sums(sample.row, sample.place, sample.value, weights, y.size)
    test = out if out.any() else ~out
    return Linear(weights.astype(np.float32).astype(float), *calibrate(scores[test], y[test], weight[test]))


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Linear | None:
    sample = gather(docs, labelled(docs, labels, size))
    return fit_sample(sample, np.array(sample.extra["quality"], float), np.array(sample.extra["weight"], float))


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of three that occur more than once."""
    if ids.size < 4:
        return 0
    if ids.max() >= 2**21:
        ids = np.unique(ids, return_inverse=True)[1]
    if ids.max() < 2**21:
        key = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:
        pair = np.unique(np.stack([ids[:-2], ids[1:-1]]), axis=1, return_inverse=True)[1].ravel()
        key = pair << 31 | ids[2:]
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(key.size, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(ids.size, bool)
    for k in range(3):
        covered[k : k + again.size] |= again
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def keep(docs: DataFrame, model: Linear | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    return kept_rows(docs, lambda own, names: apply(own, model, threshold, *names))


def kept_rows(docs: DataFrame, judge) -> DataFrame:
    """``docs`` where ``judge(docs, names of the columns to carry)`` says ``kept``; columns travel under names of their own."""
    names = [f"__{k}" for k in range(len(docs.columns))]
    own = docs.select("*", *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names) if c != "text"])
    carried = [n for c, n in zip(docs.columns, names) if c != "text"]
    back = [F.col("text") if c == "text" else F.col(n).alias(c) for c, n in zip(docs.columns, names)]
    return judge(own, ["text", *carried]).where("kept").select(*back)


def apply(docs: DataFrame, model: Linear | None, threshold: float = THRESHOLD, *carried: str) -> DataFrame:
    """The measures, the probability (null without a model) and the verdict of every document, and carried columns."""
    light = Linear(model.weights.astype(np.float32), model.slope, model.shift) if model else None

    def run(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch.column(1))
        out = {k.split()[0]: [] for k in MEASURES.split(", ")} | {"doc_id": batch.column(0)}
        for _, part in in_parts([t.encode() for t in texts]):
            words = Words(part)
            out["n_words"] += words.size.tolist()
            out["n_repeat_words"] += [repeated_words(words.ids[e - n : e]) for e, n in zip(words.ends, words.size)]
            out["probability"] += light.probability(words.scores(light.weights)).tolist() if light else [None] * len(part)
        for t in texts:
            out["word_chars"].append(len(t) - sum(map(t.count, _SPACES)))
            out["n_symbols"].append(sum(map(t.count, SYMBOLS)))
            out["n_dup_lines"].append(duplicate_lines(t))
        out["base_failed"] = [n < MIN_WORDS or 100 * r > 50 * n for n, r in zip(out["n_words"], out["n_repeat_words"])]
        out["kept"] = [not b and (p is None or p >= threshold) for b, p in zip(out["base_failed"], out["probability"])]
        return out | {c: batch.column(batch.schema.get_field_index("text" if c == "text" else f"__carried_{k}")) for k, c in enumerate(carried)}

    return by_batch(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"__carried_{k}") for k, c in enumerate(carried) if c != "text"]), run, MEASURES + "".join(f", `{c}` {dict(docs.dtypes)[c]}" for c in carried))
