"""Quality rules, co-training and their model."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from primerflow.llm import cotraining, quality_rules, text_model
from primerflow.llm import labelled as labelled_rows
from primerflow.llm.labelled import gather, labelled
from pyspark.sql import functions as F

from .conftest import words


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(tri)
    hit = {i + k for i, t in enumerate(tri) if often[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_measures(odd, odd_rows, empty):
    rows = quality_rules.apply(odd, None).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept))
    want = {}
    for i, t in odd_rows:
        m = measures(t)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        want.setdefault(i, []).append((*m, failed, not failed))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert quality_rules.apply(empty, None).count() == 0


def test_repeated_words_of_long_and_wide_texts():
    assert quality_rules.repeated_words(np.array([1, 1, 1, 1])) == 4 and quality_rules.repeated_words(np.array([1, 1, 1])) == 0
    wide = np.array([2**21 + 5, 7, 8, 9, 2**21 + 5, 7, 8])
    assert quality_rules.repeated_words(wide) == 6
    many = np.arange(2**21 + 10)
    many[-3:] = [0, 1, 2]
    assert quality_rules.repeated_words(many) == 6


def corpus(n=300):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        rows.append((i, words(rng, 80) if good else " ".join(f"{w.upper()}!!" for w in words(rng, 80).split()), "en", "src1" if good else f"src{i % 3}", 400))
        if i % 3:
            labels.append((i, int(good), 0))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("op", [quality_rules, cotraining])
def test_held_out_accuracy(tables, op):
    docs, labels = tables
    model = op.train(docs, labels)
    rows = (quality_rules.apply if op is quality_rules else cotraining.score)(docs, model).collect()
    unseen = [r for r in rows if r.doc_id % 3 == 0]
    assert np.mean([r.kept == (r.doc_id % 4 != 0) for r in unseen]) > 0.97
    p = np.array([r.probability for r in rows])
    assert ((p > 0) & (p < 1)).all() and abs(p.mean() - 0.75) < 0.15
    kept = op.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


@pytest.mark.parametrize("op", [quality_rules, cotraining])
def test_odd_tables(spark, odd, empty, tables, op):
    docs, labels = tables
    model = op.train(docs, labels)
    assert op.keep(odd, model).columns == odd.columns
    assert op.keep(empty, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op.train(docs, none) is None and op.train(empty, labels) is None
    one = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    assert op.train(docs, one) is None
    assert op.keep(odd, None).columns == odd.columns


def test_labels_count_once(spark):
    docs = spark.createDataFrame([(i, "x") for i in (1, 2, 3, 4, 4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 1), (4, 1), (9, 0), (10, 1), (None, 0)], "doc_id long, quality int")
    rows = labelled(docs, labels, 4).collect()  # 9 and 10 have no document
    assert sorted((r.quality, r.weight) for r in rows) == [(0, 1.0), (1, 1.5), (1, 1.5)]


def test_columns_of_the_contract_come_first(odd):
    names = quality_rules.apply(odd, None).columns
    assert names[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_a_sample_is_bounded_by_features(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(50)), "a") for i in range(40)] * 2, "doc_id long, text string, place string")
    chosen = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    whole = gather(docs, chosen)
    assert sorted(whole.ids) == list(range(40)) and whole.row.size == whole.place.size == whole.value.size
    monkeypatch.setattr(labelled_rows, "FEATURES", whole.row.size // 4)
    some = gather(docs, chosen)
    assert 8 <= some.ids.size <= 12 and set(some.extra["quality"]) == {1}


def test_the_driver_holds_a_sample_once(monkeypatch):
    """Fitting on four fifths, and adding rows that come later, copy no features."""
    import tracemalloc

    n, each = 400, 10_000
    rng = np.random.default_rng(0)
    sample = labelled_rows.Sample(np.arange(n), np.repeat(np.arange(n, dtype=np.uint16), each), rng.integers(0, 2**18, n * each).astype(np.int32), np.full(n * each, 1 / each, np.float32), {"lang": ["en"] * n, "source": ["s"] * n, "n_chars": [1] * n})
    y, weight = (np.arange(n) % 2).astype(float), np.ones(n)
    whole = sum(x.nbytes for x in (sample.row, sample.place, sample.value))
    monkeypatch.setattr(cotraining, "FIRST", 1)
    monkeypatch.setattr(cotraining, "MORE", 1)
    monkeypatch.setattr(quality_rules, "fit", lambda *a: text_model.fit(*a, rounds=1))

    def found(models, taken):
        return {} if taken[0] else {0: cotraining.Found([n], np.array([1.0]), np.zeros(9, np.uint16), np.arange(9, dtype=np.int32), np.full(9, 1 / 9, np.float32))}

    for run in (lambda: quality_rules.fit_sample(sample, y, weight), lambda: cotraining.teach(sample, np.ones(n, bool), y, weight, search=found)):
        tracemalloc.start()
        assert run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < whole / 2


def test_character_grams_are_of_characters():
    """Two words of two-byte letters share their runs of three letters, and no others."""
    one, two = (set(text_model.Words([t.encode()]).features()[1].tolist()) for t in ("жбcжab", "xжбcжy"))
    assert len(one) == 6 + 5 + 1 and len(one & two) == 3  # жбc, бcж, жбcж


def test_scores_are_those_of_the_features():
    texts = [b"one two two  two", b"", b"x", "é one\ntwo".encode()]
    rng = np.random.default_rng(0)
    weights = rng.normal(size=2**text_model.BITS)
    w = text_model.Words(texts)
    row, place, value = w.features()
    want = np.bincount(row, weights[place] * value, minlength=4)
    assert np.allclose(w.scores(weights), want) and np.allclose(np.bincount(row, value, minlength=4), [1, 0, 1, 1])
    apart = np.concatenate([text_model.Words([t]).scores(weights) for t in texts])
    assert np.allclose(apart, want)


@pytest.mark.parametrize("slot_bits", [1, 4, 19])
def test_kept_word_sums_change_no_score(slot_bits):
    rng = random.Random(3)
    texts = [words(rng, n).encode() for n in (0, 1, 2, 300, 40, 40, 5000)] + ["a a a \xe9 \u65e5\u672c\u8a9e \t x".encode(), b"", b" \n ", b"tail"] * 2
    w = np.random.default_rng(3).normal(size=2**text_model.BITS)
    scorer = text_model.Scorer(w, slot_bits)
    for part in (texts, texts[::-1], texts[3:4] * 3, [b""], texts):
        assert np.array_equal(scorer.scores(part), text_model.Words(part).scores(w))


def test_calibration_follows_frequencies():
    rng = np.random.default_rng(2)
    s = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * s + 1)))).astype(float)
    slope, shift = text_model.calibrate(s, y, np.ones(4000))
    assert abs(slope - 2) < 0.3 and abs(shift - 1) < 0.2
    assert text_model.calibrate(s, np.ones(4000), np.ones(4000))[0] == 0


def test_views_teach_each_other(monkeypatch):
    """A view that can't tell learns from one that can: pool rows get labels."""
    monkeypatch.setattr(cotraining, "CERTAIN", 0.85)
    seen = []
    fit = cotraining.View.fit

    def spy(self, y, weight, *rest):
        seen.append((self.size, int((weight > 0).sum())))
        return fit(self, y, weight, *rest)

    rows, labels = corpus(200)
    truth = dict((i, q) for i, q, _ in labels)
    parts = [text_model.Words([t.encode()]).features() for _, t, *_ in rows]
    sample = cotraining.Sample(np.array([r[0] for r in rows]), np.concatenate([np.full(p[0].size, k) for k, p in enumerate(parts)]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), {"lang": ["en"] * 200, "source": ["s"] * 200, "n_chars": [1] * 200})
    known = np.array([i in truth for i in range(200)])
    y = np.array([truth.get(i, 0) for i in range(200)], float)
    cotraining.View.fit = spy
    try:
        model = cotraining.teach(sample, known, y, np.ones(200))
    finally:
        cotraining.View.fit = fit
    pages = [n for size, n in seen if size == 2**cotraining.PAGE_BITS]
    assert model and len(pages) == cotraining.ROUNDS + 1 and pages[-1] > pages[0]


def test_every_unlabelled_document_is_searched(spark, monkeypatch):
    """A source without labels, behind 1,300 others by the hash of the id, teaches the page view."""
    monkeypatch.setattr(cotraining, "CERTAIN", 0.85)
    rng = random.Random(21)
    by_hash = [r.id for r in spark.sql("SELECT id FROM range(1000, 2360) ORDER BY xxhash64(id), id").collect()]
    poor = lambda: " ".join(f"{w.upper()}!!" for w in words(rng, 40).split())
    rows = [(i, words(rng, 40) if i % 4 else poor(), "en", "s" if i % 8 else "bad", 200) for i in range(200)]
    rows += [(i, words(rng, 40), "en", "s", 200) for i in by_hash[:1300]] + [(i, poor(), "en", "rare", 200) for i in by_hash[1300:]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    p = {r.doc_id: r.p_page for r in cotraining.score(docs, cotraining.train(docs, labels)).collect()}
    assert max(p[i] for i in by_hash[1300:]) < 0.5 < min(p[i] for i in by_hash[:1300])


def test_rows_of_an_id_do_not_add_up(spark, monkeypatch):
    """Rows that share a labelled id come to the driver once, the shortest text of them, whatever their number."""
    rng = random.Random(3)
    rows = [(k, words(rng, 60)) for k in range(6)] + [(2, "one short text")] + [(3, words(rng, 61)) for _ in range(40)]
    docs, taken = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), []
    chosen = spark.createDataFrame([(k, k % 2, 1.0) for k in range(5)], "doc_id long, quality int, weight double")
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: [taken.append(r) or r for r in collect(self)])
    sample = gather(docs, chosen)
    assert sorted(r["doc_id"] for r in taken if "place" in r) == list(range(5))
    assert sample.ids.tolist() == list(range(5)) and sample.extra["quality"] == [0, 1, 0, 1, 0]
    want = text_model.Words([b"one short text"]).features()
    assert sample.place[sample.row == 2].tolist() == want[1].tolist() and sample.row.size == sample.place.size == sample.value.size
