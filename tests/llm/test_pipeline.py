"""The pipeline on a small corpus: stages pass on what they keep, and the last packs it."""

import random

import corpus_pipeline
from primerflow.llm import queries

from .conftest import words


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    rows, labels = [], []
    shared = words(rng, 70)
    for i in range(160):
        good = i % 5 != 0
        text = words(rng, 120) if good else " ".join(f"{w.upper()}!!" for w in words(rng, 120).split())
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    rows += [(500, rows[1][1], "en", "s", 1), (501, rows[2][1] + " more", "en", "s", 1), (502, words(rng, 60) + " " + shared, "en", "s", 1), (503, words(rng, 60) + " " + shared, "en", "s", 1), (None, None, None, None, None), (504, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        d = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append({r.doc_id: r for r in d.collect()})
        if name != "best-fit packing":
            assert d.columns == docs.columns
    assert not {i for i in range(0, 160, 5)} & set(seen[0]) and len({i for i in range(160) if i % 5} & set(seen[0])) >= 124
    assert 504 not in seen[1] and None not in seen[1]
    assert 500 not in seen[2] and 501 not in seen[2] and {1, 2, 502, 503} <= set(seen[2])
    assert shared in seen[3][502].text and shared not in seen[3][503].text
    assert set(seen[4]) == set(seen[3])
    rows = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert rows == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in d.collect())


def test_rules_reject_what_the_classifier_let_through(spark, tmp_path):
    """Labels of dropped documents, and labels without a document, don't turn the rules' classifier off."""
    rng = random.Random(13)
    poor = lambda: " ".join(f"{w.upper()}!!" for w in words(rng, 120).split())
    rows = [(i, words(rng, 120) if i % 5 else poor(), "en", "s", 1) for i in range(160)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(160)] + [(1000 + i, 0, 0) for i in range(3000)]
    rows.append((700, poor(), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.rules_model(spark, str(tmp_path)) is not None
    let_through = docs.where("doc_id = 700 OR doc_id % 5 <> 0")
    kept = {r.doc_id for r in corpus_pipeline.rules(spark, let_through, str(tmp_path)).collect()}
    assert 700 not in kept and len(kept) >= 124


def test_stages_on_odd_and_empty_tables(spark, odd, odd_rows, empty, tmp_path):
    """Nulls, repeated rows and ids, long texts and clashing columns go through all stages; empty tables give no rows."""
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (13, 0, 0), (14, 0, 0), (None, 0, 1), (11, None, None), (16, 1, 0), (17, 0, 0)], "doc_id long, quality int, toxic int")
    for name, docs, marks in (("odd", odd, labels), ("bare", odd, labels.limit(0)), ("empty", empty, labels.limit(0))):
        at = f"{tmp_path}/{name}"
        docs.write.parquet(f"{at}/documents.parquet")
        marks.write.parquet(f"{at}/labels.parquet")
        rows = corpus_pipeline.run(spark, at).collect()
        if name == "empty":
            assert rows == []
        if name == "bare":  # without labels the base rules alone decide: the long text, plain texts and their near copies stay
            assert {r.doc_id for r in rows} == {5, 11, 16} and sum(r.length for r in rows if r.doc_id == 11) > 40_000
        assert {r.doc_id for r in rows} <= {i for i, _ in odd_rows}


def test_ten_queries():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert names == list(range(1, 11)) and set(queries.oracle_sql()) <= set(queries.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "SimHash near-dedup", "suffix-array dedup", "best-fit packing"]
