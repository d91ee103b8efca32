"""WARC archives and exact search against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from primerflow.llm import topk, warc
from pyspark.sql import functions as F

LONG = "<p>" + "x" * 200
PAGES = [(3, "u", LONG), (1, "http://a/b c%20d", LONG), (2, None, LONG), (4, "u", "short"), (5, "u", "short"), (6, "u", ""), (7, "u", None), (None, "n", LONG), (8, "line\r\nbreak", "é" * 50), (9, "u", "é" * 50), (10, "u", "y" * 300_000), (None, "n", "z" * 150), (1, "again", LONG)]


def test_archives(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).withColumn("digest", F.lit("x")).withColumn("first", F.lit(1))
    rows = warc.read(warc.write(df)).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, u, h in PAGES:
        data = (h or "").encode()
        to = first.get(h) if len(data) >= 100 else None
        to = to if to != i else None
        want.append((i or -1, u or "", len(data), hashlib.sha256(data).hexdigest(), "revisit" if to is not None else "response", to))
    assert sorted((r.page_id or -1, r.url or "", r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == sorted(want, key=lambda r: tuple(str(x) if x is None else x for x in r[:5]))
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_reader_is_incremental_and_strict():
    one, two = (warc.record(k, "u", b"body" * 50, hashlib.sha256(b"body" * 50).hexdigest(), None) for k in (1, 2))
    data = one + two
    for step in (1, 7, 10_000):
        found = list(warc.records(data[k : k + step] for k in range(0, len(data), step)))
        assert [warc.row_of(r)[0] for r in found] == [1, 2]
    with pytest.raises(ValueError):
        list(warc.records([data[:-5]]))
    plain = zlib.decompress(one, 31)
    for bad in (plain.replace(b"bodybody", b"bodyBODY", 1), plain.replace(b"WARC/1.1", b"NONE/1.1"), plain + b"x"):
        with pytest.raises(ValueError):
            list(warc.records([zlib.compress(bad, wbits=31)]))
    wrong = warc.record(1, "u", b"body", hashlib.sha256(b"other").hexdigest(), None)
    with pytest.raises(ValueError):
        warc.row_of(next(warc.records([wrong])))


def plain_search(rows, k=10):
    good = [(i, [min(max(int(np.floor(1024 * np.float64(x))), -(2**62)), 2**62) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, x) in enumerate(good):
        if q % 100 == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(x, v)), 1 - 2**63), 2**63 - 1), i) for m, (i, v) in enumerate(good) if m != n)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(df, k=10):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 100 == 0, k).collect())


def test_search_on_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(450)] + [(1000 + i, [0.5] * 6) for i in range(60)]
    rows += [(2000, None), (2100, []), (2200, [1.0, None, 1.0]), (2300, [float("nan")] * 6), (2400, [float("inf")] * 6), (None, [9.0] * 6), (300, [1.0] * 6), (7, [2.0] * 6), (3000, [1.0, 2.0]), (3001, [5.0] * 9), (3100, [0.0] * 6)]
    rows += [(200, rows[200][1]), (200, rows[200][1]), (400, [-3.0] * 6)]  # rows that share a query's id, and its vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("x")).repartition(4)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert found(df) == plain_search(exact)
    assert found(df.limit(0)) == []
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert found(few) == [(0, 1, 1, 2 * 1024 * 1024)]


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(0, 40)]) for i in range(60)] + [(100, [2e6, 3.0, 1e7]), (200, [1e300, 1.0, 1.0])]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 4) == plain_search(rows, 4)


def clustered(rng, n, clusters, size):
    centres = rng.normal(size=(clusters, size)) * 5
    return [(i, (centres[i % clusters] + rng.normal(size=size) / 4).tolist()) for i in range(n)]


def test_search_over_many_annuli_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "LEAST", 4)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rows = clustered(np.random.default_rng(4), 1200, 8, 4) + [(5000 + i, [3.0] * 4) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df) == plain_search(rows)


def test_share_of_vectors_that_are_compared(spark):
    """With production parameters: a part where vectors cluster, and never more than all."""
    rng = np.random.default_rng(6)
    shares = {}
    for name, rows in {"40 clusters": clustered(rng, 6000, 40, 16), "random directions": [(i, rng.normal(size=64).tolist()) for i in range(3000)]}.items():
        compared = spark.sparkContext.accumulator(0)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 100 == 0, 10, compared).collect())
        assert got == plain_search(rows)
        shares[name] = compared.value / (len(rows) * len(rows[::100]))
    print("share compared:", {k: round(v, 3) for k, v in shares.items()})
    assert shares["40 clusters"] < 0.5 and shares["random directions"] <= 1


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x, q = rng.integers(-4000, 4000, (500, 8)), rng.integers(-4000, 4000, (20, 8))
    index = topk.Index(8, float((x.astype(float) ** 2).sum(1).max()), np.zeros((1, 9)))
    index.pivots = topk.farthest_first(index.lifted(x), 12)
    pivot, bins, d = index.bins(x)
    counts = {}
    for key, near in zip(zip(pivot.tolist(), bins.tolist()), d[:, : topk.REFERENCES].tolist()):
        n, least, most = counts.get(key, (0, near, near))
        counts[key] = n + 1, np.minimum(least, near).tolist(), np.maximum(most, near).tolist()
    index.cut(counts)
    ring = index.ring[pivot, bins]
    gap = np.sqrt(((index.lifted(q, True)[:, None] - index.lifted(x)[None]) ** 2).sum(2))
    assert (index.bounds(q)[:, ring] <= gap + 1e-6).all() and index.held.sum() == 500 and len(index.held) > 8
