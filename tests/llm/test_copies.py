"""Copies: fingerprints, near-duplicates, repeated passages, components; each against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from primerflow.llm import golay, resemblance, simhash, suffix_dedup
from primerflow.llm.components import components, forest
from pyspark.sql import functions as F

from .conftest import words

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])


def plain_fingerprint(text, n):
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_golay_meets_at_one_error():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**23, 20_000)
    assert (golay.nearby(x)[:, :1] == golay.nearby(x ^ (1 << rng.integers(0, 23, x.size)))).any(1).all()
    assert ((golay.tables()[2] >= 0).sum(1) <= 6).all() and (golay.tables()[2][:, 0] >= 0).all()


@pytest.mark.parametrize("part", [simhash.PART, 16])
def test_all_pairs_within_three_bits_are_linked(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(300)]
    for p in list(prints[:200]):
        q = p
        for b in rng.sample(range(64), rng.randint(1, 5)):
            q ^= 1 << b
        prints.append(q)
    centre = rng.getrandbits(64)  # a dense cluster in some segments
    prints += [centre ^ rng.getrandbits(6) << rng.choice((0, 30, 58)) for _ in range(150)]
    prints = sorted({p - 2**64 if p >= 2**63 else p for p in prints})
    df = spark.createDataFrame([(p, k) for k, p in enumerate(prints)], "fingerprint long, doc_id long")
    got = {r.doc_id: r.component_id for r in simhash.groups(df).collect()}
    want = plain_components(len(prints), lambda i, j: ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 3)
    assert [got[k] for k in range(len(prints))] == want


def test_rare_keys_are_not_counted_one_by_one(spark, monkeypatch):
    """A count of all keys took an executor's heap, and one task made and one task counted them."""
    rng = random.Random(8)
    prints = spark.createDataFrame([(rng.getrandbits(64) - 2**63,) for _ in range(3000)], "fingerprint long")
    assert simhash.keyed(prints.distinct()).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    written, tags = simhash.written, []
    monkeypatch.setattr(simhash, "written", lambda df, tag: tags.append(tag) or written(df, tag))
    keys = simhash.keyed(prints)
    assert simhash.dealt(keys).count() == keys.count()
    assert "full-buckets" in tags and "crowded-keys" not in tags


def test_near_duplicates_of_odd_rows(odd, odd_rows, empty):
    got = sorted((r.doc_id or -1, r.fingerprint & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(odd).collect())
    prints = [plain_fingerprint(t, 3) for _, t in odd_rows]
    root = plain_components(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    least = {}
    for k, (i, _) in zip(root, odd_rows):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    assert got == sorted((i or -1, p, least.get(k)) for (i, _), p, k in zip(odd_rows, prints, root))
    assert simhash.near_duplicates(empty).count() == 0


def test_hashes_long_and_short():
    assert simhash.shingle_hashes("", 3).size == 0 and simhash.fingerprint(simhash.shingle_hashes(" \n", 3)) == 0
    assert simhash.shingle_hashes("a B", 3).tolist() == [xxhash.xxh64_intdigest(b"a b", 42)]
    text = words(random.Random(1), 70_000)
    assert simhash.fingerprint(simhash.shingle_hashes(text, 3)) & (2**64 - 1) == plain_fingerprint(text, 3)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    out = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    want = plain_components(300, lambda i, j: (i, j) in set(edges) or (j, i) in set(edges))
    assert {k: v for k, v in enumerate(want) if k != v} == out
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_forest_keeps_components():
    u, v = forest(np.array([1, 5, 3]), np.array([2, 6, 2]))
    assert sorted(zip(u.tolist(), v.tolist())) == [(2, 1), (3, 1), (6, 5)]


def test_deduplicate_keeps_one_of_each_group(spark, odd, odd_rows, empty):
    rng = random.Random(9)
    rows = list(odd_rows)
    for g in range(12):
        base = words(rng, 150).split()
        for c in range(6):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = f"edit{g}{c}{rng.random()}"
            rows.append((1000 + 10 * g + c, " ".join(copy)))
    sets = [set(shingles(t, 5)) for _, t in rows]

    def alike(i, j):
        a, b = sets[i], sets[j]
        return (not a and not b) or len(a & b) >= 0.8 * len(a | b)

    root = plain_components(len(rows), alike)
    groups = {}
    for k, (i, t) in zip(root, rows):
        groups.setdefault(k, set()).add((i is None, i or 0))
    kept = [r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").withColumn("d", F.lit("x"))).collect()]
    assert sorted((i is None, i or 0) for i in kept) == sorted(min(g) for g in groups.values())
    out = simhash.deduplicate(odd)
    assert out.columns == odd.columns and simhash.deduplicate(empty).count() == 0


def test_recall_of_pairs_just_over_the_similarity(spark):
    """Groups of two, where a link that is missed can't come by another way: at least 0.9 of those at 0.80 to 0.85, and of
    those at 0.9 or more, by all pairs of shingle sets; pairs under 0.8 stay apart unless their fingerprints are close."""
    rng, rows = random.Random(14), []
    for g in range(400):
        base = words(rng, 200).split()
        copy = list(base)
        for at in rng.sample(range(5, 195, 10), rng.choice((1, 2, 4, 5, 6))):
            copy[at] = f"new{rng.random()}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    sets = [set(shingles(t, 5)) for _, t in rows]
    alike = [len(sets[2 * g] & sets[2 * g + 1]) / len(sets[2 * g] | sets[2 * g + 1]) for g in range(400)]
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * g in kept for g in range(400))
    for low, high in ((0.8, 0.85), (0.9, 1)):
        group = [g for g in range(400) if low <= alike[g] < high]
        caught = [g for g in group if 2 * g + 1 not in kept]
        print("similarity", low, high, "pairs", len(group), "caught", len(caught))
        assert len(group) > 40 and len(caught) >= 0.99 * len(group)


def test_links_inside_a_crowded_band(spark, monkeypatch):
    monkeypatch.setattr(resemblance, "PART", 16)
    monkeypatch.setattr(resemblance, "SHINGLES", 3000)
    rng = random.Random(4)
    base = words(rng, 200).split()
    texts = [" ".join(base)]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(200)] = str(rng.random())
        texts.append(" ".join(copy))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in simhash.deduplicate(rows).collect()] == [0]


def plain_removal(texts, length):
    """Per text: which bytes a string of ``length`` bytes that starts elsewhere too covers."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        cut = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cut[i : i + length] = True
        out.append(cut)
    return data, out


def removal_rows(rows, length=200):
    data, cuts = plain_removal([t for _, t in rows], length)
    return sorted((i or -1, len(d), int(c.sum()), int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~c])).hexdigest()) for (i, _), d, c in zip(rows, data, cuts))


def dedup_rows(df):
    return sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(df).collect())


def mixed(rng, n=40):
    """Texts of shared and own passages, around the length that counts."""
    shared = [words(rng, k)[:k] for k in (199, 200, 201, 450, 900)] + ["ab" * 160, "é" * 130]
    rows = []
    for i in range(n):
        rows.append((i, " ".join(rng.choice([words(rng, rng.randint(1, 60)), rng.choice(shared)]) for _ in range(rng.randint(1, 5)))))
    return rows


def test_repeated_passages(spark, odd, odd_rows, empty):
    assert dedup_rows(odd) == removal_rows(odd_rows)
    rows = mixed(random.Random(6))
    assert dedup_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == removal_rows(rows)
    assert suffix_dedup.digests(empty).count() == 0


def test_repeated_passages_of_crowded_anchors_and_in_slices(spark, monkeypatch):
    rows = mixed(random.Random(7), 25)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = sorted((r.doc_id, r.text) for r in suffix_dedup.dedup(df).collect())
    for variants, part in ((1, 300), (3, 1000)):
        monkeypatch.setattr(suffix_dedup, "VARIANTS", variants)
        monkeypatch.setattr(suffix_dedup, "SLICE", part)
        assert dedup_rows(df) == removal_rows(rows)
        assert sorted((r.doc_id, r.text) for r in suffix_dedup.dedup(df).collect()) == first


def test_first_copy_stays(spark):
    rng = random.Random(8)
    shared = words(rng, 60)
    rows = [(3, words(rng, 20) + " " + shared + " " + words(rng, 20)), (1, shared + " " + words(rng, 30)), (2, "only " + words(rng, 40)), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("lo"), F.lit(2).alias("d"))
    out = {r.doc_id: r.text for r in suffix_dedup.dedup(df).collect()}
    assert out[1] == dict(rows)[1] and out[2] == dict(rows)[2] and out[4] is None
    assert shared not in out[3] and len(out[3]) < len(dict(rows)[3]) - 195
    assert suffix_dedup.dedup(df).columns == df.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=8, max_size=24), min_size=1, max_size=6), st.sampled_from([8, 12, 20]))
def test_factors(texts, length):
    """Longest previous factors, and longest matches anywhere, by comparing all pairs."""
    data = "".join(texts).encode()
    starts = np.arange(max(1, len(data) - length + 1))
    data += b"c" * (length - 8)
    at = [data[a : a + length] for a in starts]
    same = [[next((n for n in range(length) if a[n : n + 1] != b[n : n + 1]), length) for b in at] for a in at]
    previous, any_other = suffix_dedup.factors(np.frombuffer(data, np.uint8), starts, length)
    assert previous.tolist() == [max(same[k][:k], default=0) for k in range(len(at))]
    assert any_other.tolist() == [max(same[k][:k] + same[k][k + 1 :], default=0) for k in range(len(at))]


def test_factors_of_a_large_block():
    """Descending, equal and random places take the same way."""
    rng = np.random.default_rng(9)
    data = np.concatenate([np.arange(60_000) // 256, np.full(3_000, 7), rng.integers(0, 3, 40_000)]).astype(np.uint8)
    starts = np.arange(data.size - 200)
    previous, any_other = suffix_dedup.factors(data, starts, 200)
    seen, text = {}, data.tobytes()
    for a in starts.tolist():
        seen.setdefault(text[a : a + 200], []).append(a)
    again = np.zeros(starts.size, bool)
    for places in seen.values():
        again[places[1:]] = True
    assert ((previous >= 200) == again).all() and (any_other >= previous).all()
