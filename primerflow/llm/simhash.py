"""SimHash near-duplicates by Golay-code fuzzy hashing.

A text (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``) has a 64-bit fingerprint: a bit is 1 if it is set in over
half the XXH64 hashes of the text's word shingles, repeats included. Fingerprints that differ in at most 3 bits
are linked; documents reachable through links form a component.

Candidates. A fingerprint is cut into segments of 23, 23 and 18 bits (the last padded to 23). Three errors fall on
three segments in one of these ways, and each way has keys of its own:

* two segments have none: both segments as they are (41 or 46 bits);
* one segment has none, another has one: the first as it is, with a Golay index of the other (30 or 35 bits);
* each has one: the three Golay indices (36 bits).

Where a segment has at most one error, the nearest codeword of one word is among the codewords within 4 bits of
the other (``golay``). A fingerprint is therefore listed once under nearest indices and once under all nearby
ones, and the two lists are joined by key and verified by their differing bits. Copies count once: only distinct
fingerprints are keyed, and a key that many of them share is cut up into blocks against blocks. A task keeps a spanning
forest of the links it finds, so their number does not grow with the square of a group.

A null text counts as empty, and texts without words have fingerprint zero, linked like any other. A document with
null doc_id has a component as any other, but doesn't name it. Repeated ids give one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import resemblance
from .common import ROW_KEY, by_batch, mapped, only, row_keys, texts_of, written
from .components import components, forest
from .golay import nearby

SEED = 42
#: First bit and length of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Hashes of a text that are counted at once, and pairs that are verified at once.
_HASHES, _PAIRS = 65_536, 500_000
#: Rows that may share a key before it is cut up.
PART = 8192
#: Rows of a bucket of keys, about, and buckets at most.
IN_BUCKET, BUCKETS = 1024, 1 << 20


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle; of the whole sequence if it is shorter; none without words."""
    parts = text.encode().lower().split()  # of bytes: lower() changes A-Z only, split() cuts at six characters
    if not parts:
        return np.zeros(0, np.uint64)
    whole, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(whole, SEED)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: 1 - words or None].tolist(), ends[words - 1 :].tolist())
    return np.fromiter((digest(whole[a:b], SEED) for a, b in spans), np.uint64, len(parts) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint, as a signed integer."""
    counts = np.zeros(64, np.int64)
    for k in range(0, hashes.size, _HASHES):
        bits = np.unpackbits(hashes[k : k + _HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > hashes.size, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fingerprint (a signed 64-bit integer) of each document."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "fingerprint": [fingerprint(shingle_hashes(t, words)) for t in texts_of(batch.column(1))]}

    return by_batch(only(docs, "doc_id", "text"), run, "doc_id long, fingerprint long")


def _keys(prints: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(list, keys, fingerprints): list 0 has nearest indices, list 1 nearby ones. A key starts with its kind."""
    whole = [(prints.view(np.uint64) >> np.uint64(a) & np.uint64(2**n - 1)).astype(np.int64) for a, n in SEGMENTS]
    index = [nearby(w) for w in whole]
    kind = 0

    def key(*parts: tuple[np.ndarray, int]) -> np.ndarray:
        out = np.full(prints.size, kind, np.int64)
        for values, bits in parts:
            out = out << bits | values
        return out

    for i, j in ((0, 1), (0, 2), (1, 2)):
        same = key((whole[i], SEGMENTS[i][1]), (whole[j], SEGMENTS[j][1]))
        yield 0, same, prints
        yield 1, same, prints
        kind += 1
    for i in range(3):
        for j in range(3):
            if i != j:
                for side, columns in ((0, 1), (1, 6)):
                    for c in range(columns):
                        ok = index[j][:, c] >= 0
                        yield side, key((whole[i], SEGMENTS[i][1]), (index[j][:, c], 12))[ok], prints[ok]
                kind += 1
    for side, columns in ((0, (6, 1, 1)), (1, (1, 6, 6))):
        for a in range(columns[0]):
            for b in range(columns[1]):
                for c in range(columns[2]):
                    parts = [index[0][:, a], index[1][:, b], index[2][:, c]]
                    ok = (parts[0] >= 0) & (parts[1] >= 0) & (parts[2] >= 0)
                    yield side, key(*((p, 12) for p in parts))[ok], prints[ok]


def keyed(distinct: DataFrame) -> DataFrame:
    """key, side, fingerprint: all keys of each distinct fingerprint. These are few bytes and become some 80 times as many
    rows, so they are dealt out by number: by their size they would be one task's, and its file the next one's (by a hash: Spark leaves out a second deal by the column itself)."""
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batch: pa.RecordBatch) -> dict:
        sides, keys, prints = zip(*_keys(batch.column(0).to_numpy()))
        return {"key": np.concatenate(keys), "side": np.repeat(np.array(sides, np.int8), [k.size for k in keys]), "fingerprint": np.concatenate(prints)}

    return by_batch(distinct.select("fingerprint").repartition(tasks, F.xxhash64("fingerprint")), run, "key long, side byte, fingerprint long")


def _verified(key: np.ndarray, side: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the two lists of each key; rows are sorted by key and list."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, key.size))
    right = np.add.reduceat(side.astype(np.int64), first)
    left = size - right
    two = prints[first] != prints[np.minimum(first + 1, key.size - 1)]  # most keys of two have one fingerprint in both lists
    both = np.flatnonzero((left > 0) & (right > 0) & ((size > 2) | two))
    us, vs = [], []

    def take(u: np.ndarray, v: np.ndarray) -> None:
        ok = u != v
        us.append(u[ok])
        vs.append(v[ok])
        if sum(x.size for x in us) > _PAIRS:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            us[:], vs[:] = [u], [v]

    def near(differ: np.ndarray) -> np.ndarray:
        return np.bitwise_count(differ.view(np.uint64)) <= bits  # unsigned: of signed numbers the absolute value is counted

    large = left[both] * right[both] > 4096
    for g in both[large]:
        a, b = prints[first[g] : first[g] + left[g]], prints[first[g] + left[g] : first[g] + size[g]]
        step = max(1, _PAIRS // min(b.size, _PAIRS))
        for k in range(0, a.size, step):
            for m in range(0, b.size, _PAIRS):
                some, part = a[k : k + step], b[m : m + _PAIRS]
                i, j = np.nonzero(near(some[:, None] ^ part[None, :]))
                take(some[i], part[j])
    small = both[~large]
    pairs = left[small] * right[small]
    cuts = np.searchsorted(np.cumsum(pairs), np.arange(_PAIRS, int(pairs.sum()) + _PAIRS, _PAIRS), side="right")
    start = 0
    for end in [*cuts.tolist(), small.size]:
        g = small[start:end]
        start = max(start, end)
        if g.size:
            n = left[g] * right[g]
            owner = np.repeat(g, n)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            u, v = prints[first[owner] + k // right[owner]], prints[first[owner] + left[owner] + k % right[owner]]
            ok = near(u ^ v)
            take(u[ok], v[ok])
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(distinct: DataFrame, bits: int = 3) -> DataFrame:
    """``u``, ``v``: spanning links between distinct fingerprints that differ in at most ``bits`` (3 at most)."""
    if bits > 3:
        raise ValueError("three segments of one error each find at most 3 differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, found, size = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy() for k in range(3)]
            if rest:
                now = [np.concatenate(c) for c in zip(rest, now)]
            last = np.searchsorted(now[0], now[0][-1])  # the last key may go on
            rest = [c[last:] for c in now]
            if last:
                found.append(_verified(*(c[:last] for c in now), bits))
                size += found[-1][0].size
                if size > _PAIRS:
                    found = [forest(*(np.concatenate(c) for c in zip(*found)))]
                    size = found[0][0].size
        if rest:
            found.append(_verified(*rest, bits))
            u, v = forest(*(np.concatenate(c) for c in zip(*found)))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return mapped(dealt(keyed(distinct)).repartition("key").sortWithinPartitions("key", "side"), run, "u long, v long")


def dealt(keys: DataFrame) -> DataFrame:
    """``keys`` with those that more than ``PART`` rows share cut up: the two lists of such a key are dealt into parts, and
    every part of one meets every part of the other under a key of its own, so that no task grows with a key.

    Nearly all keys are rare, and counts of each would fill an executor's heap: buckets of keys are counted first, and keys
    only in buckets of more than ``PART`` rows."""
    keys = written(keys, "keys")
    buckets = min(BUCKETS, 1 << (keys.count() // IN_BUCKET).bit_length())
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    full = written(keys.select(bucket).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("bucket"), "full-buckets")
    if full.isEmpty():
        return keys
    some = keys.select("key", bucket).join(F.broadcast(full), "bucket", "left_semi")  # of full buckets there are BUCKETS at most
    crowded = written(some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PART), "crowded-keys")
    if crowded.isEmpty():
        return keys
    parts = F.ceil(F.col("n") / PART).cast("int")
    own, other = F.pmod(F.xxhash64("fingerprint"), parts).cast("int"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")
    many = keys.join(crowded, "key").select("key", "side", "fingerprint", own.alias("own"), other)
    i, j = (F.when(F.col("side") == s, F.col("own")).otherwise(F.col("other")) for s in (0, 1))
    many = many.select(F.xxhash64("key", i, j).alias("key"), "side", "fingerprint")
    return keys.join(crowded, "key", "left_anti").select("key", "side", "fingerprint").unionByName(many)


def groups(prints: DataFrame, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id: the smallest doc_id that links reach, the document's own included."""
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    stars = components(links(distinct, bits))
    rooted = distinct.join(stars, distinct["fingerprint"] == stars["u"], "left").select("fingerprint", "least", F.coalesce("v", "fingerprint").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(named, "root").select("fingerprint", "component_id")
    return prints.join(of, "fingerprint").select("doc_id", "fingerprint", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """``groups`` of the documents' fingerprints."""
    return groups(written(fingerprints(docs, words), "fingerprints"), bits)


def deduplicate(docs: DataFrame, words: int = 5, bits: int = 3, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of the smallest doc_id (a null id last).

    Fingerprints of ``words``-word shingles link texts as above. At a Jaccard similarity of 0.8 two 64-bit fingerprints
    differ in about 10 bits, so 3 bits alone would miss most such pairs; pairs of at least ``similarity`` on their
    shingle sets are linked as well (``resemblance``). Rows equal in id and text stay as one. Texts without words
    are all alike.
    """
    keyed = row_keys(only(docs, "doc_id", "text")).select("d", "h", F.col("doc_id").isNull().alias("null"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text")

    def marks(batch: pa.RecordBatch) -> dict:
        prints, keys, size = [], [], []
        for text in texts_of(batch.column(4)):
            hashes = shingle_hashes(text, words)
            prints.append(fingerprint(hashes))
            keys.append(resemblance.bands(hashes) if hashes.size else [])
            size.append(hashes.size)
        return {n: batch.column(k) for k, n in enumerate(("d", "h", "null", "node"))} | {"fingerprint": prints, "bands": keys, "size": size}

    slim = written(by_batch(keyed, marks, "d long, h long, null boolean, node long, fingerprint long, bands array<long>, size long"), "near-rows")
    made = written(slim.groupBy("node").agg(F.first("fingerprint").alias("fingerprint"), F.first("bands").alias("bands"), F.first("size").alias("size")), "near-texts")
    printed = made.groupBy("fingerprint").agg(F.min("node").alias("first"))
    near = links(printed, bits)
    name = lambda c: printed.select(F.col("fingerprint").alias(c), F.col("first").alias(f"{c}_node"))
    by_print = near.join(name("u"), "u").join(name("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    same_print = made.join(printed, "fingerprint").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    met = resemblance.met(made)
    one = slim.groupBy("node").agg(F.min(F.struct("d", "h")).alias("one")).select("node", "one.*")
    wanted = written(one.join(met.select("node").distinct(), "node", "left_semi"), "wanted")
    sets = resemblance.sets(keyed, wanted, lambda text: shingle_hashes(text, words))
    stars = components(by_print.unionByName(same_print).unionByName(resemblance.links(met, sets, similarity)))
    root = F.coalesce("v", "node").alias("root")
    rooted = slim.select("d", "h", "null", "node").join(stars, slim["node"] == stars["u"], "left").select("d", "h", "null", root)
    stays = rooted.groupBy("root").agg(F.min(F.struct("null", "d", "h")).alias("s")).select("s.d", "s.h")
    kept = row_keys(docs, *ROW_KEY).join(stays.toDF(*ROW_KEY), list(ROW_KEY), "left_semi")
    repeats = slim.groupBy("d", "h").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return (kept if repeats else kept.dropDuplicates(list(ROW_KEY))).drop(*ROW_KEY)
