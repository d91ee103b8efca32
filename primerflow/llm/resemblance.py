"""Pairs of texts whose word shingles have a given Jaccard similarity or more, as spanning links.

Candidates meet in bands of minimal hashes: 8 bands of 3 find a pair at 0.8 with probability 0.997 and one at 0.9 with
0.99997. Everything that meets is verified on the whole sets of shingle hashes. Texts are distinct ones (copies
count once). A band that many texts share is cut into parts; every two parts meet in a group of their own, so a
group holds about 2 * ``PART`` texts and 2 * ``SHINGLES`` shingles at most (a longer text is a part of its own), and within a group a search that starts from the most typical text compares
only what is not connected yet: it makes at most one link a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, mapped, texts_of, written
from .perfect_hash import mix

BANDS, ROWS, PART = 8, 3, 4096
#: Shingles of the texts of a part, about.
SHINGLES = 2_000_000
_M = np.uint64(0xFF51AFD7ED558CCD)
_SALTS = mix(np.arange(BANDS * ROWS, dtype=np.uint64), 5)


def bands(shingles: np.ndarray) -> list[int]:
    """A key for each band."""
    with np.errstate(over="ignore"):
        out = []
        for b in range(BANDS):
            key = np.uint64(b + 1)
            for r in range(ROWS):
                h = (shingles ^ _SALTS[b * ROWS + r]) * _M
                h ^= h >> np.uint64(32)
                key = (key ^ (h * _M).min()) * _M
                key ^= key >> np.uint64(32)
            out.append(int(key.view(np.int64)))
    return out


def connected(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (a, b) that connect what pairs of at least ``similarity`` connect."""
    sizes = np.array([s.size for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, element, times = np.unique(flat, return_inverse=True, return_counts=True)
    typical = np.bincount(owner, times[element])
    shared = times[element] > 1
    names, column = np.unique(element[shared], return_inverse=True)
    row = owner[shared]
    first = np.searchsorted(row, np.arange(len(sets) + 1))
    links, todo = [], np.argsort(-typical, kind="stable")

    def meets(some: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Whether each of some is similar to each of others; others are taken in blocks that fit in memory."""
        out = np.zeros((some.size, others.size), bool)
        width = max(1, 20_000_000 // max(1, names.size))

        def dense(rows: np.ndarray) -> np.ndarray:
            m = np.zeros((rows.size, names.size), np.float32)
            for k, r in enumerate(rows):
                m[k, column[first[r] : first[r + 1]]] = 1
            return m

        for a in range(0, some.size, width):
            left = dense(some[a : a + width])
            for b in range(0, others.size, width):
                both = left @ dense(others[b : b + width]).T
                whole = sizes[some[a : a + width]][:, None] + sizes[others[b : b + width]][None, :] - both
                out[a : a + width, b : b + width] = both >= similarity * whole - 1e-6 * whole
        return out

    while todo.size > 1:
        front, todo = todo[:1], todo[1:]
        while front.size and todo.size:
            now, front = front[:512], front[512:]
            hit = meets(now, todo)
            new = hit.any(0)
            links += [(int(now[k]), int(v)) for k, v in zip(hit[:, new].argmax(0), todo[new])]
            front, todo = np.concatenate([front, todo[new]]), todo[~new]
    return links


def met(texts: DataFrame) -> DataFrame:
    """node, key, parts: the bands that a text shares with others, and in how many parts those are compared, by their
    number and the size of their sets. ``texts``: node, bands, size (shingles). Texts without shingles meet nobody."""
    keyed = texts.select("node", "size", F.explode("bands").alias("key"))
    parts = F.ceil(F.greatest(F.count("*") / PART, F.sum("size") / SHINGLES)).cast("int")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"), parts.alias("parts")).where("n > 1").drop("n")
    return written(keyed.drop("size").join(written(counts, "common-bands"), "key"), "bands")


def sets(texts: DataFrame, wanted: DataFrame, hashes: Callable[[str], np.ndarray]) -> DataFrame:
    """node, shingles: the packed sets of the wanted texts. ``texts``: d, h, text; ``wanted``: node and the d and h of one
    row that has its text, so that copies are not dealt out by what they share."""

    def small(batch: pa.RecordBatch) -> dict:
        pack = zstandard.ZstdCompressor(level=1)
        return {"d": batch.column(0), "h": batch.column(1), "z": [pack.compress(t.encode()) for t in texts_of(batch.column(2))]}

    def shingles(batch: pa.RecordBatch) -> dict:
        unpack = zstandard.ZstdDecompressor()
        return {"node": batch.column(0), "shingles": [np.unique(hashes(unpack.decompress(z).decode())).astype("<u8").tobytes() for z in batch.column(1).to_pylist()]}

    found = by_batch(texts.select("d", "h", "text"), small, "d long, h long, z binary").join(wanted, ["d", "h"])
    return written(by_batch(found.groupBy("node").agg(F.first("z").alias("z")), shingles, "node long, shingles binary"), "sets")


def links(met: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``u``, ``v``: spanning links between nodes that share a band (``met``), by their ``sets``."""
    parts = F.col("parts")
    part = F.pmod(F.xxhash64("node"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")
    dealt = met.withColumn("part", part).select("node", "key", "part", other)
    dealt = dealt.select("node", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    whole = dealt.join(sets.select("node", "shingles"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(group: list[tuple]) -> Iterator[pa.RecordBatch]:
            if len(group) > 1:
                nodes = [g[0] for g in group]
                pairs = connected([np.frombuffer(g[1], "<u8") for g in group], similarity)
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in c], pa.int64()) for c in zip(*pairs)], ["u", "v"])

        group, last = [], None
        for batch in batches:
            for key, i, j, node, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != last:
                    yield from found(group)
                    group, last = [], (key, i, j)
                group.append((node, shingles))
        yield from found(group)

    ordered = whole.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return mapped(ordered.select("key", "i", "j", "node", "shingles"), run, "u long, v long")
