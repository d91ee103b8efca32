"""Packs documents into sequences of a fixed number of tokens by fitted length patterns.

A document is its ids and the end id. Longer ones are cut into full pieces and a rest. The histogram of piece
lengths (one count per length, whatever the number of documents) goes to the driver, where patterns of one to
three lengths that fill a sequence are enumerated, their repeat counts are fitted by non-negative least squares,
rounded, and what is left is packed best-fit (``pattern_fit``): patterns of three lengths place nine in ten pieces where a
sequence has two or three documents (the test tables), fewer where documents are shorter. Each piece then has a rank among those of its
length, and the plan turns length and rank into a sequence and an offset. The plan has at most as many kinds of
sequences as there are patterns of three lengths (about a third of a million at 2048) and pieces left by
rounding, so it is bounded by the sequence length and not by the data.

Ranks come from counts by (bucket, length), buckets by hash, so a length that a third of all documents have is
spread over many groups. A null text is empty: the end id alone. Null and repeated ids are kept, a row per piece.
An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, only, texts_of, written
from .library import library
from .pattern_fit import plan

LENGTH = 2048
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocab: str, end_id: int = 0, length: int = LENGTH, ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and with ``ids`` the packed 32-bit ids."""

    def run(batch: pa.RecordBatch) -> dict:
        rows: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc, one in zip(batch.column(0).to_pylist(), library(vocab).packed(texts_of(batch.column(1)))):
            one = np.append(np.frombuffer(one, "<u4"), np.uint32(end_id)).astype("<u4")
            for k, at in enumerate(range(0, one.size, length)):
                part = one[at : at + length].tobytes()
                for name, value in zip(rows, (doc, k, at, len(part) // 4, zlib.crc32(part), part)):
                    rows[name].append(value)
        return rows

    return by_batch(only(docs, "doc_id", "text"), run, _PIECES + ", ids binary" * ids, keeps=True)


class Places:
    """Sequence and offset for (length, rank)."""

    def __init__(self, kinds: list[tuple[dict[int, int], int]]):
        slots: dict[int, list[tuple[int, int, int, int]]] = {}
        sequence = 0
        for kind, repeats in kinds:
            offset = 0
            for size in sorted(kind, reverse=True):
                slots.setdefault(size, []).append((repeats * kind[size], kind[size], sequence, offset))
                offset += size * kind[size]
            sequence += repeats
        self.sequences = sequence
        self.slots = {size: tuple(np.array(c, np.int64) for c in zip(*rows)) for size, rows in slots.items()}
        self.ends = {size: np.cumsum(s[0]) for size, s in self.slots.items()}

    def find(self, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        holds, each, first, offset = self.slots[size]
        k = np.searchsorted(self.ends[size], rank, side="right")
        inside = rank - (self.ends[size][k] - holds[k])
        return first[k] + inside // each[k], offset[k] + inside % each[k] * size


def ranked(made: DataFrame) -> DataFrame:
    """``made`` with ``rank``: from 0 without gaps among the pieces of each length."""
    total = made.count()
    buckets = max(1, math.isqrt(total))
    split = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = split.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    running = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.withColumn("before", F.sum("n").over(running) - F.col("n")).drop("n")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = split.withColumn("within", F.row_number().over(inside) - 1)
    return numbered.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within")).drop("bucket", "before", "within")


def pack(docs: DataFrame, vocab: str, end_id: int = 0, length: int = LENGTH, ids: bool = False) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    made = written(pieces(docs, vocab, end_id, length, ids), "pieces")
    histogram = np.zeros(length + 1, np.int64)
    for r in made.groupBy("length").count().collect():
        histogram[r["length"]] = r["count"]
    places = Places(plan(histogram))
    names = made.columns

    def run(batch: pa.RecordBatch) -> dict:
        size, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
        sequence, offset = np.zeros(size.size, np.int64), np.zeros(size.size, np.int64)
        for s in np.unique(size).tolist():
            at = np.flatnonzero(size == s)
            sequence[at], offset[at] = places.find(s, rank[at])
        return {n: batch.column(batch.schema.get_field_index(n)) for n in names} | {"sequence_id": sequence, "offset": offset}

    return by_batch(ranked(made), run, _PIECES + ", ids binary" * ids + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, doc_ids, ids: each sequence put together from ``pack(..., ids=True)``; at most ``length`` ids each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.col("p.doc_id").alias("doc_ids"), F.expr("aggregate(p.ids, X'', (a, x) -> concat(a, x))").alias("ids"))
