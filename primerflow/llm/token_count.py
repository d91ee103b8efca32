"""Token counts of texts, from counts of pre-tokens.

Texts are cut into pre-tokens; each document keeps how often it has which pre-token. The library counts the
pieces of every distinct pre-token once, over the whole corpus, and the counts are joined back and summed: no
ids of a document are ever made.

Documents are taken in blocks of bounded text. A block has one list of its distinct pre-tokens and, for each
document, packed (place in that list, frequency) pairs; only the lists are dealt out by pre-token for counting, so
a common pre-token has one row a block. The counts go back to their blocks. A null text counts as empty (0 bytes, 0 tokens). Special strings inside a text
are one pre-token each, as the library reads them. Keys may be null or repeat: one row out per row in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_fields, mapped, only, texts_of, written
from .units import Encoder
from .vocab import ids_of, pattern, tokenizer

#: Characters of text after which a block ends.
BLOCK_CHARS = 12_000_000
#: Counted pre-tokens that a task holds before it passes them on.
_ROWS = 1_000_000

_BLOCKS = "block long, packed binary, pieces array<string>"
_COUNTS = "block long, places binary, n binary"
_OUT = "doc_id long, n_bytes long, n_tokens long"


class Pieces:
    """Numbers the pre-tokens of one block."""

    def __init__(self, path: str):
        import regex

        self.special = [str(t.content) for t in tokenizer(path).get_added_tokens_decoder().values()]
        self.cut = regex.compile(pattern()).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.number: dict[str, int] = {}
        self.of = Encoder(self._units, keep=10**9)

    def _units(self, units: list[str]) -> list[bytes]:
        out = []
        for u in units:
            parts = self.split(u) if self.split and any(s in u for s in self.special) else [u]
            names = [p for part in parts for p in ([part] if part in self.special else self.cut(part))]
            out.append(np.array([self.number.setdefault(p, len(self.number)) for p in names], "<u4").tobytes())
        return out

    def frequencies(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.frombuffer(b"".join(self.of(text)), "<u4"), return_counts=True)


def blocks(docs: DataFrame, path: str) -> DataFrame:
    """Per block of documents: its distinct pre-tokens, frequent ones first, and the packed ids, sizes and frequencies."""
    names, types = arrow_fields(docs.sparkSession, _BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, rows, pieces, chars = TaskContext.get().partitionId() << 32, [], Pieces(path), 0

        def block():
            # frequent pre-tokens first, so that steps between places are small; those of one frequency in order
            listed = np.array(sorted(pieces.number), object)
            at = np.fromiter(map(pieces.number.__getitem__, listed), np.int64, len(listed))
            often = np.bincount(np.concatenate([r[2] for r in rows]), minlength=len(listed))
            order = np.argsort(-often[at], kind="stable")
            listed, rank = listed[order].tolist(), np.empty(len(listed), np.int64)
            rank[at[order]] = np.arange(len(listed))
            packed = pack(rows, rank)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((number, packed, listed), types)], names)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                rows.append((i, len(t.encode()), *pieces.frequencies(t)))
                chars += len(t)
                if chars >= BLOCK_CHARS:
                    yield block()
                    number, rows, pieces, chars = number + 1, [], Pieces(path), 0
        if rows:
            yield block()

    return mapped(only(docs, "doc_id", "text"), run, _BLOCKS, keeps=True)


def pack(rows: list[tuple], rank: np.ndarray) -> bytes:
    """(id, bytes, places, times) of each document as compressed columns. Places are sorted and kept as steps of
    16 bits, their low bytes apart from the high ones, times as 8 bits; larger ones are listed apart."""
    ids, size, places, times = zip(*rows)
    order = [np.argsort(rank[p]) for p in places]
    step = np.concatenate([np.diff(rank[p][o], prepend=0) for p, o in zip(places, order)])
    time = np.concatenate([t[o] for t, o in zip(times, order)])
    null = [i is None for i in ids]
    columns = [np.array([i or 0 for i in ids], "<i8"), np.array(null, "<u1"), np.array(size, "<i8"), np.array([p.size for p in places], "<u4")]
    for values, kind, most in ((step, "<u2", 2**16 - 1), (time, "<u1", 2**8 - 1)):
        far = np.flatnonzero(values >= most)
        columns += [np.minimum(values, most).astype(kind), far.astype("<i8"), values[far].astype("<i8")]
    step = columns[4]
    columns[4:5] = [(step & 255).astype("<u1"), (step >> 8).astype("<u1")]
    pack = zstandard.ZstdCompressor(level=3)
    raw = [pack.compress(c.tobytes()) for c in columns]
    return np.array([len(r) for r in raw], "<i8").tobytes() + b"".join(raw)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, which are null, bytes, pre-tokens of each document; place and times of each pre-token."""
    kinds = ["<i8", "<u1", "<i8", "<u4", "<u1", "<u1", "<i8", "<i8", "<u1", "<i8", "<i8"]
    cut = np.concatenate([[0], np.cumsum(np.frombuffer(packed[: 8 * len(kinds)], "<i8"))]) + 8 * len(kinds)
    unpack = zstandard.ZstdDecompressor()
    ids, null, size, each, low, high, far, far_step, time, often, often_time = (np.frombuffer(unpack.decompress(packed[a:b]), k) for a, b, k in zip(cut[:-1], cut[1:], kinds))
    step, time = low.astype(np.int64) | high.astype(np.int64) << 8, time.astype(np.int64)
    step[far], time[often] = far_step, often_time
    place = np.cumsum(step)
    ends = np.cumsum(each.astype(np.int64))
    base = np.concatenate([[0], place[ends[:-1] - 1]]) if step.size else np.zeros(each.size, np.int64)
    base[ends - each == 0] = 0
    return ids, null, size, each.astype(np.int64), place - np.repeat(base, each), time


def piece_counts(listed: DataFrame, path: str) -> DataFrame:
    """Per block, places and tokens of pre-tokens, packed. ``listed`` has a row for each block and pre-token; equal
    pre-tokens stand together in one partition, so that the library counts each once."""
    names, types = arrow_fields(listed.sparkSession, _COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_n, kept, rows = None, 0, [], 0

        def packed():
            block, place, n = (np.concatenate(c) for c in zip(*kept))
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            parts = [np.split(c[order], cuts) for c in (block, place, n)]
            columns = [b[0] for b in parts[0]], [p.astype("<u4").tobytes() for p in parts[1]], [x.astype("<u4").tobytes() for x in parts[2]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(0), run_end_type=pa.int32())
            pieces, ends = runs.values.to_pylist(), np.asarray(runs.run_ends)
            first = pieces[0] == last
            n = [last_n] * first + [len(x) for x in ids_of(path, pieces[first:])]
            last, last_n = pieces[-1], n[-1]
            kept.append((batch.column(1).to_numpy(), batch.column(2).to_numpy(), np.repeat(n, np.diff(ends, prepend=0))))
            rows += batch.num_rows
            if rows >= _ROWS:
                yield packed()
                kept, rows = [], 0
        if rows:
            yield packed()

    return mapped(listed.select("piece", "block", "place"), run, _COUNTS, keeps=True)


def count(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every document."""
    spark = docs.sparkSession
    kept = written(blocks(docs, path), "piece-blocks")
    listed = kept.select("block", F.posexplode("pieces").alias("place", "piece"))
    n = piece_counts(listed.repartition("piece").sortWithinPartitions("piece"), path)
    found = n.groupBy("block").agg(F.collect_list(F.struct("places", "n")).alias("n"))
    names, types = arrow_fields(spark, _OUT)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, null, size, each, place, times = unpack(packed)
                n = np.zeros(int(place.max(initial=-1)) + 1, np.int64)
                for part in parts or []:
                    at, count = np.frombuffer(part["places"], "<u4"), np.frombuffer(part["n"], "<u4")
                    here = at < n.size
                    n[at[here]] = count[here]
                sums = np.concatenate([[0], np.cumsum(n[place] * times)])
                ends = np.cumsum(each)
                columns = [pa.array(ids, types[0], mask=null.astype(bool)), pa.array(size, types[1]), pa.array(sums[ends] - sums[ends - each], types[2])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return mapped(kept.drop("pieces").join(found, "block", "left").select("packed", "n"), total, _OUT)
