"""Removes repeated passages, found with suffix order and longest-previous-factor values.

A passage is a string of ``length`` bytes (200) that starts at more than one place of the corpus, in one document
or several; matches never cross documents. Every byte of such a passage goes; with ``keep_first`` only those of
passages that occur earlier as well (documents in order of doc_id), so the first copy stays.

One suffix array of the whole corpus would have to be in one place, so places are brought together first. Each
window of ``length`` bytes picks an anchor, the ``ANCHOR``-byte string in it with the least hash: equal windows pick
equal anchors. Neighbouring windows with one anchor are a run. Anchors that occur once need nothing more. Equal
runs of an anchor are collapsed to their first place and a count. Where an anchor has different runs, the distinct
ones are put side by side in order of place and the suffix array of their windows is made, with the common prefixes of
neighbours. The previous and the next smaller place in suffix order give each window's longest previous factor: a
window that has ``length`` bytes of it occurs earlier.

A task sorts about ``BLOCK`` bytes at a time, whole anchors. The runs of an anchor with more than ``VARIANTS`` different
ones come as single windows, dealt out to several such blocks by their hash, so that no task grows with an anchor; they
take the same way from there.

A null text counts as empty. Texts are taken as UTF-8 bytes and as a whole, in overlapping slices of ``SLICE`` bytes
for bounded memory. Null and repeated ids are allowed; rows equal in id and text are each an occurrence, and
with ``keep_first`` they share their verdict.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, arrow_fields, by_batch, mapped, only, row_keys, texts_of, written

LENGTH, ANCHOR = 200, 64
SLICE, BLOCK, VARIANTS = 1 << 19, 800_000, 20_000
_PLACE_BITS = 22
_B = 0x9E3779B97F4A7C15
_RUNS = "d long, h long, lo int, hi int, anchor long, run long"
_CONTENTS = "d long, h long, lo int, anchor long, part int, run long, window int, content binary"
_RANGES = "anchor long, run long, repeated binary, earlier binary"
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _powers or _powers["up"].size < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _B), ("down", pow(_B, -1, 2**64))):
                _powers[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))
    return _powers["up"][:n], _powers["down"][:n]


def anchors(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """For each window: the place of its anchor. For each place: the hash of the anchor that starts there."""
    n = data.size
    up, down = _power(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
        h = (sums[anchor:] - sums[:-anchor]) * down[: n - anchor + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    least = h & np.uint64(2**64 - 2**_PLACE_BITS) | np.arange(h.size, dtype=np.uint64)
    windows, have = length - anchor + 1, 1
    while 2 * have <= windows:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < windows:
        least = np.minimum(least[: have - windows], least[windows - have :])
    return (least & np.uint64(2**_PLACE_BITS - 1)).astype(np.int64), h


def runs(data: bytes, length: int = LENGTH, anchor: int = ANCHOR, part: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """(first window, last window, anchor hash, hash of the run's bytes), slice by slice."""
    for at in range(0, max(0, len(data) - length + 1), part):
        piece = data[at : at + part + length - 1]
        place, h = anchors(np.frombuffer(piece, np.uint8), length, anchor)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.append(first[1:], place.size) - 1
        digest = xxhash.xxh3_64_intdigest
        own = [digest(piece[a : b + length]) for a, b in zip(first.tolist(), last.tolist())]
        yield first + at, last + at, h[place[first]], own


def _keys(docs: DataFrame) -> DataFrame:
    """d, h, doc_id, text: d and h name a row by id and text."""
    return row_keys(only(docs, "doc_id", "text")).select("d", "h", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def all_runs(docs: DataFrame, length: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        rows, kept = [], [[], [], [], []]
        for k, t in enumerate(texts_of(batch.column(2))):
            for parts in runs(t.encode(), length):
                rows.append(np.full(parts[0].size, k))
                for c, values in zip(kept, parts):
                    c.append(np.array(values, np.uint64) if c is kept[3] else values)
        flat = lambda c, kind: np.concatenate([*c, np.zeros(0, kind)]).astype(kind)
        at = pa.array(flat(rows, np.int64))
        return {"d": batch.column(0).take(at), "h": batch.column(1).take(at), "lo": flat(kept[0], np.int32), "hi": flat(kept[1], np.int32), "anchor": flat(kept[2], np.uint64).view(np.int64), "run": flat(kept[3], np.uint64).view(np.int64)}

    return by_batch(_keys(docs).select("d", "h", "text"), run, _RUNS)


def compressed(docs: DataFrame) -> DataFrame:
    """d, h, doc_id, z: texts compressed before they are shuffled."""

    def run(batch: pa.RecordBatch) -> dict:
        pack = zstandard.ZstdCompressor(level=1)
        return {n: batch.column(k) for k, n in enumerate(("d", "h", "doc_id"))} | {"z": [pack.compress(t.encode()) for t in texts_of(batch.column(3))]}

    return by_batch(_keys(docs), run, "d long, h long, doc_id long, z binary")


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``starts`` by their first ``length`` bytes, ties by place, and how many bytes each has in common
    with the one before, ``length`` at most (0 for the first).

    Prefix doubling: ranks of 8, 16, 32, ... bytes at every place; the same ranks, from long to short, then give the
    common prefixes of neighbours."""
    padded = np.concatenate([data, np.zeros(2 * length, np.uint8)])
    words = np.zeros(padded.size - 7, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | padded[k : padded.size - 7 + k]
    ranks, have = [np.unique(words, return_inverse=True)[1].astype(np.int64)], 8
    while 2 * have <= length:
        ranks.append(np.unique(ranks[-1][:-have] << 32 | ranks[-1][have:], return_inverse=True)[1].astype(np.int64))
        have *= 2
    key = ranks[-1][starts] << 32 | ranks[-1][starts + length - have]
    order = np.argsort(key, kind="stable")
    a, b, common = starts[order[:-1]], starts[order[1:]], np.zeros(max(0, starts.size - 1), np.int64)
    for rank in reversed(ranks):
        common += np.where(rank[a + common] == rank[b + common], have, 0)
        have //= 2
    differ = words[a + common] ^ words[b + common]
    for k in range(1, 8):
        common += differ >> np.uint64(64 - 8 * k) == 0
    return order, np.minimum(length, np.concatenate([[0][: starts.size], common]))


def smaller_before(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each entry of a suffix array, the bytes in common with the last entry before it that has a smaller place; 0
    without one. Each entry looks at the one before, and while that has a larger place, at what that looks at."""
    look, least = np.arange(-1, place.size - 1), common.copy()
    todo = np.flatnonzero(place[look] > place)
    todo = todo[todo > 0]
    while todo.size:
        at = look[todo]
        least[todo], look[todo] = np.minimum(least[todo], least[at]), look[at]
        todo = todo[look[todo] >= 0]
        todo = todo[place[look[todo]] > place[todo]]
    least[look < 0] = 0
    return least


def factors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start (ascending): its longest previous factor, that is the most bytes that it has in common with an
    earlier start, and the most that it has in common with any other start; ``length`` at most. The previous and the
    next smaller place in suffix order give the former, the neighbours the latter."""
    order, common = suffix_order(data, starts, length)
    after = np.concatenate([common[1:], [0][: starts.size]])
    previous, any_other = np.zeros(starts.size, np.int64), np.zeros(starts.size, np.int64)
    previous[order] = np.maximum(smaller_before(order, common), smaller_before(order[::-1], after[::-1])[::-1])
    any_other[order] = np.maximum(common, after)
    return previous, any_other


def ranges(flags: np.ndarray, shift: int = 0) -> bytes:
    """Maximal runs of true places as packed (first, last) pairs, counted from ``shift``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))) + shift
    return np.stack([edge[::2], edge[1::2] - 1], 1).astype("<i4").tobytes()


def partial(contents: DataFrame, length: int) -> DataFrame:
    """anchor, run, and the windows of the run (from 0) that occur in another run, or in an earlier one, of its
    anchor. ``contents``: rows of ``contents()``; those of an anchor and part stand together, in order of place."""
    names, types = arrow_fields(contents.sparkSession, _RANGES)

    def block(rows: list[tuple]) -> pa.RecordBatch:
        unique = list({row[:-1]: row for row in rows}.values())  # rows equal in id and text are given once each
        size = np.array([len(row[-1]) for row in unique])
        windows = size - length + 1
        owner = np.repeat(np.arange(size.size), windows)
        within = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        # places of different anchors are no matches of each other: their first bytes may agree, their windows can't
        previous, any_other = factors(np.frombuffer(b"".join(row[-1] for row in unique), np.uint8), (np.cumsum(size) - size)[owner] + within, length)
        ends = np.cumsum(windows)
        cut = [slice(e - w, e) for e, w in zip(ends.tolist(), windows.tolist())]
        shift = [row[3] for row in unique]
        columns = [row[0] for row in unique], [row[2] for row in unique], [ranges(any_other[c] >= length, k) for c, k in zip(cut, shift)], [ranges(previous[c] >= length, k) for c, k in zip(cut, shift)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= BLOCK and row[:2] != last:
                    yield block(rows)
                    rows, size = [], 0
                rows.append(row)
                size, last = size + len(row[-1]), row[:2]
        if rows:
            yield block(rows)

    ordered = contents.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "d", "h", "lo", "window")
    found = mapped(ordered.select("anchor", "part", "run", "window", "content"), run, _RANGES)
    joined = [F.expr(f"aggregate(collect_list({c}), X'', (a, x) -> concat(a, x))").alias(c) for c in ("repeated", "earlier")]
    return found.groupBy("anchor", "run").agg(*joined)


def contents(firsts: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """d, h, lo, anchor, part, run, window, content: the bytes of runs, cut from their documents. Where an anchor has
    several ``parts``, each window is a row of its own, in the part that its hash names: equal windows stay together."""
    wanted = firsts.groupBy("d", "h").agg(F.collect_list(F.struct("anchor", "run", "lo", "hi", "parts")).alias("runs"))
    joined = compressed(docs).drop("doc_id").join(wanted, ["d", "h"]).select("d", "h", "z", "runs")
    names, types = arrow_fields(docs.sparkSession, _CONTENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, out, size = zstandard.ZstdDecompressor(), [], 0

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            for d, h, z, rows in zip(*(c.to_pylist() for c in batch.columns)):
                data = unpack.decompress(z)
                for r in rows:
                    if r["parts"] == 1:
                        cut = [(0, 0, data[r["lo"] : r["hi"] + length])]
                    else:
                        cut = [(k, 0, data[r["lo"] + k : r["lo"] + k + length]) for k in range(r["hi"] - r["lo"] + 1)]
                        cut = [(k, xxhash.xxh3_64_intdigest(c) % r["parts"], c) for k, _, c in cut]
                    for k, part, content in cut:
                        out.append((d, h, r["lo"], r["anchor"], part, r["run"], k, content))
                        size += len(content)
                    if size >= BLOCK:
                        yield ready()
                        out, size = [], 0
        if out:
            yield ready()

    return mapped(joined, run, _CONTENTS)


def spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """d, h, spans: bytes (from, to) to remove from a row's text, not merged yet."""
    found = written(all_runs(docs, length), "runs")
    many = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("run").alias("a"), F.max("run").alias("b")).where("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("differ"))
    # a table of its own on either side of a join lets Spark split the partitions of common anchors
    again = written(found.join(written(many, "anchors"), "anchor"), "repeated-runs")
    place = F.struct("d", "h", "lo", "hi")
    equal = written(again.groupBy("anchor", "run").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.first("differ").alias("differ")), "equal-runs")
    differ = equal.where("differ")
    # each anchor's runs are counted before they are dealt out
    parts = differ.groupBy("anchor").agg(F.ceil(F.count("*") / VARIANTS).cast("int").alias("parts"))
    firsts = differ.join(written(parts, "parts"), "anchor").select("anchor", "run", "first.*", "parts")
    parts = partial(written(contents(firsts, docs, length), "contents"), length)
    verdict = equal.select("anchor", "run", "n", "first").join(written(parts, "ranges"), ["anchor", "run"], "left")
    own = F.struct("d", "h", "lo", "hi") == F.col("first")
    whole = (~own) if keep_first else (F.col("n") > 1)
    some = F.col("earlier") if keep_first else F.col("repeated")
    marked = again.drop("differ").join(written(verdict, "verdicts"), ["anchor", "run"]).select("d", "h", "lo", "hi", whole.alias("whole"), some.alias("some"))
    marked = marked.where("whole OR length(some) > 0")
    return marked.groupBy("d", "h").agg(F.collect_list(F.struct("lo", "hi", "whole", "some")).alias("spans"))


def merged(rows: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal (from, to) of the bytes that marked windows cover."""
    pairs = []
    for r in rows or []:
        if r["whole"]:
            pairs.append((r["lo"], r["hi"] + length))
        else:
            pairs += [(r["lo"] + a, r["lo"] + b + length) for a, b in np.frombuffer(r["some"], "<i4").reshape(-1, 2).tolist()]
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """``docs`` with ``text`` reduced to what stays; whole characters only: a character of which a byte goes, goes."""
    found = spans(docs, length, keep_first).toDF(*ROW_KEY, "__spans")
    rest = [c for c in docs.columns if c != "text"]
    joined = row_keys(docs, *ROW_KEY).join(found, list(ROW_KEY), "left").select("text", "__spans", *[F.col(f"`{c}`") for c in rest])
    kinds = dict(docs.dtypes)

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for text, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            cut = merged(rows, length)
            if cut:
                data, parts, at = text.encode(), [], 0
                for a, b in cut:
                    parts.append(data[at:a].decode(errors="ignore"))
                    at = b
                text = "".join([*parts, data[at:].decode(errors="ignore")])
            out.append(text)
        return {"text": out} | {c: batch.column(k + 2) for k, c in enumerate(rest)}

    short = ", ".join(f"`{c}` {kinds[c]}" for c in docs.columns)
    return by_batch(joined, run, short)


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, all places of a passage removed."""
    joined = compressed(docs).join(spans(docs, length), ["d", "h"], "left").select("doc_id", "z", "spans")

    def run(batch: pa.RecordBatch) -> dict:
        unpack, out = zstandard.ZstdDecompressor(), {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for z, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data, cut, parts, at = unpack.decompress(z), merged(rows, length), [], 0
            for a, b in cut:
                parts.append(data[at:a])
                at = b
            kept = b"".join([*parts, data[at:]])
            for n, v in zip(out, (len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest())):
                out[n].append(v)
        return {"doc_id": batch.column(0)} | out

    return by_batch(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
