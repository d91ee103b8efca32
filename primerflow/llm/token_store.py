"""Token ids as binary shards, with constant-time access by document key.

A shard is two files. ``.ids`` has the raw ids of its documents one after another, little-endian, two bytes an
id where the vocabulary allows and else four. ``.idx`` has a minimal perfect hash of the document keys and, by
slot, a stored fingerprint, the place of the document's first id, and its count. Shards are ranges of doc_id in
ascending order, so the ids of all shards joined are those of all documents in order.

Each task writes its shard under a name of its own and renames it at the end: a task that runs again, or twice,
leaves the same files: a file that is there already is the same, and stays. ``catalog`` (Parquet) lists the keys by shard.

A null text counts as empty and has the end id alone. A null doc_id sorts first. Rows that share a doc_id are
told apart by their order (by text) and are each stored. Further columns are ignored. An empty table gives no
shard. A task holds one batch of texts and 24 bytes per document of its shard.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_fields, file_system, mapped, move, new_path, only, texts_of
from .library import library
from .perfect_hash import PerfectHash, fingerprint, key_of
from .vocab import tokenizer

_CATALOG = "shard int, doc_id long, repeat long"
_SUMS = "shard int, n_docs long, n_tokens long"
_READ = "doc_id long, start long, n_tokens long, ids binary"


@dataclass
class Store:
    path: str
    catalog: DataFrame


def write(docs: DataFrame, vocab: str, end_id: int = 0, path: str | None = None) -> Store:
    """Encodes ``text`` by a file of the tokenizers library (``library``) and writes the shards below ``path`` (a folder that all see)."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    wide = 4 if tokenizer(vocab).get_vocab_size(with_added_tokens=True) > 2**16 or end_id >= 2**16 else 2
    names, types = arrow_fields(spark, _CATALOG)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(path)
        task = TaskContext.get()
        number, own = task.partitionId(), f"{at}/.{task.partitionId():06d}-{task.taskAttemptId()}"
        encode, out = library(vocab).packed, None
        keys, counts, last, repeat = [], [], (), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(at)
                out = fs.open_output_stream(own + ".ids", compression=None)
            ids, texts, seen = batch.column(0).to_pylist(), texts_of(batch.column(1)), []
            for i in ids:
                repeat = repeat + 1 if (i,) == last else 0
                last = (i,)
                seen.append(repeat)
            for one in encode(texts):
                one = np.append(np.frombuffer(one, "<u4"), end_id)
                counts.append(one.size)
                out.write(one.astype(f"<u{wide}").tobytes())
            null = np.array([i is None for i in ids])
            keys.append(key_of(np.array([i or 0 for i in ids], np.int64), null, np.array(seen)))
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(ids), types[0]), batch.column(0), pa.array(seen, types[2])], names)
        if out is not None:
            out.close()
            with fs.open_output_stream(own + ".idx") as f:
                f.write(_index_bytes(np.concatenate(keys), np.array(counts, np.int64), wide))
            for kind in ("ids", "idx"):
                move(fs, f"{own}.{kind}", f"{at}/{number:06d}.{kind}")

    ordered = only(docs, "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    catalog = f"{path}/catalog"
    mapped(ordered, shard, _CATALOG, keeps=True).write.parquet(catalog)
    return Store(path, spark.read.schema(_CATALOG).parquet(catalog))


def _index_bytes(keys: np.ndarray, counts: np.ndarray, wide: int) -> bytes:
    """A line of JSON with the lengths of the parts, then the parts."""
    found = PerfectHash.build(keys)
    slot = found.slots(keys)
    prints, places, sizes = np.zeros(keys.size, "<u4"), np.zeros(keys.size, "<i8"), np.zeros(keys.size, "<i8")
    prints[slot], places[slot], sizes[slot] = fingerprint(keys), np.cumsum(counts) - counts, counts
    parts = [x.tobytes() for x in (found.sizes.astype("<i8"), found.words.astype("<u8"), found.left.astype("<u8"), prints, places, sizes)]
    head = {"wide": wide, "docs": int(keys.size), "tokens": int(counts.sum()), "parts": [len(p) for p in parts]}
    return json.dumps(head).encode() + b"\n" + b"".join(parts)


class Shard:
    """One shard, opened: the index in memory, ids read at their place."""

    def __init__(self, path: str, number: int):
        fs, at = file_system(path)
        with fs.open_input_file(f"{at}/{number:06d}.idx") as f:
            data = f.read()
        end = data.index(b"\n")
        self.head = json.loads(data[:end])
        cut = np.cumsum([end + 1, *self.head["parts"]])
        part = [np.frombuffer(data[a:b], kind) for a, b, kind in zip(cut[:-1], cut[1:], ("<i8", "<u8", "<u8", "<u4", "<i8", "<i8"))]
        self.hash, self.prints, self.places, self.sizes = PerfectHash(*part[:3]), *part[3:]
        self.file = fs.open_input_file(f"{at}/{number:06d}.ids")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first id and count of ids for each key; place -1 for keys that the shard doesn't have."""
        slot = self.hash.slots(keys)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == fingerprint(keys[known])
        return np.where(known, self.places[slot], -1), np.where(known, self.sizes[slot], 0)

    def ids(self, place: int, count: int) -> np.ndarray:
        wide = self.head["wide"]
        self.file.seek(place * wide)
        return np.frombuffer(self.file.read(count * wide), f"<u{wide}").astype("<u4")


class Shards:
    """The shards of a store that a task has open, a few at a time."""

    def __init__(self, path: str, most: int = 4):
        self.path, self.most, self.open = path, most, OrderedDict()

    def __getitem__(self, number: int) -> Shard:
        if number not in self.open:
            if len(self.open) >= self.most:
                self.open.popitem(last=False)[1].file.close()
            self.open[number] = Shard(self.path, number)
        self.open.move_to_end(number)
        return self.open[number]


def totals(store: Store) -> list[int]:
    """Ids in all shards before each shard: one number a shard, from the heads of the index files."""
    path = store.path
    names, types = arrow_fields(store.catalog.sparkSession, _SUMS)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = file_system(path)
        for batch in batches:
            rows = []
            for n in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{at}/{n:06d}.idx") as f:
                    data = f.read(4096)
                head = json.loads(data[: data.index(b"\n")])
                rows.append((n, head["docs"], head["tokens"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)

    sums = sorted(tuple(r) for r in mapped(store.catalog.select("shard").distinct(), heads, _SUMS).collect())
    out, before = [0] * (sums[-1][0] + 1 if sums else 0), 0
    for n, _, tokens in sums:
        out[n], before = before, before + tokens
    return out


def read(store: Store) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (packed, 32 bits each), found by key in the files."""
    spark, before, path = store.catalog.sparkSession, totals(store), store.path
    names, types = arrow_fields(spark, _READ)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(path)
        for batch in batches:
            number, repeat = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            null = np.array(batch.column(1).is_null())
            keys = key_of(batch.column(1).fill_null(0).to_numpy(), null, repeat)
            start, size, ids = np.zeros(keys.size, np.int64), np.zeros(keys.size, np.int64), [b""] * keys.size
            for n in np.unique(number).tolist():
                rows = np.flatnonzero(number == n)
                place, count = shards[n].find(keys[rows])
                if (place < 0).any():
                    raise KeyError(f"shard {n} lacks a document that its catalog names")
                start[rows], size[rows] = place + before[n], count
                for r, p, c in zip(rows.tolist(), place.tolist(), count.tolist()):
                    ids[r] = shards[n].ids(p, c).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, t) for c, t in zip((start, size, ids), types[1:]))], names)

    return mapped(store.catalog, look_up, _READ)


def digests(store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    return read(store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
