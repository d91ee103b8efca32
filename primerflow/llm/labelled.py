"""A bounded sample of rows with their text features, gathered for fitting on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, only, release, texts_of, written
from .text_model import Words, in_parts


@dataclass
class Sample:
    """Rows in ascending order of a hash of the id: the same rows whatever the partitions."""

    ids: np.ndarray
    row: np.ndarray
    place: np.ndarray
    value: np.ndarray
    extra: dict[str, list]


def first_by_hash(df: DataFrame, size: int, *keep: str) -> DataFrame:
    """``size`` rows, those with the smallest hash of doc_id (a top-k, no sort of all rows)."""
    return df.where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id", *keep).limit(size)


def labelled(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """Up to ``size`` // 2 ids of either quality that are labelled and have a document, one row an id (its lowest
    label), and the weight that makes the classes as frequent as among all of these. All of them are counted."""
    one = only(labels, "doc_id", "quality").where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    one = one.join(only(docs, "doc_id"), "doc_id", "left_semi")
    counts = {r["quality"]: r["count"] for r in one.groupBy("quality").count().collect()}
    parts = [first_by_hash(one.where(F.col("quality") == q), size // 2).withColumn("weight", F.lit(counts.get(q, 0) / max(1, min(size // 2, counts.get(q, 0))))) for q in (0, 1)]
    return parts[0].unionByName(parts[1])


#: Features that a sample has at most; the rows with the smallest hashes of their ids come first.
FEATURES = 16_000_000
#: Parts in which the driver takes a sample in.
_PARTS = 8


def gather(docs: DataFrame, chosen: DataFrame, *columns: str) -> Sample:
    """Features of the chosen ids' documents, up to ``FEATURES`` of them. ``chosen`` has a bounded number of rows, so it is
    broadcast. Of rows that share an id, one is taken (the shortest text, then the first) before features are made, so that
    neither these nor what the driver takes in grow with the rows of an id."""
    own = docs.select("doc_id", "text", *[column_or_null(docs, c).alias(c) for c in columns])
    columns = (*columns, *[c for c in chosen.columns if c != "doc_id"])
    joined = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", *columns)
    kinds = dict(joined.dtypes)
    one = joined.groupBy("doc_id").agg(F.min(F.struct(F.length("text"), "text", *[F.col(f"`{c}`") for c in columns])).alias("r")).select("doc_id", *[F.col(f"r.`{c}`") for c in ("text", *columns)])
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes of text, but far more of features

    def run(batch: pa.RecordBatch) -> dict:
        place, value = [], []
        for _, part in in_parts([t.encode() for t in texts_of(batch.column(1))]):
            r, p, v = Words(part).features()
            cuts = np.searchsorted(r, np.arange(1, len(part)))
            place += [x.astype("<i4").tobytes() for x in np.split(p, cuts)]
            value += [x.astype("<f4").tobytes() for x in np.split(v, cuts)]
        return {"doc_id": batch.column(0), "place": place, "value": value} | {c: batch.column(2 + k) for k, c in enumerate(columns)}

    schema = "doc_id long, place binary, value binary" + "".join(f", `{c}` {kinds[c]}" for c in columns)
    made = written(by_batch(one.repartition(tasks, F.xxhash64("doc_id")), run, schema), "features")
    size = made.select("doc_id", F.length("place").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    taken = np.cumsum([0, *[r["n"] for r in size]])[:-1] < 4 * FEATURES
    fits = np.array([r["doc_id"] for r in size], np.int64)[taken]
    room = sum(r["n"] // 4 for r, t in zip(size, taken) if t)
    # filled in place: the driver holds the sample once
    row, place, value = np.empty(room, np.uint16 if fits.size <= 2**16 else np.int32), np.empty(room, np.int32), np.empty(room, np.float32)
    ids, extra, end = [], {c: [] for c in columns}, 0
    for part in np.array_split(np.sort(fits), _PARTS):
        rows = made.where(F.col("doc_id").isin(part.tolist())).collect() if part.size else []
        for r in sorted(rows, key=lambda r: r["doc_id"]):
            at = slice(end, end := end + len(r["place"]) // 4)
            row[at], place[at], value[at] = len(ids), np.frombuffer(r["place"], "<i4"), np.frombuffer(r["value"], "<f4")
            ids.append(r["doc_id"])
            for c in columns:
                extra[c].append(r[c])
        del rows
        release()
    return Sample(np.array(ids, np.int64), row, place, value, extra)


def held_out(ids: np.ndarray, salt: int = 0, share: int = 5) -> np.ndarray:
    """True for one in ``share`` of the ids, by their hash: they calibrate and don't fit."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(40)) % np.uint64(share) == 0


def column_or_null(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")
