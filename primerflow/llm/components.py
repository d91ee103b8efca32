"""Connected components of a graph given as edges, without gathering it anywhere.

Alternates two steps until nothing changes: every node hands its larger neighbours to the smallest node it knows,
then hands its smaller neighbours and itself to the smallest of them. What is left are stars around the smallest
node of each component. Tasks first reduce their own edges to a forest. Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges with the smallest node of its component, itself left out."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: a.size], ends[a.size :]
    label = np.arange(nodes.size)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(nodes.size)
    return nodes[own], nodes[label[own]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task as a forest, folded whenever enough have come together."""
    kept, size = [], 0
    for batch in batches:
        kept.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > 2_000_000:
            kept = [forest(*(np.concatenate(c) for c in zip(*kept)))]
            size = kept[0][0].size
    if size:
        u, v = forest(*(np.concatenate(c) for c in zip(*kept)))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """``u``, ``v``: each node that has an edge, but the smallest of its component, and that smallest node."""
    now = written(mapped(edges.select("u", "v").where("u <> v"), _local, "u long, v long").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
