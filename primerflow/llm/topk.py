"""Exact top-k inner-product search with a pivot-distance index.

Vectors become integers, ``floor(1024 * x)``. With one more component, the root of (largest squared norm - own
squared norm), all have the same norm, queries (with 0 there) keep their inner products, and a larger inner product
is a smaller distance: distance^2 = |q|^2 + largest - 2 * score. Vectors are keyed by their nearest pivot and their
distance to it; the distances around a pivot are cut into annuli of about equal counts, and of each annulus the least
and the largest distance to ``REFERENCES`` further pivots are known. A query is first compared with the annuli nearest
to it until they hold enough vectors, which bounds its k-th score from below; then with those of the others that the
triangle inequality does not exclude: |d(q, pivot) - d(x, pivot)| is at most d(q, x), for the own pivot and for each
reference. Inside a block the vectors are sorted by distance, and a query takes only the stretch that its bound leaves.
The bound has a margin for rounding, so no result is lost.

The numbers of pivots and annuli are the same at every size. Pivots come from the ``SAMPLE`` vectors with the smallest
hash of their id; every vector is indexed. The driver holds the pivots and, for at most ``PIVOTS`` * ``BINS`` distance
bins, their counts and bounds. Neighbouring annuli share a block of about ``BLOCK`` vectors; an annulus with more (one
that a third of all vectors are in, say) is dealt into several by hash. Queries are taken in chunks of up to
``QUERIES`` with the same nearest pivot, and only chunk and block numbers are joined.

How much the bound excludes depends on the vectors. Clustered ones are compared with a part of the rest (``compared``
counts the pairs; a test holds it under a half on 40 clusters). On the test tables' vectors, random directions in 64
dimensions, the tenth-best match is at 1.1 times the radius and all distances to a pivot lie within 1.41 +- 0.09 of it:
no triangle inequality excludes anything there, and the search costs what comparing all costs.

Vectors that are null or hold a null or non-finite component take no part, nor rows with a null id; empty vectors score
0. Vectors of different lengths are compared over the shorter one. A query's own row is never its result; other rows with
its id are, each row that shares an id is a candidate of its own, and each query row has its own results. Components
beyond 2**62 count as that, and scores beyond 64 bits as the nearest that fits; large ones are added as exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_fields, by_batch, mapped, only, written

SCALE, MOST = 1024, 2**62
SAMPLE, PIVOTS, REFERENCES, BINS, RINGS, LEAST, BLOCK = 2048, 64, 8, 1024, 128, 32, 4096
#: Vectors that a query sees before its bound is used, as a multiple of k; queries in a chunk.
FIRST, QUERIES = 8, 1024


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (packed 64-bit integers), n (components) of each vector that takes part."""

    def run(batch: pa.RecordBatch) -> dict:
        lists = batch.column(1)
        ok = np.array(lists.is_valid()) & np.array(batch.column(0).is_valid())
        lists = lists.filter(pa.array(ok))
        ids, ends = batch.column(0).filter(pa.array(ok)), np.asarray(lists.offsets)
        x = pc.fill_null(lists.values.cast(pa.float64()), float("nan")).to_numpy()
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        with np.errstate(invalid="ignore", over="ignore"):
            whole = np.clip(np.floor(scale * np.where(np.isfinite(x), x, 0)), -MOST, MOST).astype(np.int64)
        good = bad[ends[1:]] == bad[ends[:-1]]
        v = [whole[a:b].tobytes() for a, b, g in zip(ends[:-1], ends[1:], good) if g]
        return {"vec_id": ids.filter(pa.array(good)), "v": v, "n": (ends[1:] - ends[:-1])[good].astype(np.int32)}

    return by_batch(only(vectors, "vec_id", "embedding"), run, "vec_id long, v binary, n int")


def matrix(packed: list[bytes], size: int) -> np.ndarray:
    """Packed vectors as rows, zeros behind shorter ones."""
    if all(len(p) == 8 * size for p in packed):
        return np.frombuffer(b"".join(packed), "<i8").reshape(len(packed), size)
    out = np.zeros((len(packed), size), np.int64)
    for k, p in enumerate(packed):
        out[k, : len(p) // 8] = np.frombuffer(p, "<i8")
    return out


def products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of rows. ``exact``: floating point has them all."""
    if exact:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    whole = q.astype(object) @ x.astype(object).T
    return np.clip(whole, 1 - 2**63, 2**63 - 1).astype(np.int64) if whole.size else whole.astype(np.int64)


class Index:
    """What the driver knows of an index: pivots, the annuli around each, their counts and bounds."""

    def __init__(self, size: int, largest: float, pivots: np.ndarray):
        self.size, self.largest, self.pivots = size, largest, pivots
        self.width = 2 * np.sqrt(max(largest, 1.0)) / BINS * (1 + 1e-9)
        self.exact = largest < 2**52

    def lifted(self, m: np.ndarray, query: bool = False) -> np.ndarray:
        m = m.astype(float)
        last = np.zeros(len(m)) if query else np.sqrt(np.maximum(0, self.largest - (m * m).sum(1)))
        return np.concatenate([m, last[:, None]], 1)

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        square = (lifted**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(0, square))

    def bins(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest pivot, distance bin, and all distances."""
        d = self.distances(self.lifted(m))
        pivot = d.argmin(1)
        return pivot, np.minimum(BINS - 1, d[np.arange(len(m)), pivot] // self.width).astype(np.int64), d

    def cut(self, counts: dict[tuple[int, int], tuple[int, list[float], list[float]]]) -> None:
        """Annuli of about equal counts out of the bins: (pivot, bin) -> count, least and largest distances to the references."""
        total = sum(n for n, _, _ in counts.values())
        want = max(LEAST, -(-total // (len(self.pivots) * RINGS)))
        self.ring = np.zeros((len(self.pivots), BINS), np.int64)
        owner, low, high, held, near, far, block = [], [], [], [], [], [], []
        full = BLOCK
        for p in range(len(self.pivots)):
            start, n, least, most = 0, 0, [], []
            for b in range(BINS):
                if (p, b) in counts:
                    n += counts[p, b][0]
                    least.append(counts[p, b][1])
                    most.append(counts[p, b][2])
                if n >= want or (b == BINS - 1 and n):
                    self.ring[p, start : b + 1] = len(held)
                    # an annulus goes on in the block of the one before if both are around one pivot and the block has room
                    new = not owner or owner[-1] != p or full + n > BLOCK
                    block.append(block[-1] + 1 if new and block else 0 if new else block[-1])
                    full = n if new else full + n
                    owner.append(p)
                    low.append(start * self.width)
                    high.append((b + 1) * self.width)
                    held.append(n)
                    near.append(np.min(least, axis=0))
                    far.append(np.max(most, axis=0))
                    start, n, least, most = b + 1, 0, [], []
        self.owner, self.low, self.high, self.held = np.array(owner, np.int64), np.array(low), np.array(high), np.array(held, np.int64)
        count = min(REFERENCES, len(self.pivots))
        self.near, self.far = (np.array(x).reshape(len(held), count) for x in (near, far))
        self.block, self.salts = np.array(block, np.int64), np.maximum(1, -(-self.held // BLOCK))

    def slack(self) -> float:
        return 1e-6 * (1 + np.sqrt(self.largest))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No vector of an annulus is nearer to the query than this."""
        d = self.distances(self.lifted(queries, query=True))
        own = d[:, self.owner]
        out = np.maximum(own - self.high, self.low - own)
        for j in range(self.near.shape[1]):
            out = np.maximum(out, np.maximum(d[:, j : j + 1] - self.far[:, j], self.near[:, j] - d[:, j : j + 1]))
        return np.maximum(0, out - self.slack())

    def reach(self, queries: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """How far vectors with a score of at least ``worst`` can be; NaN for no bound, nor is there one beyond 52 bits."""
        square = (queries.astype(float) ** 2).sum(1) + self.largest - 2 * worst
        return np.where(np.isnan(worst) | (not self.exact), np.inf, np.sqrt(np.maximum(0, square)) * (1 + 1e-9) + self.slack())


def farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    """Points that are each as far as can be from those before."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    chosen, near = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def build(whole: DataFrame) -> tuple[Index, DataFrame]:
    """The index of ``integers``, and its blocks: block, salt, and rows sorted by distance: ids, vs, far."""

    def norms(batch: pa.RecordBatch) -> dict:
        size = max(batch.column(1).to_pylist())
        return {"size": [size], "largest": [float((matrix(batch.column(0).to_pylist(), size).astype(float) ** 2).sum(1).max())]}

    size, largest = by_batch(whole.select("v", "n"), norms, "size int, largest double").agg(F.max("size"), F.max("largest")).first()
    size, largest = size or 1, largest or 0.0
    sample = [bytes(r["v"]) for r in whole.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()]
    index = Index(size, largest, np.zeros((1, size + 1)))
    index.pivots = farthest_first(index.lifted(matrix(sample, size)), PIVOTS)
    references = min(REFERENCES, len(index.pivots))

    def bins(batch: pa.RecordBatch) -> dict:
        pivot, b, d = index.bins(matrix(batch.column(1).to_pylist(), size))
        out = {"vec_id": batch.column(0), "v": batch.column(1), "pivot": pivot.astype(np.int32), "bin": b.astype(np.int32), "far": d[np.arange(len(d)), pivot]}
        return out | {f"d{j}": d[:, j] for j in range(references)}

    placed = written(by_batch(whole.select("vec_id", "v"), bins, "vec_id long, v binary, pivot int, bin int, far double" + "".join(f", d{j} double" for j in range(references))), "placed")
    each = [f(f"d{j}") for f in (F.min, F.max) for j in range(references)]
    counts = placed.groupBy("pivot", "bin").agg(F.count("*"), *each).collect()
    index.cut({(r[0], r[1]): (r[2], list(r[3 : 3 + references]), list(r[3 + references :])) for r in counts})

    def rings(batch: pa.RecordBatch) -> dict:
        ring = index.ring[batch.column(2).to_numpy(), batch.column(3).to_numpy()]
        return {"block": index.block[ring].astype(np.int32), "salts": index.salts[ring].astype(np.int32), "vec_id": batch.column(0), "v": batch.column(1), "far": batch.column(4)}

    keyed = by_batch(placed.select("vec_id", "v", "pivot", "bin", "far"), rings, "block int, salts int, vec_id long, v binary, far double")
    salt = F.pmod(F.xxhash64("vec_id", "v"), F.col("salts")).cast("int")
    packed = keyed.groupBy("block", salt.alias("salt")).agg(F.sort_array(F.collect_list(F.struct("far", "vec_id", "v"))).alias("rows"))
    return index, written(packed.select("block", "salt", F.col("rows.vec_id").alias("ids"), F.col("rows.v").alias("vs"), F.col("rows.far").alias("far")), "index")


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if score.size > 4 * k:
        least = np.partition(score, score.size - k)[score.size - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(score.size)
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def _compare(index: Index, blocks: DataFrame, chunks: DataFrame, targets: DataFrame, k: int, compared: Accumulator | None) -> DataFrame:
    """q, vec_id, score: for each task, the k best of each query in the blocks that ``targets`` (chunk, block, salt) names.
    ``chunks``: chunk, qs, vs, worst."""
    size = index.size
    pairs = targets.join(chunks, "chunk").join(blocks, ["block", "salt"]).select("qs", F.col("queries").alias("vectors"), "worst", "block", "ids", "vs", "far")
    names, types = arrow_fields(targets.sparkSession, "q long, vec_id long, score long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for columns in zip(*batch.columns):
                qs, vectors, worst, block, ids, vs, far = (c.as_py() for c in columns)
                q, x, ids, far = matrix(vectors, size), matrix(vs, size), np.array(ids, np.int64), np.array(far)
                pivot = index.owner[np.searchsorted(index.block, block)]
                away = index.distances(index.lifted(q, query=True))[:, pivot]
                known = [np.nan if w is None else w for w in worst]
                for j, name in enumerate(qs):  # what this task has found may bound a query better than what was known
                    if name in best and best[name][1].size >= k:
                        known[j] = np.nanmax([known[j], float(best[name][1][-1])])
                reach = index.reach(q, np.array(known, float))
                a, b = np.searchsorted(far, away - reach - index.slack()), np.searchsorted(far, away + reach + index.slack(), side="right")
                some = np.flatnonzero(a < b)
                if not some.size:
                    continue
                if compared is not None:
                    compared.add(int((b - a)[some].sum()))
                first = int(a[some].min())
                scores = products(q[some], x[first : int(b[some].max())], index.exact)
                for j, row in zip(some.tolist(), scores):
                    row, own = row[a[j] - first : b[j] - first], ids[a[j] : b[j]]
                    old_ids, old = best.get(qs[j], (own[:0], row[:0]))
                    if old.size >= k:
                        hit = row >= old[-1]
                        row, own = row[hit], own[hit]
                        if not row.size:
                            continue
                    new_ids, new = np.concatenate([old_ids, own]), np.concatenate([old, row])
                    at = _best(new, new_ids, k)
                    best[qs[j]] = new_ids[at], new[at]
        if best:
            columns = np.repeat(list(best), [i.size for i, _ in best.values()]), np.concatenate([i for i, _ in best.values()]), np.concatenate([s for _, s in best.values()])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return mapped(pairs, run, ", ".join(f"{n} long" for n in names))


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query, k: int = 10, compared: Accumulator | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of each row for which ``is_query`` (a condition) holds.
    ``compared`` is raised by the pairs whose scores are computed."""
    whole = written(integers(vectors), "integers")
    index, blocks = build(whole)
    size, most = index.size, k + 1  # a query finds its own row too

    def placed(batch: pa.RecordBatch) -> dict:
        m = matrix(batch.column(1).to_pylist(), size)
        own = [int(np.clip(sum(int(c) ** 2 for c in row), 0, 2**63 - 1)) for row in m] if not index.exact else (m * m).sum(1)
        return {"query_id": batch.column(0), "v": batch.column(1), "own": own, "pivot": index.distances(index.lifted(m, query=True)).argmin(1).astype(np.int32)}

    rows = by_batch(whole.where(is_query).select("vec_id", "v"), placed, "query_id long, v binary, own long, pivot int")
    queries = written(rows.withColumn("q", F.monotonically_increasing_id()), "queries")
    counts = {r["pivot"]: r["count"] for r in queries.groupBy("pivot").count().collect()}
    split = F.create_map(*[F.lit(int(x)) for p, n in counts.items() for x in (p, -(-n // QUERIES))]) if counts else F.create_map(F.lit(0), F.lit(1))
    chunk = F.struct("pivot", F.pmod(F.xxhash64("q"), split[F.col("pivot")]).alias("part")).alias("chunk")

    def chunked(rows: DataFrame) -> DataFrame:
        packed = rows.groupBy(chunk).agg(F.collect_list(F.struct("q", "v", "worst")).alias("r"))
        return packed.select(F.xxhash64("chunk").alias("chunk"), F.col("r.q").alias("qs"), F.col("r.v").alias("queries"), F.col("r.worst").alias("worst"))

    def nearest(q: np.ndarray) -> np.ndarray:
        """Which annuli each query sees first: by bound, until they hold enough."""
        order = np.argsort(index.bounds(q), axis=1, kind="stable")
        enough = np.cumsum(index.held[order], axis=1) >= FIRST * most
        wanted = np.zeros(order.shape, bool)
        for k, (o, e) in enumerate(zip(order, enough)):
            wanted[k, o[: int(e.argmax()) + 1 if e.any() else o.size]] = True
        return wanted

    def named(start: bool):
        """Blocks that a chunk has to see: those of its queries' first annuli, or all others that no bound excludes."""

        def run(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"chunk": [], "block": [], "salt": []}
            for chunk, vectors, worst in zip(*(batch.column(c).to_pylist() for c in range(3))):
                q = matrix(vectors, size)
                first = {(int(index.block[r]), 0) for r in np.flatnonzero(nearest(q).any(0))}
                if not start:
                    reach = index.reach(q, np.array([np.nan if w is None else w for w in worst], float))
                    left = np.flatnonzero((index.bounds(q) <= reach[:, None]).any(0))
                    first = {(int(index.block[r]), s) for r in left for s in range(int(index.salts[r]))} - first
                for block, salt in sorted(first):
                    out["chunk"].append(chunk)
                    out["block"].append(block)
                    out["salt"].append(salt)
            return out

        return run

    schema = "chunk long, block int, salt int"
    all_chunks = written(chunked(queries.withColumn("worst", F.lit(None).cast("long"))), "chunks")
    begun = by_batch(all_chunks.select("chunk", "queries", "worst"), named(True), schema)
    start = written(_top(_compare(index, blocks, all_chunks, begun, most, compared), most), "first")
    worst = start.where(F.col("rank") == most).select("q", F.col("score").alias("worst"))
    bounded = written(chunked(queries.join(worst, "q", "left")), "chunks")
    more = _compare(index, blocks, bounded, by_batch(bounded.select("chunk", "queries", "worst"), named(False), schema), most, compared)
    found = _top(start.drop("rank").unionByName(more), most).join(queries.select("q", "query_id", "own"), "q")
    # the query's own row is one with its id and its own score; of equal ones any may go
    mine = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    gone = F.min(F.when(mine, F.col("rank"))).over(Window.partitionBy("q"))
    left = found.withColumn("gone", gone).where("gone IS NULL OR rank <> gone")
    rank = F.col("rank") - F.when(F.col("rank") > F.col("gone"), 1).otherwise(0)
    return left.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
