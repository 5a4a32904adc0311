"""Approximate nearest neighbours by largest inner product: vantage-point trees, one for each shard.

Adding a coordinate that brings every vector to the largest norm turns the largest inner product into the smallest
distance, so the triangle inequality applies. A shard holds its distinct vectors in a tree; equal vectors are one entry
with their ids. Leaves are visited in order of the distance that the inequality allows at least, and a query stops when
that, times a factor, exceeds the distance of its k-th best. With factor 1 the search is exact; a larger one prunes more.

Matrix products only choose: whatever comes within their rounding error of a query's k-th best is scored once more by one
fixed sum, by which ranks and ties are decided. Vectors are dealt to shards and trees built once, in a stored table;
queries are broadcast in blocks of a bounded number, each held against all trees, and Spark merges the shards' best.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import scratch, stored

K = 20
EVERY = 20
FACTOR = 1.0
#: Vectors in a shard, on average, and fewer where they are so long that a shard would pass SHARD_BYTES; in a leaf, at
#: most; queries broadcast at once, and those of them that a shard searches side by side.
SHARD_ROWS, SHARD_BYTES, LEAF_ROWS, QUERY_BLOCK, QUERY_STEP = 8192, 8 << 20, 128, 4096, 256


def _by_length(ids: pa.Array, column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length of the vectors -> (their ids, their matrix). Of the rows with one id, the smallest vector takes part."""
    ids, length = ids.to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    distinct, count = np.unique(ids, return_counts=True)
    if len(distinct) < len(ids):
        keep = ~np.isin(ids, distinct[count > 1])
        least: dict[int, tuple] = {}
        for i in np.flatnonzero(~keep).tolist():
            least[int(ids[i])] = min(least.get(int(ids[i]), (column[i].as_py(), i)), (column[i].as_py(), i))
        keep[[i for _, i in least.values()]] = True
        rows = pa.array(np.flatnonzero(keep))
        ids, length, column = ids[keep], length[keep], column.take(rows)
    out = {}
    for n in np.unique(length).tolist():
        own = column.filter(pa.array(length == n))
        out[int(n)] = ids[length == n], own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), int(n))
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is not null, not zero, and has neither null nor non-finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col("embedding")
    return vectors.where(F.coalesce(F.forall(v, lambda x: F.coalesce(fine(x), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False)))


class Tree:
    """Distinct vectors in leaves, each with the distances it may have to the vantage points above it."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF_ROWS):
        self.vantages, self.leaves = [], []
        rng = np.random.default_rng(len(points))
        todo = [(np.arange(len(points)), [])]
        while todo:
            rows, bounds = todo.pop()
            if len(rows) <= leaf:
                self.leaves.append((rows, bounds))
                continue
            vantage = points[rng.choice(rows)]
            d = np.sqrt(((points[rows] - vantage) ** 2).sum(axis=1))
            order = np.argsort(d, kind="stable")
            half = len(rows) // 2
            v = len(self.vantages)
            self.vantages.append(vantage)
            for part in (order[:half], order[half:]):
                todo.append((rows[part], [*bounds, (v, d[part].min(), d[part].max())]))

    def least(self, queries: np.ndarray) -> np.ndarray:
        """For each query and leaf, the distance that the triangle inequality allows at least."""
        out = np.zeros((len(queries), len(self.leaves)))
        if self.vantages:
            v = np.array(self.vantages)
            d = np.sqrt(np.maximum((queries**2).sum(axis=1)[:, None] + (v**2).sum(axis=1) - 2 * queries @ v.T, 0))
            for j, (_, bounds) in enumerate(self.leaves):
                for i, low, high in bounds:
                    np.maximum(out[:, j], np.maximum(low - d[:, i], d[:, i] - high), out=out[:, j])
        return out


class Shard:
    """A tree over the distinct vectors of one length; `top` is a bound on all norms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float):
        order = np.argsort(ids, kind="stable")
        points, group = np.unique(vectors[order], axis=0, return_inverse=True)
        group = group.reshape(-1)
        members = np.argsort(group, kind="stable")  # ids of equal vectors, ascending
        self.points, self.top = np.ascontiguousarray(points), top
        self.ids, self.cut = ids[order][members], np.searchsorted(group[members], np.arange(len(points) + 1))
        lift = np.sqrt(np.maximum(top * top - (points**2).sum(axis=1), 0))
        self.tree = Tree(np.column_stack([points, lift]))

    def _near(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, point), ordered by query, of all points that may be among a query's k + 1 best."""
        norm = np.sqrt((queries**2).sum(axis=1))
        base = norm**2 + self.top**2  # squared distance = base - 2 * inner product
        unit = (queries.shape[1] + 8) * np.finfo(np.float64).eps
        slack, off = 4 * np.sqrt(unit) * (norm + self.top), 2 * unit * norm * self.top  # rounding of distances and products
        least = self.tree.least(np.column_stack([queries, np.zeros(len(queries))]))
        visit = np.argsort(least, axis=1)
        best = np.full((len(queries), k + 1), -np.inf)  # one more: the query itself may be among them
        active, seen = np.arange(len(queries)), []
        for step in range(len(self.tree.leaves)):
            leaf = visit[active, step]
            worst = np.sqrt(np.maximum(base[active] - 2 * best[active, -1], 0))
            on = ~(least[active, leaf] * factor > worst + slack[active]) | np.isinf(best[active, -1])
            active, leaf = active[on], leaf[on]
            if not len(active):
                break
            for j in np.unique(leaf):
                q, rows = active[leaf == j], self.tree.leaves[j][0]
                score = queries[q] @ self.points[rows].T
                high = np.concatenate([best[q], score], axis=1)
                best[q] = -np.partition(-high, k, axis=1)[:, : k + 1]
                best[q] = -np.sort(-best[q], axis=1)
                a, b = np.nonzero(score >= (best[q, -1] - 2 * off[q])[:, None])
                seen.append((q[a], rows[b], score[a, b]))
        query, point, score = (np.concatenate(x) for x in zip(*seen, strict=True))
        keep = score >= (best[:, -1] - 2 * off)[query]
        query, point = query[keep], point[keep]
        order = np.argsort(query, kind="stable")
        return query[order], point[order]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of each query's k best, best first, its own row left out."""
        for at in range(0, len(queries), QUERY_STEP):
            some = queries[at : at + QUERY_STEP]
            query, point = self._near(some, k, factor)
            first = np.searchsorted(query, np.arange(len(some) + 1))
            for i, own in enumerate(query_ids[at : at + QUERY_STEP]):
                rows = point[first[i] : first[i + 1]]
                score = (self.points[rows] * some[i]).sum(axis=1)  # the same sum for a vector wherever it lies
                count = self.cut[rows + 1] - self.cut[rows]
                few = np.minimum(count, k + 1)  # the smallest ids of each are enough
                spot = np.repeat(self.cut[rows] - np.cumsum(few) + few, few) + np.arange(few.sum())
                ids, score = self.ids[spot], np.repeat(score, few)
                ids, score = ids[ids != own], score[ids != own]
                order = np.lexsort((ids, -score))[:k]
                yield own, ids[order].astype(np.int64), score[order]


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, top: float, k: int, factor: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of each query's k best among the vectors, best first, its own row left out; top: a bound on all norms."""
    return Shard(ids, vectors, top).search(query_ids, queries, k, factor)


def _plant(table: pa.Table, top: float) -> pa.Table:
    shards = [Shard(ids, vectors, top) for ids, vectors in _by_length(table.column("vec_id").combine_chunks(), table.column("embedding").combine_chunks()).values()]
    return pa.table({"length": pa.array([s.points.shape[1] for s in shards], pa.int32()), "shard": pa.array([pickle.dumps(s, 5) for s in shards], pa.binary())})


def _search(batches: Iterator[pa.RecordBatch], shared, k: int, factor: float) -> Iterator[pa.RecordBatch]:
    queries = shared.value
    for batch in batches:
        for length, packed in zip(batch.column("length").to_pylist(), batch.column("shard"), strict=True):
            if length not in queries:
                continue
            got = list(pickle.loads(packed.as_buffer()).search(*queries[length], k, factor))
            yield pa.RecordBatch.from_pydict(
                {
                    "query_id": np.repeat([q for q, _, _ in got], [len(i) for _, i, _ in got]).astype(np.int64),
                    "vec_id": np.concatenate([i for _, i, _ in got]),
                    "score": np.concatenate([s for _, _, s in got]),
                }
            )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries, the k rows of vectors with the largest inner product, best
    first, ties to the smaller vec_id, a row with the query's own vec_id left out.

    Vectors that are null, zero, or hold null or non-finite components take no part on either side, nor do rows with a
    null vec_id; if fewer than k others remain, all are returned. Both tables have vec_id and embedding; other columns are
    not read. Vectors of another length than a query's are no candidates of it. Of rows with the same vec_id on one side,
    the one whose vector is smallest (component by component from the first) takes part, so repeated rows count once. An empty table gives no rows."""
    spark = vectors.sparkSession
    rows = usable(vectors.where("vec_id IS NOT NULL")).select("vec_id", "embedding")
    asked = usable(queries.where("vec_id IS NOT NULL")).select("vec_id", "embedding")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    count, top, longest = rows.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("embedding"))).first()
    top, n_queries = (top or 0.0) * (1 + 1e-9), asked.count()
    shards = max(1, -(-count // max(1, min(SHARD_ROWS, SHARD_BYTES // (8 * (longest or 1))))))
    dealt = rows.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    trees = stored(dealt.applyInArrow(lambda table: _plant(table, top), "length int, shard binary"), "trees")
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    path = scratch(spark, "nearest")
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast(_by_length(block.column("vec_id").combine_chunks(), block.column("embedding").combine_chunks()))
        found = trees.mapInArrow(lambda it, s=shared: _search(it, s, k, factor), "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        ranked.write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema(ranked.schema).parquet(path)


def op9_vantage_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
