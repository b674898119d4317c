"""Nearest neighbours by inner product with vantage-point trees, one per shard.

The largest inner product becomes the least distance once every vector gets one more
coordinate that lifts it to the length of the longest. In a tree each node splits its
points by their distance from a vantage point; the triangle inequality bounds how near a
query can come to either side, and sides beyond `factor` times the distance of the
k-th best found so far are skipped. Factor one skips only what cannot matter, so the search
is exact; smaller factors skip more.

All queries of a block walk a tree together. A task carries what it has found from shard
to shard, so later shards are pruned harder, and it sends k rows per query however many
shards it reads.

Defined cases: vectors that are null, empty, zero or hold a null or a non-finite component, and rows
without an id, take no part. Vectors are compared with those of their own length. A
vector is no neighbour of a row with its own id; rows that repeat id and vector count
once. Ties go to the smaller id. Other columns are ignored.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablescope.llm.storage import written


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part, v as doubles."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    sound = "size(v) > 0 and forall(v, x -> x is not null and x - x = 0) and exists(v, x -> x <> 0)"
    return rows.where(sound).dropDuplicates(["id", "v"])


def build_index(vectors: DataFrame, shard_rows: int = 1024, leaf: int = 64) -> DataFrame:
    """One row per shard: dim, reach (greatest length of all vectors), ids, points and the nodes of the tree.

    Rows are dealt to shards by a hash of the id and the vector; a shard holds about `shard_rows`. Runs one job.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    total = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("reach")).first()
    shards = max(1, -(-total.n // shard_rows))
    reach = float(total.reach or 0.0)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        points = np.vstack(frame["v"].to_numpy()).astype(float)
        order, nodes = _tree(_lifted(points, reach), leaf)
        return pd.DataFrame({"dim": [points.shape[1]], "reach": [reach],
                             "ids": [frame["id"].to_numpy(np.int64)[order].tobytes()],
                             "points": [points[order].tobytes()], "nodes": [nodes.tobytes()]})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards))).withColumn("dim", F.size("v"))
    return dealt.groupBy("shard", "dim").applyInPandas(
        build, "dim int, reach double, ids binary, points binary, nodes binary")


def _lifted(points: np.ndarray, reach: float) -> np.ndarray:
    return np.column_stack([points, np.sqrt(np.maximum(0.0, reach * reach - (points * points).sum(axis=1)))])


def _tree(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the points along the leaves, and the nodes: begin, end, vantage point, middle, radii, children."""
    order, nodes = np.arange(len(points)), []
    todo = [(0, len(points), -1)]
    while todo:
        a, b, parent = todo.pop()
        number = len(nodes)
        if parent >= 0:
            nodes[parent][7 if nodes[parent][7] < 0 else 8] = number
        nodes.append([a, b, -1.0, b, 0.0, 0.0, 0.0, -1.0, -1.0])
        if b - a <= leaf:
            continue
        part = points[order[a:b]]
        far = ((part - part[0]) ** 2).sum(axis=1).argmax()  # a point at the rim splits well
        d = np.sqrt(((part - part[far]) ** 2).sum(axis=1))
        along = np.argsort(d, kind="stable")
        middle = (b - a) // 2
        if d[along[-1]] == d[along[0]]:  # equal points: one leaf
            continue
        vantage = order[a + far]
        order[a:b] = order[a:b][along]
        d = d[along]
        nodes[number][2:7] = [float(vantage), a + middle, d[middle - 1], d[middle], d[-1]]
        todo += [(a + middle, b, number), (a, a + middle, number)]
    place = np.empty(len(order))
    place[order] = np.arange(len(order))
    nodes = np.array(nodes, float).reshape(-1, 9)
    split = nodes[:, 2] >= 0
    nodes[split, 2] = place[nodes[split, 2].astype(np.int64)]
    return order, nodes


class _Search:
    """What a task has found for one block of queries: the k best (score, id) of each."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.ids, self.queries, self.k, self.factor = ids, queries, k, factor
        self.norms = (queries * queries).sum(axis=1)
        self.near = np.full((len(ids), k), np.inf)  # distances of the k best, ascending
        self.hits = np.zeros((0,), [("q", np.int64), ("id", np.int64), ("score", float)])

    def read(self, row: dict) -> None:
        self.reach = row["reach"]
        self.names = np.frombuffer(row["ids"], np.int64)
        self.points = np.frombuffer(row["points"], float).reshape(len(self.names), -1)
        self.nodes = np.frombuffer(row["nodes"], float).reshape(-1, 9)
        self.lift = np.sqrt(np.maximum(0.0, self.reach ** 2 - (self.points ** 2).sum(axis=1)))
        self.eps = 1e-7 * max(1.0, self.reach, float(np.sqrt(self.norms.max(initial=0.0))))
        everyone = np.arange(len(self.ids))
        self._walk(0, everyone, self._nearest)
        self.found = [self.hits]
        self._walk(0, everyone, self._collect)
        self._keep(np.concatenate(self.found))

    def _distance(self, q: np.ndarray, rows) -> np.ndarray:
        """Distances of the queries from lifted points; a query has no lift."""
        square = self.norms[q][:, None] + self.reach ** 2 - 2 * self.queries[q] @ self.points[rows].T
        return np.sqrt(np.maximum(0.0, square))

    def _walk(self, number: int, q: np.ndarray, at_leaf) -> None:
        a, b, vantage, middle, inner, outer, rim, left, right = self.nodes[number]
        if not len(q):
            return
        if vantage < 0:
            at_leaf(int(a), int(b), q)
            return
        d = self._distance(q, [int(vantage)])[:, 0]
        bounds = {int(left): d - inner, int(right): np.maximum(outer - d, d - rim)}
        nearer = d <= (inner + outer) / 2
        for child, mine in ((int(left), nearer), (int(right), ~nearer)):
            self._walk(child, q[mine & self._open(q, bounds[child])], at_leaf)
        for child, mine in ((int(left), ~nearer), (int(right), nearer)):
            self._walk(child, q[mine & self._open(q, bounds[child])], at_leaf)

    def _open(self, q: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return bound <= self.factor * self.near[q, -1] + self.eps

    def _nearest(self, a: int, b: int, q: np.ndarray) -> None:
        d = self._distance(q, slice(a, b))
        d[self.ids[q][:, None] == self.names[None, a:b]] = np.inf
        both = np.concatenate([self.near[q], d], axis=1)
        self.near[q] = np.sort(np.partition(both, self.k - 1, axis=1)[:, :self.k], axis=1)

    def _collect(self, a: int, b: int, q: np.ndarray) -> None:
        d = self._distance(q, slice(a, b))
        x, y = np.nonzero((d <= self.near[q, -1][:, None] + self.eps) & (self.ids[q][:, None] != self.names[None, a:b]))
        score = np.zeros(len(x))
        for j in range(self.points.shape[1]):  # in the order of the components
            score += self.queries[q[x], j] * self.points[a + y, j]
        hits = np.zeros(len(x), self.hits.dtype)
        hits["q"], hits["id"], hits["score"] = q[x], self.names[a + y], score
        self.found.append(hits)

    def _keep(self, hits: np.ndarray) -> None:
        hits = hits[np.lexsort((hits["id"], -hits["score"], hits["q"]))]
        begin = np.searchsorted(hits["q"], hits["q"], side="left")
        self.hits = hits[np.arange(len(hits)) - begin < self.k]


def search(index: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, block_rows: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query (id, v), nearest first.

    Queries go to the tasks in blocks of about `block_rows`, the bound of what is broadcast; each block is one pass
    over the index. Runs one job per block to fetch it.
    """
    spark = index.sparkSession
    blocks = max(1, -(-queries.count() // block_rows))
    parts = []
    for number in range(blocks):
        table = queries.where(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)) == number).toArrow()
        by_dim: dict[int, tuple[list, list]] = {}
        for i, v in zip(table["id"].to_pylist(), table["v"].to_pylist()):
            ids, rows = by_dim.setdefault(len(v), ([], []))
            ids.append(i)
            rows.append(v)
        sent = spark.sparkContext.broadcast({dim: (np.array(i), np.array(v, float)) for dim, (i, v) in by_dim.items()})

        def find(batches, sent=sent):
            open_: dict[int, _Search] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    if row["dim"] in sent.value:
                        if row["dim"] not in open_:
                            open_[row["dim"]] = _Search(*sent.value[row["dim"]], k, factor)
                        open_[row["dim"]].read(row)
            for s in open_.values():
                yield pa.RecordBatch.from_arrays([pa.array(s.ids[s.hits["q"]]), pa.array(s.hits["id"]), pa.array(s.hits["score"])],
                                                 names=["query_id", "vec_id", "score"])

        parts.append(index.mapInArrow(find, "query_id long, vec_id long, score double"))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, is_query: str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
            factor: float = 1.0) -> DataFrame:
    """The neighbours of the rows for which the SQL condition `is_query` on `id` holds, among all rows."""
    vectors = written(valid_vectors(df, id_col, vector_col), "vectors")
    index = written(build_index(vectors), "trees")
    return search(index, vectors.where(is_query), k, factor)
