"""Nearest neighbours by inner product with a vantage-point tree in each shard.

Inner products become distances by one more component, sqrt(M^2 - |x|^2) for a row x and 0 for a query, M being the
largest norm of all rows: the nearest row then has the largest inner product. Rows are indexed where they are read, `SHARD`
at a time, so that no key or group decides what meets in a task. A node keeps the range of distances from its vantage
point to each child; a child is left out where the triangle inequality shows it further than the k-th best so far. That
bound is divided by `factor`: 1 is an exact search, more visits less. Queries go in blocks to every lane of shards, a
stated set against all rows; scores that are returned are summed in double precision, component by component.

Vectors that are null, zero, of another length than the commonest (the longer of equally common ones), or hold null or non-finite components take no part, nor do null
ids. Repeated rows count once; of rows with one id and several vectors the best score counts. Ties go to the smaller
id. Fewer candidates than k are all returned. An empty table gives an empty result. The id and vector columns alone are
read, so others may have any name."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lavra.runtime import materialise

SHARD = 4096
LEAF = 128
BLOCK = 1024
LANE = 8  # shards a lane, on average


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): the rows that take part, in double precision."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where("id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")


@dataclass(frozen=True)
class Tree:
    ids: np.ndarray
    points: np.ndarray
    nodes: list  # (start, end, vantage, left, right, left range, right range); left -1 for a leaf; the vantage point is in the left child
    top2: float  # M squared


def build(ids: np.ndarray, points: np.ndarray, top2: float, leaf: int = LEAF) -> Tree:
    full = np.column_stack([points, np.sqrt(np.maximum(0, top2 - (points * points).sum(1)))])
    order, nodes = np.arange(len(ids)), []

    def grow(a: int, b: int) -> int:
        me = len(nodes)
        nodes.append(None)
        if b - a > leaf:
            own = full[order[a:b]]
            # The point furthest from the first one lies at a rim, where distances spread most.
            rim = own[int(np.argmax(((own - own[0]) ** 2).sum(1)))]
            d = np.sqrt(((own - rim) ** 2).sum(1))
            rank = np.argsort(d, kind="stable")
            half = int(np.searchsorted(d[rank], d[rank[(b - a) // 2]], side="left")) or int(np.searchsorted(d[rank], d[rank[0]], side="right"))
            if 0 < half < b - a:
                order[a:b] = order[a:b][rank]
                near, far = d[rank[:half]], d[rank[half:]]
                left = grow(a, a + half)
                right = grow(a + half, b)
                nodes[me] = (a, b, rim, left, right, (near[0], near[-1]), (far[0], far[-1]))
                return me
        nodes[me] = (a, b, None, -1, -1, None, None)
        return me

    if len(ids):
        grow(0, len(ids))
    return Tree(ids[order], points[order], nodes, top2)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added in the order of the components."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0, found: tuple[np.ndarray, np.ndarray] | None = None, shared: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of each query's k best rows but those of its own id: -inf and the largest long where there are fewer. `found`:
    the result over other trees, which this one adds to. `shared`: whether an id may stand in several rows."""
    n = len(ids)
    best, who = found or (np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max))
    if not len(tree.ids) or not n:
        return best, who
    norm2 = (queries * queries).sum(1)
    slack = 1e-9 * (1 + np.sqrt(norm2.max() * tree.top2) + tree.top2)

    def leaf(a: int, b: int, act: np.ndarray) -> None:
        rough = queries[act] @ tree.points[a:b].T
        rough[ids[act][:, None] == tree.ids[a:b]] = -np.inf
        rows, cols = np.nonzero(rough >= np.maximum(best[act, -1] - slack, -1e300)[:, None])
        if not len(rows):
            return
        # Old and new rows of the queries that got any, one flat table sorted by query, score and id; the first k of each stay.
        hit, at = np.unique(rows, return_inverse=True)
        own = act[hit]
        of = np.concatenate([np.repeat(np.arange(len(hit)), k), at])
        scores = np.concatenate([best[own].ravel(), exact_scores(queries[act[rows]], tree.points[a + cols])])
        names = np.concatenate([who[own].ravel(), tree.ids[a + cols]])
        if shared:  # an id may stand in several trees, or in one with several vectors; its best score counts
            order = np.lexsort((-scores, names, of))
            again = np.zeros(len(of), bool)
            again[order[1:]] = (of[order[1:]] == of[order[:-1]]) & (names[order[1:]] == names[order[:-1]]) & (names[order[1:]] != np.iinfo(np.int64).max)
            scores, names = np.where(again, -np.inf, scores), np.where(again, np.iinfo(np.int64).max, names)
        order = np.lexsort((names, -scores, of))
        pick = order[np.searchsorted(of[order], np.arange(len(hit)))[:, None] + np.arange(k)]
        best[own], who[own] = scores[pick], names[pick]

    def visit(node: int, act: np.ndarray) -> None:
        a, b, rim, left, right, near, far = tree.nodes[node]
        if left < 0:
            leaf(a, b, act)
            return
        full = np.sqrt(np.maximum(0, ((queries[act] - rim[:-1]) ** 2).sum(1) + rim[-1] ** 2))
        inside = full <= (near[1] + far[0]) / 2
        for first in (True, False):
            for child, (low, high), side in ((left, near, inside), (right, far, ~inside)):
                chosen = side if first else ~side
                # The k-th best may have improved meanwhile; without one the reach is unbounded.
                reach = np.sqrt(np.maximum(0, norm2[act] + tree.top2 - 2 * best[act, -1]) + slack) / factor
                go = chosen & (full - reach <= high) & (full + reach >= low)
                if go.any():
                    visit(child, act[go])

    visit(0, np.arange(n))
    return best, who


def _packed(rows: DataFrame, size: int, pack) -> DataFrame:
    """(key, blob): `pack` of each `size` rows (id, v) of a partition; keys are distinct."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, points, have = [], [], 0

        def out():
            i, p = np.concatenate(ids), np.concatenate(points)
            # Repeated rows count once.
            _, keep = np.unique(np.column_stack([i.view(np.float64)[:, None], p]).view(np.dtype((np.void, 8 * (p.shape[1] + 1)))).ravel(), return_index=True)
            blob = pickle.dumps(pack(i[keep], p[keep]), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq]), pa.array([blob], pa.binary())], ["key", "blob"])

        for batch in batches:
            i = batch.column(0).to_numpy()
            p = batch.column(1).flatten().to_numpy().reshape(len(i), -1) if len(i) else None
            at = 0
            while at < len(i):
                n = min(size - have, len(i) - at)
                ids.append(i[at : at + n])
                points.append(p[at : at + n])
                at, have = at + n, have + n
                if have == size:
                    yield out()
                    ids, points, have, seq = [], [], 0, seq + 1
        if have:
            yield out()

    return rows.mapInArrow(run, "key long, blob binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `vectors` with the largest inner products with each row of `queries`."""
    rows, asked = valid(vectors, id_col, vector_col), valid(queries, id_col, vector_col)
    facts = rows.groupBy(F.size("v").alias("d")).agg(F.max(F.expr("aggregate(v, 0d, (s, x) -> s + x * x)")).alias("top2"), F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d, top2, n = (facts["d"], facts["top2"] * (1 + 1e-12), facts["n"]) if facts else (0, 0.0, 0)
    # Only where ids repeat at all need those of a list be told apart.
    shared = not rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    trees = materialise(_packed(rows.where(F.size("v") == d), SHARD, lambda i, p: build(i, p, top2)), "trees")
    blocks = _packed(asked.where(F.size("v") == d), BLOCK, lambda i, p: (i, p))
    # As many lanes as run side by side while there are shards for them; beyond, `LANE` shards share one.
    beside = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = max(1, -(-n // (SHARD * LANE)), min(-(-n // SHARD), beside))
    dealt = trees.select(F.expr(f"pmod(xxhash64(key), {lanes})").alias("lane"), F.lit(0).alias("kind"), "blob")
    sent = blocks.select(F.explode(F.expr(f"sequence(0L, {lanes - 1}L)")).alias("lane"), F.lit(1).alias("kind"), "blob")

    def run(batches):
        lane, held = None, []
        for batch in batches:
            for at, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if at != lane:
                    lane, held = at, []
                if kind == 0:
                    held.append(pickle.loads(blob.as_buffer()))
                    continue
                # What the trees before found prunes the next one; a lane gives k rows a query.
                ids, points = pickle.loads(blob.as_buffer())
                found = None
                for tree in held:
                    found = search(tree, ids, points, k, factor, found, shared)
                if found is None:
                    continue
                best, who = found
                at_, col = np.nonzero(~np.isinf(best))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at_]), pa.array(who[at_, col]), pa.array(best[at_, col])], ["query_id", "vec_id", "score"])

    met = dealt.union(sent).repartition(lanes, "lane").sortWithinPartitions("lane", "kind").select("lane", "kind", "blob")
    found = met.mapInArrow(run, "query_id long, vec_id long, score double")
    if shared:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
