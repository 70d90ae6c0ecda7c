"""Hard negatives by a dual-tree search over anchors and candidates.

Candidates are indexed where they are read, up to `SHARD` rows a tree; anchors are packed into trees of up to `BLOCK`. A tree
splits by label first, then by balls. For a node of anchors and a node of candidates the inner products of all their pairs
lie within `c.c' +- (r|c'| + r'|c| + rr')`; a pair of nodes whose interval misses what its anchors still look for is left out
at once, with all anchors in it, and so is one whose labels can't match. Pairs of leaves are scored exactly, in integers.

The search runs twice: for the positives, whose scores state the windows, and for the negatives within those windows. It goes
by rounds of lanes, each eight times as many as all before it; a round passes its k-th scores on, so that lanes return the
rows that still count and not k rows a lane. Anchors are a stated query set that goes in blocks to every lane.

Rows with a null id, label or vector, no component, a null or non-finite component, or another length than the commonest (the longer of
equally common ones) take no part; zero vectors do. Of rows that share an id the least by label and vector stands. Repeated
vectors of one label tie everywhere, so a tree holds the smallest ids of them that any list could take and no more. Ties go
to the smaller id. Empty tables give empty results. Only the id, the label and the vector are read, so that other columns
may have any name. Scaled components beyond what keeps scores within 2^55 are an error."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.runtime import materialise

SHARD = 4096
BLOCK = 1024
LEAF = 128
LANE = 16  # shards a lane, on average, where there are more lanes than run side by side
FIRST = 64  # lanes of the first round
NONE = -(1 << 62)


def integral(vectors: DataFrame, id_col: str = "vec_id", label: Column | str = "label", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, v): the rows that take part, v holding floor(scale * x) of each component, x in double precision."""
    own = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), own.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return rows.withColumn("v", F.expr(f"transform(v, x -> cast(floor({scale} * x) as long))"))


def one_each(rows: DataFrame) -> DataFrame:
    """One row an id: the least by label and vector. Ids alone are shuffled where none is repeated."""
    if rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


@dataclass
class Node:
    """Rows `start` to `end` of a tree; `label` where they have one in common."""

    start: int
    end: int
    label: int | None
    centre: np.ndarray
    norm: float
    radius: float
    children: tuple[Node, ...] = ()


@dataclass
class Tree:
    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray  # small integers
    root: Node
    more: dict = field(default_factory=dict)  # further arrays by row


def build(ids: np.ndarray, labels: np.ndarray, points: np.ndarray, leaf: int = LEAF, **more: np.ndarray) -> Tree:
    order = np.lexsort((ids, labels))
    full, by = points.astype(np.float64), labels

    def grow(a: int, b: int) -> Node:
        own, kinds = full[order[a:b]], by[order[a:b]]
        centre = own.mean(0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(1).max()))
        pure = kinds[0] == kinds[-1]
        node = Node(a, b, int(kinds[0]) if pure else None, centre, float(np.sqrt(centre @ centre)), radius)
        if not pure:
            # The bound between two labels that is nearest to the middle.
            ends = np.nonzero(np.diff(kinds))[0] + 1
            cut = int(ends[np.argmin(np.abs(ends - (b - a) // 2))])
        elif b - a <= leaf or not radius:
            return node
        else:
            # Along the line from the centre to the furthest row; halves by rank.
            axis = own[int(np.argmax(((own - centre) ** 2).sum(1)))] - centre
            order[a:b] = order[a:b][np.argsort(own @ axis, kind="stable")]
            cut = (b - a) // 2
        node.children = (grow(a, a + cut), grow(a + cut, b))
        return node

    root = grow(0, len(ids))
    return Tree(ids[order], labels[order], points[order], root, {k: v[order] for k, v in more.items()})


def first_copies(ids: np.ndarray, labels: np.ndarray, points: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows that have fewer than `most` copies (label and vector) of smaller ids before them."""
    names = np.column_stack([labels[:, None], points]).astype(np.int64)
    _, kind = np.unique(np.ascontiguousarray(names).view(np.dtype((np.void, 8 * names.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, kind))
    start = np.r_[0, np.nonzero(np.diff(kind[order]))[0] + 1]
    at = np.arange(len(ids)) - np.repeat(start, np.diff(np.r_[start, len(ids)]))
    return np.sort(order[at < most])


@dataclass
class Search:
    """What the anchors of one tree look for: the best `k` rows in each of their windows `low` to `high` (rows, slots)."""

    anchors: Tree
    low: np.ndarray
    high: np.ndarray
    same: bool  # rows of the anchor's label, or else of any other
    k: int
    exact: bool = True  # whether scores are exact in double precision

    def __post_init__(self):
        n, slots = self.low.shape
        self.best, self.who = np.full((n, slots, self.k), NONE), np.full((n, slots, self.k), np.iinfo(np.int64).max)
        self.full = self.anchors.points.astype(np.float64 if self.exact else np.int64)
        self.pruned = self.scored = 0

    def least(self, a: int, b: int) -> np.ndarray:
        """The score that a row needs at least, for each anchor and slot; out of reach where a window is empty."""
        need = np.maximum(self.low[a:b], self.best[a:b, :, -1])
        return np.where(self.low[a:b] > self.high[a:b], np.iinfo(np.int64).max, need)

    def over(self, tree: Tree) -> None:
        held = tree.points.astype(self.full.dtype)
        self._visit(self.anchors.root, tree.root, tree, held)

    def _reach(self, a: Node, c: Node) -> tuple[float, float]:
        dot = float(a.centre @ c.centre)
        wide = a.radius * c.norm + c.radius * a.norm + a.radius * c.radius
        wide += 1e-9 * (1 + wide + a.norm * c.norm)
        return dot - wide, dot + wide

    def _visit(self, a: Node, c: Node, tree: Tree, held: np.ndarray) -> None:
        if a.label is not None and c.label is not None and (a.label == c.label) != self.same:
            return
        low, high = self._reach(a, c)
        if high < self.least(a.start, a.end).min() or low > self.high[a.start : a.end].max():
            self.pruned += (a.end - a.start) * (c.end - c.start)
            return
        if not a.children and not c.children:
            self._leaves(a, c, tree, held)
        elif a.children and (not c.children or a.radius >= c.radius):
            for x in a.children:
                self._visit(x, c, tree, held)
        else:
            # The nearer child first: what it gives prunes the other one.
            for x in sorted(c.children, key=lambda x: -float(a.centre @ x.centre)):
                self._visit(a, x, tree, held)

    def _leaves(self, a: Node, c: Node, tree: Tree, held: np.ndarray) -> None:
        own, there = slice(a.start, a.end), slice(c.start, c.end)
        scores = (self.full[own] @ held[there].T).astype(np.int64)
        self.scored += scores.size
        fits = self.anchors.ids[own][:, None] != tree.ids[there]
        if a.label is None or c.label is None:
            fits &= (self.anchors.labels[own][:, None] == tree.labels[there]) == self.same
        least = self.least(a.start, a.end)
        for slot in range(self.low.shape[1]):
            hit = fits & (scores >= least[:, slot, None]) & (scores <= self.high[own, slot, None])
            rows = np.nonzero(hit.any(1))[0]
            if len(rows):
                at = a.start + rows
                new = np.where(hit[rows], scores[rows], NONE)
                names = np.where(hit[rows], tree.ids[there], np.iinfo(np.int64).max)
                both, ids = np.concatenate([self.best[at, slot], new], 1), np.concatenate([self.who[at, slot], names], 1)
                pick = np.lexsort((ids, -both))[:, : self.k]
                self.best[at, slot], self.who[at, slot] = np.take_along_axis(both, pick, 1), np.take_along_axis(ids, pick, 1)

    def found(self) -> tuple[np.ndarray, ...]:
        """(anchor, slot, id, score) of all that was found."""
        at, slot, col = np.nonzero(self.best != NONE)
        return self.anchors.ids[at], slot.astype(np.int32), self.who[at, slot, col], self.best[at, slot, col]


def _packed(rows: DataFrame, size: int, pack) -> DataFrame:
    """(key, blob): `pack` of the columns of each `size` rows of a partition, as arrays; keys are distinct."""

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [c.flatten().to_numpy().reshape(batch.num_rows, -1) if pa.types.is_list(c.type) else c.to_numpy() for c in batch.columns]

    def run(batches: Iterator[pa.RecordBatch]):
        part, seq, have, held = TaskContext.get().partitionId(), 0, 0, []
        for batch in (*batches, None):
            at = 0
            while batch is not None and at < batch.num_rows:
                held.append(arrays(batch.slice(at, size - have)))
                have, at = have + len(held[-1][0]), at + len(held[-1][0])
                if have == size:
                    yield out(part, seq, held)
                    seq, have, held = seq + 1, 0, []
        if have:
            yield out(part, seq, held)

    def out(part, seq, held):
        blob = pickle.dumps(pack(*(np.concatenate(x) for x in zip(*held))), protocol=5)
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq]), pa.array([blob], pa.binary())], ["key", "blob"])

    return rows.mapInArrow(run, "key long, blob binary")


def _rounds(lanes: int) -> Iterator[tuple[int, int]]:
    """(first lane, lane behind the last) of each round."""
    start, end = 0, FIRST
    while start < lanes:
        yield start, min(end, lanes)
        start, end = end, end * 8


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first `k` rows of each anchor and slot."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Index:
    """Trees of all candidates, dealt to lanes."""

    trees: DataFrame  # lane, blob
    lanes: int
    width: int  # components of a vector
    kind: str  # of the stored components
    exact: bool


def index(rows: DataFrame, copies: int) -> Index:
    """Trees over `rows` (id, label, v), where they are; `copies` of equal rows stay."""
    facts = rows.groupBy(F.size("v").alias("d")).agg(F.max(F.expr("greatest(coalesce(array_max(v), 0L), -coalesce(array_min(v), 0L))")).alias("top"), F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d, top, n = (facts["d"], facts["top"], facts["n"]) if facts else (0, 0, 0)
    if top * top * max(d, 1) >= 1 << 55:
        raise ValueError(f"components up to {top} are too large for exact scores")
    kind = "int16" if top < 1 << 15 else "int32" if top < 1 << 31 else "int64"
    spark = rows.sparkSession
    beside = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Partitions of a few rows each would make trees of a few rows each.
    near = rows.where(F.size("v") == d).coalesce(max(spark.sparkContext.defaultParallelism, -(-n // SHARD)))

    def pack(ids, labels, points):
        keep = first_copies(ids, labels, points, copies)
        return build(ids[keep], labels[keep], points[keep].astype(kind))

    lanes = max(1, -(-n // (SHARD * LANE)), min(-(-n // SHARD), beside))
    trees = materialise(_packed(near, SHARD, pack).select(F.expr(f"cast(pmod(xxhash64(key), {lanes}) as int)").alias("lane"), "blob"), "hardneg-trees")
    return Index(trees, lanes, d, kind, top * top * max(d, 1) < 1 << 53)


def _search(held: Index, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, slot, id, score, rank): the `k` first rows in each of the windows of `anchors` (id, label, v, low, high), by rounds."""
    spark = anchors.sparkSession
    kind, exact, out, blocks = held.kind, held.exact, None, max(1, -(-anchors.count() // BLOCK))

    def pack(ids, labels, points, low, high):
        return build(ids, labels, points.astype(kind), 32, low=low, high=high)

    def run(batches):
        lane, trees = None, []
        for batch in batches:
            for at, sort, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if at != lane:
                    lane, trees = at, []
                got = pickle.loads(blob.as_buffer())
                if sort == 0:
                    trees.append(got)
                    continue
                job = Search(got, got.more["low"], got.more["high"], same, k, exact)
                for tree in trees:
                    job.over(tree)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in job.found()], ["anchor", "slot", "id", "score"])

    for start, end in _rounds(held.lanes):
        asked = anchors
        if out is not None:
            # Rows below the k-th one so far no longer count.
            floors = out.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("floors"))
            asked = anchors.join(floors.withColumnRenamed("anchor", "id"), "id", "left")
            asked = asked.withColumn("low", F.expr("transform(low, (x, i) -> greatest(x, coalesce(floors[i], x)))")).select("id", "label", "v", "low", "high")
        packed = _packed(asked.repartition(blocks, "id"), BLOCK, pack)
        sent = packed.select(F.explode(F.sequence(F.lit(start), F.lit(end - 1))).alias("lane"), F.lit(1).alias("kind"), "blob")
        dealt = held.trees.where(F.col("lane").between(start, end - 1)).select("lane", F.lit(0).alias("kind"), "blob")
        met = dealt.unionByName(sent).repartition(end - start, "lane").sortWithinPartitions("lane", "kind").select("lane", "kind", "blob")
        found = met.mapInArrow(run, "anchor long, slot int, id long, score long")
        found = found if out is None else found.unionByName(out.drop("rank"))
        out = materialise(_best(found, k), "hardneg-found")
    return out if out is not None else spark.createDataFrame([], "anchor long, slot int, id long, score long, rank int")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over `rows` (id, label, v) of integers: each anchor's
    first `positives` other rows of its label are its positives, and for each of them the first `negatives` rows of other labels
    whose score is from `low` to `high` hundredths of the positive's. Higher scores come first, then smaller ids. A positive of
    a negative score has an empty window."""
    rows = one_each(rows)
    held = index(rows, max(positives, negatives) + 1)
    anchors = materialise(rows.where(is_anchor).where(F.size("v") == held.width), "hardneg-anchors")
    wide = anchors.select("*", F.expr(f"array({NONE + 1}L)").alias("low"), F.expr(f"array({-NONE}L)").alias("high"))
    best = _search(held, wide, positives, True).select("anchor", F.expr("rank - 1").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # The window of a positive in integers: up to the next one from low / 100, down to the last one at high / 100.
    window = F.struct("slot", F.expr(f"-floor(-{low} * positive_score / 100BD)").cast("long").alias("low"), F.expr(f"floor({high} * positive_score / 100BD)").cast("long").alias("high"))
    windows = best.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", window))).alias("w"))
    empty = {"low": -NONE, "high": NONE}
    asked = anchors.join(windows.withColumnRenamed("anchor", "id"), "id").select(
        "id", "label", "v", *(F.array(*(F.coalesce(F.col("w")[i][x], F.lit(empty[x])) for i in range(positives))).alias(x) for x in empty)
    )
    found = _search(held, asked, negatives, False)
    out = found.join(best, ["anchor", "slot"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
