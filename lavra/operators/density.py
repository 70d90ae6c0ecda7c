"""Density clusters (HDBSCAN) of a sample of bounded size.

Mutual reachability distances, their minimum spanning tree by Prim's rule, the tree of merges, condensed by the least cluster
size, and of that the clusters with the greatest excess of mass. Up to `ALONE` points all of it is done in one task. Beyond,
points are dealt to blocks by place, and a task takes two of them: the nearest points of each, then the spanning tree of both. An edge that is in no
such tree is the longest of a circle, so that the spanning tree of these trees' edges is that of all points. Pairs of blocks that are too far apart
for an edge of that tree are left out; where vectors don't cluster none are, and the work is quadratic and spread. What one task gets is the tree itself,
from edges that were thinned before, and no vectors. A sample beyond a stated `most` is an error, never a cut."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.operators.features import hdbscan_size, kmeans, unstable
from lavra.runtime import materialise

ALONE = 20_000  # rows whose distances one task takes
BLOCK = 1024  # rows of a block, about, where there are more
NEAR = 12  # blocks that each block is tied to before others are left out


def spanning_tree(x: np.ndarray, dense: int) -> np.ndarray:
    """(a, b, distance) of the minimum spanning tree under mutual reachability, by distance. Row by row, so that no matrix of all pairs is held."""
    n = len(x)
    far = lambda i: np.sqrt(((x - x[i]) ** 2).sum(1))
    return joined(x, np.array([np.partition(far(i), min(dense, n) - 1)[min(dense, n) - 1] for i in range(n)]))


def joined(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """`spanning_tree` of points whose distances to their `dense`th neighbour are known."""
    n, columns = len(x), np.ascontiguousarray(x.T)
    far = lambda i: np.sqrt(((columns - columns[:, i : i + 1]) ** 2).sum(0))
    best, from_, left = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    out, at = [], 0
    for _ in range(n - 1):
        left[at] = False
        reach = np.maximum(np.maximum(far(at), core), core[at])
        closer = left & (reach < best)
        best[closer], from_[closer] = reach[closer], at
        at = int(np.argmin(np.where(left, best, np.inf)))
        out.append((from_[at], at, best[at]))
    tree = np.array(out, float).reshape(-1, 3)
    return tree[np.argsort(tree[:, 2], kind="stable")]


def condensed(tree: np.ndarray, n: int, least: int) -> list[tuple[int, int, float, int]]:
    """(parent, child, 1 / distance, size): children are points (< n) that fall out of a cluster, or clusters (n is the root) of `least`
    points or more that a cluster splits into."""
    parent, members, merges = list(range(n)), {}, {}
    size = [1] * n

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, d in tree.tolist():
        a, b, new = find(int(a)), find(int(b)), len(parent)
        parent += [new]
        size += [size[a] + size[b]]
        parent[a] = parent[b] = new
        merges[new] = (a, b, d)

    def points(i: int) -> list[int]:
        todo, out = [i], []
        while todo:
            j = todo.pop()
            if j < n:
                out.append(j)
            else:
                todo += merges[j][:2]
        return out

    rows, names = [], n + 1
    work = [(len(parent) - 1, n)] if merges else []
    while work:
        node, cluster = work.pop()
        while node >= n:
            a, b, d = merges[node]
            level = 1 / d if d > 0 else np.inf
            large = [c for c in (a, b) if size[c] >= least]
            if len(large) == 2:
                for c in (a, b):
                    rows.append((cluster, names, level, size[c]))
                    work.append((c, names))
                    names += 1
                break
            for c in (a, b):
                if c not in large:
                    rows += [(cluster, p, level, 1) for p in points(c)]
            if not large:
                break
            node = large[0]
    return rows


def labels(x: np.ndarray, least: int, dense: int) -> np.ndarray:
    """The cluster of each point from 0, -1 for noise."""
    return np.full(len(x), -1) if len(x) < max(2, least) else tree_labels(spanning_tree(x, dense), len(x), least)


def tree_labels(tree: np.ndarray, n: int, least: int) -> np.ndarray:
    """`labels` from the spanning tree."""
    out = np.full(n, -1)
    rows = condensed(tree, n, least)
    finite = max([r[2] for r in rows if np.isfinite(r[2])], default=1.0)
    born, mass, below, fallen, above = {n: 0.0}, {}, {}, {}, {}
    for parent, child, level, size in rows:
        level = min(level, finite * 2)
        if child >= n:
            born[child] = level
            below.setdefault(parent, []).append(child)
            above[child] = parent
        fallen[parent] = fallen.get(parent, 0) + size
        mass[parent] = mass.get(parent, 0.0) + size * level
    stable = {c: mass.get(c, 0.0) - born[c] * fallen.get(c, 0) for c in born}
    chosen = set()
    for c in sorted(born, reverse=True):  # children have larger names
        kids = below.get(c, [])
        inner = sum(stable[k] for k in kids)
        if c != n and (not kids or stable[c] >= inner):
            chosen.add(c)
        else:
            stable[c] = inner
    top = {}
    for c in sorted(born):
        up = above.get(c)
        top[c] = top.get(up) if up is not None and top.get(up) is not None else (c if c in chosen else None)
    names = {c: i for i, c in enumerate(sorted({t for t in top.values() if t is not None}))}
    for parent, child, _, _ in rows:
        if child < n and top.get(parent) is not None:
            out[child] = names[top[parent]]
    return out


def _thinned(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The places of a spanning forest's edges, shortest first (Kruskal)."""
    up, out = {}, []

    def find(i: int) -> int:
        while (top := up.setdefault(i, i)) != i:
            up[i] = up[top]
            i = top
        return i

    order = np.argsort(d, kind="stable")
    for at, i, j in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        if (i := find(i)) != (j := find(j)):
            up[i] = j
            out.append(at)
    return np.array(out, np.int64)


def _nearest(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The k least squared distances of each x to the ys, infinite where there are fewer."""
    out = np.full((len(x), k), np.inf)
    for at in range(0, len(x), 256):
        far = np.zeros((len(x[at : at + 256]), len(y)))
        for i in range(x.shape[1]):
            far += (x[at : at + 256, i, None] - y[None, :, i]) ** 2
        out[at : at + 256, : min(k, len(y))] = np.partition(far, min(k, len(y)) - 1, axis=1)[:, :k]
    return out


def _cuts(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, value) of each node of a tree of `depth` levels that halves these points where they are widest."""
    dims, values, work = np.zeros((1 << depth) - 1, int), np.zeros((1 << depth) - 1), [(0, x)]
    while work:
        node, some = work.pop()
        if node < len(dims):
            if len(some):
                dims[node] = np.argmax(some.max(0) - some.min(0))
                values[node] = np.median(some[:, dims[node]])
            right = some[:, dims[node]] > values[node]
            work += [(2 * node + 1, some[~right]), (2 * node + 2, some[right])]
    return dims, values


def _outside(lo: np.ndarray, hi: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between boxes (or points, as boxes) lo..hi and x..y, a little less for what rounding does."""
    return np.sqrt((np.maximum(0, np.maximum(lo - y, x - hi)) ** 2).sum(-1)) * (1 - 1e-9)


def _closest(x: np.ndarray, core_x: np.ndarray, y: np.ndarray, core_y: np.ndarray) -> tuple[int, int, float]:
    """The places and the distance of a pair of points, one of each, at the least mutual reachability."""
    best = (0, 0, np.inf)
    for at in range(0, len(x), 256):
        far = np.zeros((len(x[at : at + 256]), len(y)))
        for i in range(x.shape[1]):
            far += (x[at : at + 256, i, None] - y[None, :, i]) ** 2
        far = np.maximum(np.maximum(np.sqrt(far), core_x[at : at + 256, None]), core_y[None, :])
        i, j = np.unravel_index(np.argmin(far), far.shape)
        best = min(best, (at + int(i), int(j), float(far[i, j])), key=lambda e: e[2])
    return best


def _limits(at: int, ways: list[list[tuple[int, float]]]) -> np.ndarray:
    """The longest edge on the way from a block to each other one, in a tree of blocks."""
    out, work = np.full(len(ways), -1.0), [at]
    out[at] = 0
    while work:
        i = work.pop()
        for j, d in ways[i]:
            if out[j] < 0:
                out[j] = max(out[i], d)
                work.append(j)
    return out


def _spread(rows: DataFrame, n: int, least: int, dense: int) -> DataFrame:
    """`clusters` of more points than one task should hold: point p of block b has the number b * 2^20 + p.

    Blocks are cells of a tree over a sample, which decides how much work there is and never the result. A block's nearest points are looked for
    where its box is near enough. Each block has a tree of its own; edges between near blocks tie these together, and the longest
    edge on the way between two blocks by this tree bounds what the spanning tree may have between them: farther blocks, and points
    farther from the other's box, are left out."""
    spark = rows.sparkSession
    dim = len(rows.first()["x"])
    depth = max(0, int(np.ceil(np.log2(n / BLOCK))))
    want = max(1000, min(20_000, 4_000_000 // dim))
    some = np.array([r["x"] for r in rows.select("x").sample(min(1.0, want / n), 42).collect()], float).reshape(-1, dim)
    dims, values = _cuts(some, depth)

    def leaves(frames):
        for frame in frames:
            x, at = np.array(frame["x"].tolist(), float).reshape(-1, dim), np.zeros(len(frame), int)
            for level in range(depth):
                node = (1 << level) - 1 + at
                at = 2 * at + (x[np.arange(len(x)), dims[node]] > values[node])
            yield frame.assign(leaf=at.astype(np.int32))

    kind = rows.schema["id"].dataType.simpleString()
    dealt = materialise(rows.mapInPandas(leaves, f"id {kind}, x array<double>, leaf int"), "leaves")
    sizes = dict(dealt.groupBy("leaf").count().collect())
    parts = np.array([-(-sizes.get(i, 0) // (2 * BLOCK)) for i in range(1 << depth)])  # of many equal points, too
    first = np.concatenate([[0], np.cumsum(parts)])[:-1].tolist()
    at = F.element_at(F.lit(first), F.col("leaf") + 1) + F.pmod(F.xxhash64("id", "x"), F.element_at(F.lit(parts.tolist()), F.col("leaf") + 1))
    blocks = dealt.withColumn("block", at.cast("int")).groupBy("block").agg(F.collect_list(F.struct("id", "x")).alias("p"))
    blocks = materialise(blocks.select("block", F.col("p.id").alias("ids"), F.flatten("p.x").alias("x")), "blocks")
    tasks = 8 * spark.sparkContext.defaultParallelism
    flat = lambda v: np.asarray(v, float).reshape(-1, dim)

    def own(frames):
        for frame in frames:
            for r in frame.itertuples():
                x = flat(r.x)
                far = _nearest(x, x, dense)
                yield pd.DataFrame({"block": [r.block], "at": [np.arange(len(x)).tolist()], "far": [far.tobytes()], "reach": [np.sqrt(far.max())], "lo": [x.min(0)], "hi": [x.max(0)]})

    alone = materialise(blocks.select("block", "x").repartition(tasks).mapInPandas(own, "block int, at array<int>, far binary, reach double, lo array<double>, hi array<double>"), "alone")
    boxes = alone.select("block", "reach", "lo", "hi").orderBy("block").toPandas()  # a row for each of BLOCK points
    names, lo, hi = boxes["block"].to_numpy(), np.array(boxes["lo"].tolist()), np.array(boxes["hi"].tolist())
    place = {int(b): i for i, b in enumerate(names)}
    reach = boxes["reach"].to_numpy()

    def pairs(near, each: DataFrame) -> DataFrame:
        """Both blocks of the pairs (block_a, block_b, bound), where `near` has the other blocks and bounds of a block's place."""

        def met(frames):
            for frame in frames:
                for b in frame["block"]:
                    others, bound = near(place[b])
                    yield pd.DataFrame({"block_a": np.full(len(others), b, np.int32), "block_b": names[others].astype(np.int32), "bound": bound})

        found = blocks.select("block").repartition(tasks).mapInPandas(met, "block_a int, block_b int, bound double")
        for e in "ab":
            found = found.join(each.select(*(F.col(c).alias(f"{c}_{e}") for c in each.columns)), f"block_{e}")
        return found.repartition(tasks)

    def reached(i: int):
        far = _outside(lo[i], hi[i], lo, hi)
        others = np.flatnonzero((far < reach[i]) & (np.arange(len(names)) != i))
        return others, np.zeros(len(others))

    def cores(frames):
        for frame in frames:
            for r in frame.itertuples():
                x, y = flat(r.x_a), flat(r.x_b)
                kth = np.sqrt(np.frombuffer(r.far_a).reshape(-1, dense).max(1))
                at = np.flatnonzero(_outside(x, x, y.min(0), y.max(0)) < kth)
                if len(at):
                    yield pd.DataFrame({"block": [r.block_a], "at": [at.tolist()], "far": [_nearest(x[at], y, dense).tobytes()]})

    def core(frame: pd.DataFrame) -> pd.DataFrame:
        best = np.full((max(map(len, frame["at"])), dense), np.inf)
        for at, far in zip(frame["at"], frame["far"]):
            best[at] = np.partition(np.concatenate([best[at], np.frombuffer(far).reshape(-1, dense)], axis=1), dense - 1, axis=1)[:, :dense]
        return pd.DataFrame({"block": frame["block"][:1], "core": [np.sqrt(best.max(1))]})

    with_far = blocks.select("block", "x").join(alone.select("block", "far"), "block")
    more = pairs(reached, with_far).mapInPandas(cores, "block int, at array<int>, far binary")
    known = alone.select("block", "at", "far").union(more).groupBy("block").applyInPandas(core, "block int, core array<double>")
    known = materialise(blocks.select("block", "x").join(known, "block"), "cores")

    edge = "first int, second int, a long, b long, d double"

    def local(frames):
        for frame in frames:
            for r in frame.itertuples():
                tree = joined(flat(r.x), np.asarray(r.core))
                a, b = ((r.block << 20) + tree[:, i].astype(int) for i in (0, 1))
                yield pd.DataFrame({"first": r.block, "second": r.block, "a": a, "b": b, "d": tree[:, 2]})

    def closest(frames):
        for frame in frames:
            for r in frame.itertuples():
                i, j, d = _closest(flat(r.x_a), np.asarray(r.core_a), flat(r.x_b), np.asarray(r.core_b))
                yield pd.DataFrame({"first": [r.block_a], "second": [r.block_b], "a": [(r.block_a << 20) + i], "b": [(r.block_b << 20) + j], "d": [d]})

    def neighbours(i: int):
        """The nearest blocks after this one, and the next one in order, so that all are tied."""
        far = _outside(lo[i], hi[i], lo, hi) + 1e-3 * np.sqrt((((lo[i] + hi[i]) - (lo + hi)) ** 2).sum(1))
        far[i] = np.inf
        others = np.argsort(far)[: min(NEAR, len(far) - 1)]
        others = np.unique(np.append(others, i + 1)) if i + 1 < len(far) else np.unique(others)
        return others, np.zeros(len(others))

    inner = materialise(known.repartition(tasks).mapInPandas(local, edge), "inner")
    ties = materialise(pairs(neighbours, known).mapInPandas(closest, edge), "ties")
    longest = np.zeros(len(names))
    for r in inner.groupBy("first").agg(F.max("d").alias("d")).collect():
        longest[place[r["first"]]] = r["d"]
    tied = ties.select("first", "second", "d").toPandas()  # a few for each block
    a, b = (tied[c].map(place).to_numpy(int) for c in ("first", "second"))
    d = np.maximum(tied["d"].to_numpy(), np.maximum(longest[a], longest[b]))
    ways: list[list[tuple[int, float]]] = [[] for _ in names]
    for e in _thinned(a, b, d).tolist():
        ways[a[e]].append((int(b[e]), float(d[e])))
        ways[b[e]].append((int(a[e]), float(d[e])))

    def bounded(i: int):
        most = _limits(i, ways)
        others = np.flatnonzero((_outside(lo[i], hi[i], lo, hi) <= most) & (np.arange(len(names)) > i))
        return others, most[others]

    def trees(frames):
        for frame in frames:
            for r in frame.itertuples():
                x, y, core_x, core_y = flat(r.x_a), flat(r.x_b), np.asarray(r.core_a), np.asarray(r.core_b)
                i = np.flatnonzero((_outside(x, x, y.min(0), y.max(0)) <= r.bound) & (core_x <= r.bound))
                j = np.flatnonzero((_outside(y, y, x.min(0), x.max(0)) <= r.bound) & (core_y <= r.bound))
                if not len(i) or not len(j):
                    continue
                tree = joined(np.concatenate([x[i], y[j]]), np.concatenate([core_x[i], core_y[j]]))
                u, v = tree[:, 0].astype(int), tree[:, 1].astype(int)
                tree, u, v = (t[((u < len(i)) != (v < len(i))) & (tree[:, 2] <= r.bound)] for t in (tree, u, v))
                at = np.concatenate([(r.block_a << 20) + i, (r.block_b << 20) + j])
                yield pd.DataFrame({"first": r.block_a, "second": r.block_b, "a": at[u], "b": at[v], "d": tree[:, 2]})

    def thin(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.iloc[_thinned(frame["a"].to_numpy(), frame["b"].to_numpy(), frame["d"].to_numpy())]

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        frame = thin(frame)
        points, at = np.unique(np.concatenate([frame["a"], frame["b"]]), return_inverse=True)
        tree = np.column_stack([at[: len(frame)], at[len(frame) :], frame["d"]])
        return pd.DataFrame({"point": points, "cluster": tree_labels(tree, len(points), least)})

    edges = inner.union(ties).union(pairs(bounded, known).mapInPandas(trees, edge))
    fewer = materialise(edges.groupBy("first").applyInPandas(thin, edge), "edges")
    found = fewer.select("a", "b", "d").groupBy(F.lit(0).alias("sample")).applyInPandas(whole, "point long, cluster int")
    ids = blocks.select("block", F.posexplode("ids").alias("at", "id")).select(F.expr("shiftleft(cast(block as bigint), 20) + at").alias("point"), "id")
    return ids.join(found, "point").select("id", "cluster")


def clusters(vectors: DataFrame, least: int | None = None, dense: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", most: int | None = None) -> DataFrame:
    """(id, cluster) of a sample, of up to `most` rows if given; -1 is noise. `least` and `dense` come from the sample's size unless given."""
    n = vectors.count()
    if most is not None and n > most:
        raise ValueError(f"a sample of {n} rows is more than {most}")
    auto = hdbscan_size(max(1, n))
    size, near = least or auto[0], dense or auto[1]
    kind = vectors.schema[id_col].dataType.simpleString()

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        return pd.DataFrame({"id": frame["id"], "cluster": labels(np.array(frame["x"].tolist(), float), size, near)})

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    if n > ALONE:
        return _spread(rows, n, size, near)
    return rows.groupBy(F.lit(0).alias("sample")).applyInPandas(one, f"id {kind}, cluster int")


def semantic_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42) -> tuple[DataFrame, str]:
    """((id, cluster), how): density clusters, or k-means where these are unstable."""
    found = clusters(vectors, id_col=id_col, vector_col=vector_col)
    return (kmeans(vectors, None, id_col, vector_col, seed), "kmeans") if unstable(found) else (found, "density")
