"""Truncated SVD of sparse and dense rows, and k-means by mini-batches.

The rows of a term table stay where they are; what goes to them is a thin matrix with a row a term, which the vocabulary bounds
(`CELLS` values at most, else an error). A pass multiplies each task's rows with it and sums the products by term, first in the
task, then by blocks of terms over all tasks, so that what is gathered is as large as the thin matrix. Directions come from a
randomised range finder with power iterations: each pass pulls them towards the strongest ones.

k-means goes by mini-batches: rows are dealt to batches by a hash of their id, written once by batch, and a batch moves each
centre by its own rate, the share of this batch among all rows that the centre has had. Several sets of starts go side by side
through the same passes; the one of least inertia over all rows is kept."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.runtime import materialise

CELLS = 4_000_000  # values of a thin matrix on the driver and with each task (32 MB)
BLOCK = 1024  # terms whose sums go together


def svd_size(rows: int, terms: int) -> int:
    """The usual number of directions."""
    return min(80, max(2, terms - 1), max(2, rows - 1))


# --- rows as arrays


def sparse_rows(weights: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, list[str]]:
    """((id, at, w) with each row's terms by their place, written once; the terms in order) of a long table (id, term, w). A row has
    as many terms as the vocabulary at most."""
    terms = [r["term"] for r in weights.select("term").distinct().orderBy("term").collect()]  # a vocabulary
    spark = weights.sparkSession
    places = spark.createDataFrame(list(enumerate(terms)), "at int, term string")
    each = weights.join(F.broadcast(places), "term").groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("x"))
    rows = each.select("id", F.col("x.at").alias("at"), F.col("x.w").cast("array<double>").alias("w"))
    return materialise(rows, "sparse-rows"), terms


def _parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each value, place, value) of a batch (id, at, w)."""
    at, w = batch.column(1), batch.column(2)
    sizes = np.diff(at.offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), sizes), at.flatten().to_numpy(), w.flatten().to_numpy()


def _times(batch: pa.RecordBatch, thin: np.ndarray) -> np.ndarray:
    """The rows of a batch times a matrix with a row a term."""
    row, at, w = _parts(batch)
    out = np.zeros((batch.num_rows, thin.shape[1]))
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    if len(row):
        out[row[starts]] = np.add.reduceat(thin[at] * w[:, None], starts, axis=0)
    return out


def _summed(partial: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of blocks (block, sums) that tasks have made, added up by block where they meet."""

    def add(batches: Iterator[pa.RecordBatch]):
        at, total = None, None
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(blob.as_buffer())
                if block != at:
                    if at is not None:
                        yield out(at, total)
                    at, total = block, own.copy()
                else:
                    total += own
        if at is not None:
            yield out(at, total)

    def out(block, total):
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "sums"])

    blocks = partial.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, sums binary")
    whole = np.zeros(shape)
    for r in blocks.toLocalIterator():  # as large as the thin matrix in all
        own = np.frombuffer(r["sums"]).reshape(-1, shape[1])
        whole[r["block"] * BLOCK : r["block"] * BLOCK + len(own)] = own
    return whole


def _gram(rows: DataFrame, thin: np.ndarray) -> np.ndarray:
    """A'A times a matrix with a row a term, A being the rows (id, at, w): one pass."""
    held = rows.sparkSession.sparkContext.broadcast(thin)

    def run(batches: Iterator[pa.RecordBatch]):
        mine = held.value
        total = np.zeros(mine.shape)
        for batch in batches:
            y = _times(batch, mine)
            row, at, w = _parts(batch)
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.diff(at[order], prepend=-1))
            if len(at):
                total[at[order][starts]] += np.add.reduceat(y[row[order]] * w[order][:, None], starts, axis=0)
        blocks = range(0, len(total), BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([a // BLOCK for a in blocks], pa.int32()), pa.array([total[a : a + BLOCK].tobytes() for a in blocks], pa.binary())], ["block", "sums"])

    out = _summed(rows.mapInArrow(run, "block int, sums binary"), thin.shape)
    held.unpersist()
    return out


def directions(rows: DataFrame, terms: int, k: int, power: int = 4, extra: int = 10, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(the k largest singular values, the directions: a row a term, a column a value) of sparse rows (id, at, w). Each direction's
    largest component is positive; where k and `extra` reach the number of terms the result is exact."""
    width = min(terms, k + extra)
    if terms * width > CELLS:
        raise ValueError(f"{terms} terms by {width} directions are more than {CELLS} values")
    if not terms:
        return np.zeros(0), np.zeros((0, 0))
    thin = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    for _ in range(power if width < terms else 0):
        thin = np.linalg.qr(_gram(rows, thin))[0]
    small = thin.T @ _gram(rows, thin)
    squares, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-squares, kind="stable")[:k]
    out = thin @ turn[:, order]
    out *= np.where(out[np.abs(out).argmax(0), np.arange(out.shape[1])] < 0, -1, 1)
    return np.sqrt(np.maximum(0, squares[order])), out


def along(rows: DataFrame, thin: np.ndarray, unit: bool = True) -> DataFrame:
    """(id, reduced): sparse rows along directions, at length 1 if `unit` (zero rows stay zero)."""
    held, kind = rows.sparkSession.sparkContext.broadcast(thin), rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            y = _times(batch, held.value)
            if unit:
                norm = np.sqrt((y * y).sum(1, keepdims=True))
                y = np.divide(y, norm, out=np.zeros_like(y), where=norm > 0)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), max(1, y.shape[1])).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["id", "reduced"])

    return rows.mapInArrow(run, f"id {kind}, reduced array<double>")


def reduced_terms(weights: DataFrame, k: int | None = None, id_col: str = "doc_id", unit: bool = True, **options) -> DataFrame:
    """(id, reduced) of a long table (id, term, w), by its `svd_size` strongest directions or k."""
    rows, terms = sparse_rows(weights, id_col)
    size = svd_size(rows.count(), len(terms)) if k is None else k
    return along(rows, directions(rows, len(terms), min(size, len(terms)), **options)[1], unit)


def dense_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """((id, at, w), number of components) of vectors of one length; null vectors have no values."""
    x = F.coalesce(F.col(vector_col).cast("array<double>"), F.array().cast("array<double>"))
    rows = vectors.select(F.col(id_col).alias("id"), F.transform(x, lambda _, i: i).alias("at"), x.alias("w"))
    return rows, rows.agg(F.max(F.size("w"))).first()[0] or 0


# --- k-means


def first_centres(vectors: DataFrame, k: int, sets: int = 10, seed: int = 42, id_col: str = "vec_id", vector_col: str = "embedding") -> list[np.ndarray]:
    """`sets` sets of k rows, the first by a hash of the id; a set of fewer where there are fewer rows."""
    out = []
    for n in range(sets):
        order = F.md5(F.concat(F.lit(f"{seed}:{n}:"), F.col(id_col).cast("string")))
        rows = vectors.where(F.col(vector_col).isNotNull()).orderBy(order, id_col).limit(k).select(F.col(vector_col).cast("array<double>")).collect()
        out.append(np.array([r[0] for r in rows]))
    return out


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, summed component by component, to nine digits."""
    out = np.zeros((len(x), len(centres)))
    for i in range(x.shape[1]):
        out += (x[:, i, None] - centres[None, :, i]) ** 2
    return np.round(out, 9)


def _points(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)


def _moved(rows: DataFrame, sets: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(rows, sums, inertia) by centre for each set of centres, over all `rows` (id, x): one pass, pre-aggregated."""
    def run(batches: Iterator[pa.RecordBatch]):
        total = [(np.zeros(len(c)), np.zeros(c.shape), [0.0]) for c in sets]
        for batch in batches:
            x = _points(batch, 1)
            for c, (n, sums, inertia) in zip(sets, total):
                far = _distances(x, c)
                own = far.argmin(1)  # the earlier of equal ones
                n += np.bincount(own, minlength=len(c))
                np.add.at(sums, own, x)
                inertia[0] += far.min(1).sum()
        for s, (n, sums, inertia) in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([n.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary()), pa.array(inertia)], ["s", "n", "sums", "inertia"])

    def add(batches: Iterator[pa.RecordBatch]):
        held = {}
        for batch in batches:
            for s, n, sums, inertia in zip(*(c.to_pylist() for c in batch.columns)):
                old = held.get(s, (0, 0, 0.0))
                held[s] = (old[0] + np.frombuffer(n), old[1] + np.frombuffer(sums), old[2] + inertia)
        for s, (n, sums, inertia) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([n.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary()), pa.array([inertia])], ["s", "n", "sums", "inertia"])

    form = "s int, n binary, sums binary, inertia double"
    out = [(np.zeros(len(c)), np.zeros(c.shape), 0.0) for c in sets]
    for r in rows.mapInArrow(run, form).repartition(len(sets), "s").mapInArrow(add, form).collect():  # a row a set
        out[r["s"]] = (np.frombuffer(r["n"]), np.frombuffer(r["sums"]).reshape(sets[r["s"]].shape), r["inertia"])
    return out


def assigned(vectors: DataFrame, centres: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster): the nearest centre of each row, the earlier of equal ones; null vectors have none."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            own = _distances(_points(batch, 1), centres).argmin(1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32))], ["id", "cluster"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    known = rows.where("x is not null").mapInArrow(run, f"id {kind}, cluster int")
    return known.unionByName(rows.where("x is null").select("id", F.lit(None).cast("int").alias("cluster")))


def minibatches(vectors: DataFrame, starts: list[np.ndarray], batches: int, most: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[np.ndarray, float]:
    """(centres, inertia) of the best set of `starts` after `batches` mini-batches (the first `most` of them, if given)."""
    deal = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 6), 16, 10).cast("long") % batches
    rows = vectors.where(F.col(vector_col).isNotNull()).select(deal.cast("int").alias("batch"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    sets = [np.array(s, float) for s in starts]
    if not all(len(s) for s in sets):
        return np.zeros((0, 0)), 0.0
    dealt = materialise(rows.repartition("batch"), "mini-batches")  # a batch lies in few files, by their least and greatest batch
    had = [np.zeros(len(s)) for s in sets]
    for n in range(min(batches, most or batches)):
        for i, (count, sums, _) in enumerate(_moved(dealt.where(F.col("batch") == n).select("id", "x"), sets)):
            had[i] = had[i] + count
            rate = np.divide(1.0, had[i], out=np.zeros_like(had[i]), where=had[i] > 0)
            sets[i] = sets[i] + rate[:, None] * (sums - count[:, None] * sets[i])
    inertia = [x[2] for x in _moved(dealt.select("id", "x"), sets)]
    best = int(np.argmin(inertia))
    return sets[best], inertia[best]


def kmeans(vectors: DataFrame, k: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42, size: int = 1024, most: int = 100, starts: int = 10) -> DataFrame:
    """(id, cluster); k is max(12, min(40, floor(sqrt(n)))) unless given, fewer where there are fewer rows."""
    n = vectors.where(F.col(vector_col).isNotNull()).count()
    k = k or max(12, min(40, math.isqrt(n)))
    first = first_centres(vectors, min(k, max(n, 1)), starts, seed, id_col, vector_col)
    centres, _ = minibatches(vectors, first, max(1, math.ceil(n / size)), most, id_col, vector_col)
    return assigned(vectors, centres, id_col, vector_col)
