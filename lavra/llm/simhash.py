"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to the counts of set bits in its 32 two-bit segments, a point of {0,1,2}^32. One
differing bit moves one count by at most one, so the Manhattan distance of two points is a lower bound of the
Hamming distance of their fingerprints. Points within distance k differ by at most k // 2 in the first 17 segments
or by at most (k - 1) // 2 in the other 15. For either part a grid range-join finds all such pairs: both sides are
dealt to the lattice cells within half that radius, and two points within the radius share a cell. Every pair
that meets is verified exactly by the popcount of the XOR inside the join.

Nulls and empty texts have fingerprint zero and link like any other. Repeated rows share a fingerprint, and only
distinct fingerprints are joined, so copies never form pairs. A null doc_id keeps its row; component_id is the
smallest non-null doc_id reachable (null if there is none). Very long texts are hashed in steps. An empty table gives an
empty result. Only the id and text columns are read, so others may have any name.

`similar` is for texts that are alike rather than almost the same. All pairs of fingerprints within four bits come from the
same grid range-join. A pair that shares 0.8 of its shingles may differ by ten bits of 64 and more, a radius within which cells
select little; most of those pairs meet where a band of min-wise shingles agrees, and the popcount of the XOR is held against a wide
radius. What these leave apart meets by prefixes of the sets, which lose no pair: under one order of all shingles, sets that share 0.8 share
one of their first fifth. Where many texts hold such a shingle (a family of near copies, a passage), each of them is told by what it
has and lacks against one of them, and texts meet by the prefixes of these differences, so that copies that went apart in different places
don't meet at all. All pairs are verified by the sets of shingles themselves."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lavra.llm.batches import pieces, raw
from lavra.operators.graph import components
from lavra.runtime import materialise, release, settle

ODD = 0x5555555555555555
BANDS, ROWS = 10, 4  # min-wise bands of a text, and shingles of each: 0.995 of pairs at 0.8 agree in one, 0.08 of pairs at 0.3
MET = 200_000  # rows in pairs to verify that are broadcast (about 60 bytes each), so that texts stay in place; beyond, a shuffle joins them
FAR = 22  # bits between fingerprints of texts that share 0.8 of their shingles, and four deviations more
SAMPLE = 20_000  # texts, or about so many, whose shingles are counted to tell common ones
COMMON = 200_000  # common shingles that go to the tasks (3 MB)
HOT = 64  # texts that are paired directly where they share a shingle; more go by their differences from one of them
DEPTH = 2  # times that texts are told by differences, at most; what is still hot then is paired where it meets
SENT = 8 << 20  # bytes of sets of pivots that are broadcast; beyond, they are joined
SLICE = 6_000_000  # shingles of prefixes that are shuffled at a time, up to `SLICES` slices of them
SLICES = 8
SLACK = 0.000001  # of sums of fractions
SPLIT = 17  # segments of the first part
STEP = 1 << 16  # shingles counted at a time


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space, all shingles counted."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes, n = iter([digest(joined, seed)]), 1
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        n = len(parts) - words + 1
        starts = [0, *(gaps[: n - 1] + 1).tolist()]
        ends = [*gaps[words - 1 :].tolist(), len(joined)]
        hashes = (digest(joined[a:b], seed) for a, b in zip(starts, ends))
    counts = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        some = np.fromiter(hashes, np.uint64, min(STEP, n - at))
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for piece in pieces(batches):
            got = pa.array([fingerprint(x, words, seed) for x in raw(piece)], pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column(0), got], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _ball(cell: str, n: int, radius: int) -> str:
    """SQL for the array of lattice points within `radius` of the packed counts in `cell`, in n segments."""
    ball = f"array({cell})"
    for _ in range(radius):
        ball = f"""array_distinct(flatten(transform({ball}, c -> array_union(array(c), filter(flatten(transform(sequence(0, {n - 1}), i -> array(
            if((shiftrightunsigned(c, 2 * i) & 3) < 2, c + shiftleft(1L, 2 * i), null),
            if((shiftrightunsigned(c, 2 * i) & 3) > 0, c - shiftleft(1L, 2 * i), null)))), x -> x is not null)))))"""
    return ball


def links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """(src, dst), src < dst: all pairs of the distinct fingerprints `fp` that differ in at most `max_bits` bits.
    A pair may stand in the result a few times."""
    found = []
    for first, n, radius in ((0, SPLIT, max_bits // 2), (SPLIT, 32 - SPLIT, (max_bits - 1) // 2)):
        if radius < 0:
            continue
        part = f"(shiftrightunsigned(fp, {2 * first}) & {(1 << 2 * n) - 1}L)"
        at = distinct.selectExpr("fp", f"({part} & {ODD}L) + (shiftrightunsigned({part}, 1) & {ODD}L) as home")
        near, far = (at.select("fp", "home", F.explode(F.expr(_ball("home", n, r))).alias("cell")) for r in ((radius + 1) // 2, radius // 2))
        a, b = near.alias("a"), far.alias("b")
        close = F.expr(f"bit_count(a.fp ^ b.fp) <= {max_bits}")
        # Points of one home share all cells around it; they count where both are at home.
        once = F.expr("a.home <> b.home or (a.cell = a.home and b.cell = b.home)")
        # Spark takes an exploded table for as small as it was before, and would broadcast it.
        met = a.hint("merge").join(b, (F.col("a.cell") == F.col("b.cell")) & F.expr("a.fp <> b.fp") & once & close)
        found.append(met.select(F.expr("least(a.fp, b.fp) as src"), F.expr("greatest(a.fp, b.fp) as dst")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, max_bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs`; components of the graph of fingerprints at `max_bits` or fewer."""
    marked = materialise(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    label = components(links(distinct.select("fp"), max_bits))
    named = distinct.join(label.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    named = materialise(named, "labels")
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    known = materialise(named.select("fp", "label").join(least.hint("merge"), "label").select("fp", "component_id"), "components")
    return marked.join(known.hint("merge"), "fp", "left").select("doc_id", "fp", "component_id")


def shingles(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """The hashes of all shingles of a UTF-8 text, in order, as `fingerprint` takes them."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = max(1, len(parts) - words + 1)
    starts, ends = [0, *(gaps[: n - 1] + 1).tolist()], [*gaps[words - 1 :].tolist(), len(joined)]
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, n)


def sketch(hashes: np.ndarray) -> tuple[int, int, int, list[int]]:
    """(hash of the set of shingles, fingerprint, size of the set, a key for each band). The set's least hash in each of `BANDS` x `ROWS`
    ranges is taken; a range without any takes that of the next one that has, told apart by how far it is."""
    own = np.unique(hashes)
    if not len(own):
        return 0, 0, 0, []
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        counts += np.unpackbits(hashes[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    fp = int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])
    ranges = BANDS * ROWS
    of = ((own >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    first = np.searchsorted(of, np.arange(ranges))
    at = first % len(own)  # behind the last range comes the first one
    least = own[at] + ((of[at] - np.arange(ranges)) % ranges).astype(np.uint64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = [signed(xxhash.xxh64_intdigest(least[j * ROWS : (j + 1) * ROWS].tobytes(), j)) for j in range(BANDS)]
    return signed(xxhash.xxh64_intdigest(own.tobytes(), 0)), fp, len(own), keys


def _sketches(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for piece in pieces(batches):
            sig, fp, n, keys = zip(*(sketch(shingles(x, words, seed)) for x in raw(piece)))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sig, pa.int64()), pa.array(fp, pa.int64()), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["row", "sig", "fp", "n", "keys"])

    return docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text")).mapInArrow(run, f"row {kind}, sig long, fp long, n int, keys array<long>")


def _sets(texts_: DataFrame, words: int, seed: int) -> DataFrame:
    """(sig, shingles) of (sig, text): the sorted set of hashes as bytes."""

    def run(batches):
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([np.unique(shingles(x, words, seed)).tobytes() for x in raw(piece)], pa.binary())], ["sig", "shingles"])

    return texts_.mapInArrow(run, "sig long, shingles binary")


def _verified(pairs: DataFrame, similarity: float) -> DataFrame:
    """(src, dst) of the pairs (src, dst, a, b) whose sets share `similarity` of their union."""

    def run(batches):
        for piece in pieces(batches, "a"):
            keep = []
            for a, b in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in piece.columns[:2]], ["src", "dst"])

    return pairs.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def _common(docs: DataFrame, text_col: str, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in order, counts) of the shingles that several of these texts hold, at most `COMMON` of them. They decide which shingles
    come last in a prefix, so how much work there is, never what is found."""

    def run(batches):
        for piece in pieces(batches):
            own, n = np.unique(np.concatenate([np.unique(shingles(x, words, seed)) for x in raw(piece)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    rows = docs.select(F.lit(0).alias("at"), F.col(text_col).alias("text")).mapInArrow(run, "token long, n long")
    known = rows.groupBy("token").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "token").limit(COMMON).collect()
    tokens = np.array([r["token"] for r in known], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([r["n"] for r in known], np.int64)[order]


def prefix(own: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set (sorted), common ones last: two sets that share `similarity` of their union share one of these."""
    if not len(own):
        return own
    tokens, counts = common
    n = np.zeros(len(own), np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
        n = np.where(tokens[at] == own, counts[at], 0)
    return own[np.lexsort((own, n))[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]]


def _prefixes(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int, common: tuple[np.ndarray, np.ndarray], similarity: float) -> DataFrame:
    """(first, sig, tokens) for every row."""
    kind, held = docs.schema[id_col].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for piece in pieces(batches):
            sets = [np.unique(shingles(x, words, seed)) for x in raw(piece)]
            sig = np.array([xxhash.xxh64_intdigest(x.tobytes(), 0) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
            tokens = [prefix(x, held.value, similarity).view(np.int64) for x in sets]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sig), pa.array(tokens, pa.list_(pa.int64()))], ["first", "sig", "tokens"])

    return docs.select(F.col(id_col).alias("first"), F.col(text_col).alias("text")).mapInArrow(run, f"first {kind}, sig long, tokens array<long>")


def _meeting(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The entries (keys, sig, label, weight, reach), dealt by `keys`, that may be part of a pair. Two entries of one key make a pair where
    labels differ and neither's weight is above the other's reach."""
    of = (F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("weight").alias("least"), F.max("reach").alias("most"))
    held = entries.groupBy(*keys).agg(*of).where("lo < hi").select(*keys, "least", "most")
    return entries.join(held.hint("merge"), keys).where(f"weight <= most + {SLACK} and reach >= least - {SLACK}").select(*keys, "sig", "label", "weight", "reach")


def _meeting_others(entries: DataFrame, keys: list[str]) -> DataFrame:
    """As `_meeting`, each entry being held against those of other labels alone; f: how many its key had."""
    entries = entries.select(*keys, "sig", "label", "weight", "reach").repartition(*keys)
    labels = entries.groupBy(*keys, "label").agg(F.min("weight").alias("least"), F.max("reach").alias("most"), F.count("sig").alias("f"))
    first = labels.groupBy(*keys).agg(F.min(F.struct("least", "label")).alias("low"), F.max(F.struct("most", "label")).alias("high"), F.sum("f").alias("n"))
    other = labels.join(first.hint("merge"), keys).groupBy(*keys).agg(
        F.first("low").alias("low"),
        F.first("high").alias("high"),
        F.first("n").alias("f"),
        F.min(F.expr("if(label <> low.label, least, null)")).alias("low_other"),
        F.max(F.expr("if(label <> high.label, most, null)")).alias("high_other"),
    )
    met = entries.join(other.hint("merge"), keys)
    met = met.where(f"weight <= if(label <> high.label, high.most, high_other) + {SLACK} and reach >= if(label <> low.label, low.least, low_other) - {SLACK}")
    return met.select(*keys, "sig", "label", "weight", "reach", "f")


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= MET else rows.hint("merge")


def _around(docs: DataFrame, nodes: DataFrame, hot: DataFrame, keys: list[str], told: tuple, share: float) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst), and entries (family, token, sig, label, weight, reach) in place of the entries `hot`.

    The pivot of a key is the text that most hot keys have; all texts of keys with one pivot are a family. A text's difference d is what
    it has and the pivot lacks or the other way round, and sets a and b differ by what their differences differ by. With weight |d| - `share` x |set|,
    a and b are linked exactly if their differences share half the sum of their weights. Where that sum isn't above zero nothing
    need be shared: these are linked to the lightest text of the family, and take its label. All others share a token of their
    differences, and at the first one (rarest first) what is left of either must be enough."""
    held = hot.groupBy("sig").agg(F.count("*").alias("held"))
    pivots = hot.join(held.hint("merge"), "sig").groupBy(*keys).agg(F.max(F.struct("held", "sig"))["sig"].alias("pivot"))
    pivots = materialise(pivots, "pivots")
    members = materialise(hot.join(_small(pivots), keys).groupBy("pivot", "sig").agg(F.min("label").alias("label")), "members")
    sets = _held(docs, nodes, members.select("sig"), *told)
    centres = pivots.select("pivot").distinct().join(sets.select(F.col("sig").alias("pivot"), F.col("shingles").alias("b")).hint("merge"), "pivot")
    size = centres.agg(F.sum(F.length("b"))).first()[0] or 0
    pairs = members.join(sets.withColumnRenamed("shingles", "a").hint("merge"), "sig").join(F.broadcast(centres) if size <= SENT else centres.hint("merge"), "pivot")

    def run(batches):
        for piece in pieces(batches, "a"):
            at = [np.frombuffer(x, np.uint64) for x in piece.column(3).to_pylist()]
            tokens = [np.setxor1d(x, np.frombuffer(y, np.uint64), assume_unique=True).view(np.int64) for x, y in zip(at, piece.column(4).to_pylist())]
            weights = pa.array([len(d) - share * len(x) for d, x in zip(tokens, at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*piece.columns[:3], weights, pa.array(tokens, pa.list_(pa.int64()))], ["family", "sig", "label", "weight", "tokens"])

    apart = pairs.select("pivot", "sig", "label", "a", "b").mapInArrow(run, "family long, sig long, label long, weight double, tokens array<long>")
    apart = materialise(apart, "differences")
    release(sets)
    lightest = materialise(apart.groupBy("family").agg(F.min(F.struct("weight", "sig", "label")).alias("m")).select("family", *(F.col(f"m.{c}").alias(f"m_{c}") for c in ("weight", "sig", "label"))), "lightest")
    linked = apart.join(_small(lightest), "family").where(f"weight + m_weight <= {SLACK} and label <> m_label")
    moved = materialise(linked.groupBy("family", "label").agg(F.min("sig").alias("x"), F.min("m_sig").alias("y"), F.min("m_label").alias("m_label")), "moved")
    named = apart.join(_small(moved.select("family", "label", "m_label")), ["family", "label"], "left").withColumn("label", F.coalesce("m_label", "label"))
    keys = ["family", "token"]
    entries = named.select("family", "sig", "label", "weight", F.explode("tokens").alias("token")).repartition(*keys)
    mixed = entries.groupBy(*keys).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("sig").alias("f")).where("lo < hi").select(*keys, "f")
    text = Window.partitionBy("family", "sig")
    left = F.count("*").over(text) - F.row_number().over(text.orderBy("f", "token")) + 1
    entries = entries.join(mixed.hint("merge"), keys).withColumn("left", left).select(*keys, "sig", "label", "weight", F.expr("2 * left - weight as reach"))
    return moved.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")), entries.repartition(*keys)


def _apart(docs: DataFrame, nodes: DataFrame, rows: DataFrame, told: tuple, similarity: float) -> DataFrame:
    """(src, dst): pairs of (sig, label, n, tokens) of different labels that may share `similarity`, written once, or of pairs that do share it
    enough to join the same texts. At the first shingle that two sets share, what they may share from there on must be enough."""
    share = (1 - similarity) / (1 + similarity)  # of the sum of both sizes is what linked sets may differ by
    weight = f"{1 - share}D * n"
    total = rows.agg(F.sum(F.size("tokens"))).first()[0] or 0
    slices = min(SLICES, total // SLICE + 1)

    def part(k: int) -> DataFrame:
        """The entries of a slice of the shingles: those of one shingle are together, and slices are shuffled one after the other."""
        some = rows.select("sig", "label", F.expr("coalesce(n, 0) as n"), F.posexplode("tokens").alias("pos", "token"))
        some = some.where(F.pmod(F.xxhash64("token", F.lit(0)), F.lit(slices)) == k) if slices > 1 else some
        return some.repartition("token").selectExpr("token", "sig", "label", f"{weight} as weight", f"2 * (n - pos) - {weight} as reach")

    keys, found, entries = ["token"], None, [part(k) for k in range(slices)]
    for depth in range(DEPTH + 1):
        parts = []
        for some in entries:
            parts.append(materialise(_meeting(some, keys), "shared"))
            settle(docs.sparkSession)
        shared = functools.reduce(DataFrame.union, parts)
        less = materialise(_meeting_others(_meeting_others(shared, keys), keys), "shared")
        release(*parts)
        settle(docs.sparkSession)
        hot = less.where(f"f > {HOT}")
        if depth:  # few hot keys are paired as they are, as long as all keys together make at most `HOT` pairs an entry
            n, met = less.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("f") > HOT, F.col("f"))), F.lit(0))).first()
            done = depth == DEPTH or met <= HOT * n
        else:
            done = depth == DEPTH or hot.isEmpty()
        cold = less if done else less.where(f"f <= {HOT}")
        a, b = (cold.select(*keys, *(F.col(c).alias(f"{c}_{e}") for c in ("sig", "label", "weight", "reach"))).hint("merge") for e in "ab")
        pairs = a.join(b, keys).where(f"label_a < label_b and weight_a <= reach_b + {SLACK} and weight_b <= reach_a + {SLACK}")
        pairs = materialise(pairs.select(F.least("sig_a", "sig_b").alias("src"), F.greatest("sig_a", "sig_b").alias("dst")).distinct(), "met")
        found = pairs if found is None else found.union(pairs)
        if not done:
            edges, more = _around(docs, nodes, hot, keys, told, share)
            found, keys, entries = found.union(edges), ["family", "token"], [more]
        release(less)
        if done:
            return materialise(found.distinct(), "apart")


def _held(docs: DataFrame, nodes: DataFrame, sigs: DataFrame, id_col: str, text_col: str, words: int, seed: int) -> DataFrame:
    """(sig, shingles) of the texts `sigs`, written once, by `nodes` (first, sig)."""
    used = materialise(sigs.distinct().join(nodes, "sig").select("first", "sig"), "used")
    used = F.broadcast(used) if used.count() <= MET else used
    rows = docs.select(F.col(id_col).alias("first"), F.col(text_col).alias("text")).join(used, "first").select("sig", "text")
    sets = materialise(_sets(rows, words, seed).dropDuplicates(["sig"]), "sets")
    settle(docs.sparkSession)
    return sets


def _confirmed(docs: DataFrame, nodes: DataFrame, near: DataFrame, id_col: str, text_col: str, words: int, seed: int, similarity: float) -> DataFrame:
    """(src, dst) of the pairs `near` that share `similarity`, by the sets of the texts of `nodes` (first, sig). Pairs are written once; their
    sets, which are larger than the texts, stay only until then."""
    sets = _held(docs, nodes, near.select(F.col("src").alias("sig")).union(near.select("dst")), id_col, text_col, words, seed)
    pairs = near.join(sets.select(F.col("sig").alias("src"), F.col("shingles").alias("a")).hint("merge"), "src").join(sets.select(F.col("sig").alias("dst"), F.col("shingles").alias("b")).hint("merge"), "dst")
    found = materialise(_verified(pairs, similarity), "verified")
    release(sets)
    settle(docs.sparkSession)
    return found


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """(doc_id, component_id) for every row of `docs`, `id_col` being its identity; components of the graph of texts that share
    `similarity` of their distinct shingles or more. Texts of equal sets are one node and never form pairs.

    First most links are found cheaply: in each band's bucket all texts are held against its least and its greatest one, so that a bucket
    of any size gives two pairs a text, and fingerprints within four bits meet. Then come all pairs that are left, exactly: texts of
    different components so far meet wherever the prefixes of their sets share a shingle."""
    marked = materialise(_sketches(docs, id_col, text_col, words, seed), "sketches")
    nodes = materialise(marked.groupBy("sig").agg(F.min("row").alias("first"), F.min("fp").alias("fp"), F.min("n").alias("n")), "nodes")
    entries = marked.select("sig", F.explode("keys").alias("key")).distinct()
    ends = entries.groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo < hi")
    met = entries.join(ends, "key").select(F.explode(F.expr("array(struct(sig as a, lo as b), struct(sig as a, hi as b))")).alias("p"))
    edges = met.where("p.a <> p.b").select(F.least("p.a", "p.b").alias("src"), F.greatest("p.a", "p.b").alias("dst")).distinct()
    a, b = (nodes.select(F.col("sig").alias(e), F.col("fp").alias(f"fp_{e}"), F.col("n").alias(f"n_{e}")) for e in ("src", "dst"))
    # Of texts with one fingerprint each meets the least; of fingerprints within four bits the least texts meet.
    least = nodes.groupBy("fp").agg(F.min("sig").alias("least"))
    same = nodes.join(least, "fp").where("sig <> least").select(F.col("least").alias("src"), F.col("sig").alias("dst"))
    cells = links(least.select("fp")).join(least.select(F.col("fp").alias("src"), F.col("least").alias("x")).hint("merge"), "src").join(least.select(F.col("fp").alias("dst"), F.col("least").alias("y")).hint("merge"), "dst")
    cells = cells.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))
    edges = edges.unionByName(same).unionByName(cells).distinct()
    # Tables that grow with the texts are merged, never sent through the driver, whatever size Spark takes for small.
    near = edges.hint("merge").join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where(f"least(n_src, n_dst) >= {similarity} * greatest(n_src, n_dst)")
    near = near.where(f"bit_count(fp_src ^ fp_dst) <= {FAR}")
    near = materialise(near.select("src", "dst"), "near")
    settle(docs.sparkSession)
    told = (id_col, text_col, words, seed)
    label = components(_confirmed(docs, nodes, near, *told, similarity))
    named = nodes.join(label.withColumnRenamed("node", "sig").hint("merge"), "sig", "left").select("sig", "first", "n", F.coalesce("label", "sig").alias("label"))
    named = materialise(named, "labels")
    # The exact rest: pairs of different labels.
    some = docs.where(F.pmod(F.xxhash64(id_col), F.lit(nodes.count() // SAMPLE + 1)) == 0)
    found = _prefixes(docs, *told, _common(some, text_col, words, seed), similarity)
    rows = materialise(found.join(named.hint("merge"), ["first", "sig"]).dropDuplicates(["sig"]), "prefixes")
    settle(docs.sparkSession)
    apart = _apart(docs, nodes, rows, told, similarity)
    release(rows)
    more = _confirmed(docs, nodes, apart, *told, similarity)
    own = named.select("sig", F.col("label").alias("own"))
    joined = more.join(own.withColumnRenamed("sig", "src").withColumnRenamed("own", "a").hint("merge"), "src").join(own.withColumnRenamed("sig", "dst").hint("merge"), "dst")
    whole = components(joined.select(F.col("a").alias("src"), F.col("own").alias("dst")))
    named = named.withColumnRenamed("label", "node").join(whole.hint("merge"), "node", "left").select("sig", "first", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    known = materialise(named.select("sig", "label").join(least.hint("merge"), "label").select("sig", "component_id"), "components")
    return marked.select(F.col("row").alias("doc_id"), "sig").join(known.hint("merge"), "sig", "left").select("doc_id", "component_id")


def hex_of(fp: str = "fp"):
    return F.expr(f"lpad(lower(hex({fp})), 16, '0')")
