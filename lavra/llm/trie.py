"""Prefix trie of conversations, rolled up by pointer jumping.

A node is a distinct sequence of first turns; its key is a digest of that sequence. Digests go by blocks of `BLOCK` turns: the
chain within a block is one short fold, and blocks are chained in the same way a level up, so that a conversation of any
length is never gathered, and equal sequences have equal digests. Each node points at its parent's key. What a subtree holds is
summed by doubling: in round k a node has a pointer to its 2^k-th ancestor and the sums of all below it by less than 2^k
steps; it adds the sums of the nodes that point at it, and then takes the pointer of the node it points at. That is a round a
doubling of the depth, each one pre-aggregated sum by pointer and one join by pointer, of the nodes at least as deep.

Turns are ordered by turn (null first), then by role and text (its first 64 characters, then its digest), so that repeated turn
numbers have one order; null roles and texts are empty. Rows without an id take no part. Conversations without turns left count at the root alone. The conversations that end in a
node are digested as a stream: ids are joined in runs of 256 neighbours first, so that a node in which very many end
is never held in memory. An empty table gives no rows. Only the id, turn, role and text columns are read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.operators.sampling import numbered
from lavra.runtime import materialise

BLOCK = 32
RUN_BITS = 8  # ids that differ in their last bits alone are neighbours
ROOT = "root"
NOTHING = hashlib.sha256(b"").hexdigest()


def placed(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, turn_digest, points): turns by place from 1, what tells them apart, and the code points of their texts. Places come
    from one dealing to ranges, so that a conversation may fill many tasks."""
    own = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    told = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    own = own.where("conv_id is not null").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("_by"), F.substring("text", 1, 64).alias("_start"), told.alias("turn_digest"), F.length("text").cast("long").alias("points"))
    rows = numbered(own, ["conv_id", "turn", "role", "_start", "_by"], "_at")
    first = rows.groupBy("conv_id").agg(F.min("_at").alias("_first"))
    return rows.join(first, "conv_id").select("conv_id", (F.col("_at") - F.col("_first") + 1).alias("pos"), "turn_digest", "points")


def shared_starts(own: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """`own` (`placed`) rebuilt: the first h turns of conversation c - c % group come first, then c's own turns after its first h;
    h = crc32(c as text) % most."""
    names = own.where("pos = 1").select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    names = names.withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    starts = own.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    lead = names.join(starts, "base").where("pos <= h").select("conv_id", "pos", "turn_digest", "points")
    # Places of own turns follow the base's, of which there may be fewer than h.
    had = lead.groupBy("conv_id").agg(F.max("pos").alias("had"))
    names = names.join(had, "conv_id", "left").select("conv_id", "h", F.coalesce("had", F.lit(0)).alias("had"))
    rest = own.join(names, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("had")).alias("pos"), "turn_digest", "points")
    return lead.unionByName(rest)


def _chained(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, digest) of (conv_id, pos, turn_digest): digests of all the turns up to each place."""
    level = rows.select("conv_id", "pos", "turn_digest")
    block = F.floor((F.col("pos") - 1) / BLOCK)
    folded = level.groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "turn_digest"))).alias("turns"))
    # Each place's digest is of the one before it in the block and of its own turn.
    chain = F.expr("""aggregate(turns, cast(array() as array<struct<pos: bigint, digest: string>>), (done, x) ->
        concat(done, array(struct(x.pos as pos, sha2(concat(coalesce(try_element_at(done, -1).digest, ''), x.turn_digest), 256) as digest))))""")
    folded = materialise(folded.select("conv_id", "block", chain.alias("done")), "trie-blocks")
    if folded.where("block > 0").isEmpty():
        return folded.select("conv_id", F.explode("done").alias("x")).select("conv_id", F.col("x.pos").alias("pos"), F.col("x.digest").alias("digest"))
    # Whole blocks are the turns of the level above; a place's digest is that of the blocks before its own and of its place within.
    above = folded.select("conv_id", (F.col("block") + 1).alias("pos"), F.element_at("done", -1)["digest"].alias("turn_digest"))
    before = _chained(above).select("conv_id", F.col("pos").alias("block"), F.col("digest").alias("ahead"))
    met = folded.join(before, ["conv_id", "block"], "left").select("conv_id", F.col("ahead"), F.explode("done").alias("x"))
    whole = F.when(F.col("ahead").isNull(), F.col("x.digest")).otherwise(F.sha2(F.concat("ahead", F.lit("|"), F.col("x.digest")), 256))
    return met.select("conv_id", F.col("x.pos").alias("pos"), whole.alias("digest"))


def prefixes(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, points, last): each conversation of `ids` in each node of its path, the root first; `points` of the
    node's last turn, `last` where the conversation ends."""
    # The turn before is looked up by its place: an equal join of even keys.
    keyed = materialise(_chained(rows).join(rows.select("conv_id", "pos", "points"), ["conv_id", "pos"]), "trie-digests")
    node = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("digest")), 256)
    keyed = keyed.select("conv_id", F.col("pos").alias("depth"), node.alias("node"), "points")
    before = keyed.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    ends = keyed.groupBy("conv_id").agg(F.max("depth").alias("end"))
    met = keyed.join(before, ["conv_id", "depth"], "left").join(ends, "conv_id")
    deep = met.select("conv_id", "depth", "node", F.coalesce("parent", F.lit(ROOT)).alias("parent"), "points", (F.col("depth") == F.col("end")).alias("last"))
    top = ids.join(ends, "conv_id", "left").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("points"), F.col("end").isNull().alias("last"))
    return deep.unionByName(top)


def _digested(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): the ids in numeric order, joined by commas. Runs of neighbours are joined first; a node's
    runs then go by in order, and none is kept."""
    runs = ends.groupBy("node", F.shiftright("conv_id", RUN_BITS).alias("run")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    runs = runs.select("node", "run", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def stream(batches: Iterator[pa.RecordBatch]):
        at, digest = None, None
        for batch in batches:
            done = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node != at:
                    if at is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield out(done)
        if at is not None:
            yield out([(at, digest.hexdigest())])

    def out(done):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], ["node", "ends_sha256"])

    sorted_runs = runs.repartition("node").sortWithinPartitions("node", "run").select("node", "ids")
    return sorted_runs.mapInArrow(stream, "node string, ends_sha256 string")


def rolled_up(nodes: DataFrame, deepest: int, sums: list[str]) -> DataFrame:
    """(node, *sums) of `nodes` (node, parent, depth, *sums): sums over each node's subtree, in a round a doubling of the depth."""
    level = nodes.select("node", "depth", F.col("parent").alias("up"), *sums)
    step = 1  # `up` is the ancestor by so many steps, `sums` are over all below by fewer steps
    while step <= deepest:
        # Nodes that point at one are summed before they meet it.
        given = level.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("node")).agg(*(F.sum(x).alias(f"_{x}") for x in sums))
        added = level.join(given, "node", "left").select("node", "depth", "up", *((F.col(x) + F.coalesce(F.col(f"_{x}"), F.lit(0))).alias(x) for x in sums))
        step *= 2
        if step <= deepest:
            # Only nodes deep enough have an ancestor by twice as many steps.
            jump = level.where(F.col("up").isNotNull()).select(F.col("node").alias("up"), F.col("up").alias("_next"))
            moved = level.where(F.col("depth") >= step).select("node", "up").join(jump, "up").select("node", "_next")
            added = added.drop("up").join(moved, "node", "left").withColumnRenamed("_next", "up")
            level = materialise(added.select("node", "depth", "up", *sums), "trie-round")
        else:
            level = added
    return level.select("node", *sums)


def trie(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row a node of the conversations `ids` (conv_id) with the turns `rows` (conv_id, pos, turn_digest, points): conv_id (the smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens over the subtree (a node saves its last text's code points for
    each member but one), ends_sha256 of the members that end here."""
    paths = materialise(prefixes(rows, ids), "trie-paths")
    grouped = paths.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("points").alias("points"))
    nodes = materialise(grouped, "trie-nodes")
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        deepest = 0
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    known = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    known = known.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("points"))
    known = materialise(known, "trie-known")
    sums = ["n_leaves", "saved_tokens"]
    below = rolled_up(known, deepest, sums)
    named = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = known.drop(*sums).join(below, "node").join(named, "parent", "left").join(_digested(paths.where("last").select("node", "conv_id")), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
