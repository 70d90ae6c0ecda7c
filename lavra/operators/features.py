"""TF-IDF as a long table, centroids, cosine top-k, components, clusters and themes."""

from __future__ import annotations

import functools
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.functions.text import compact_terms, delimited_set, folded
from lavra.operators.graph import components
from lavra.operators.reduce import along, dense_rows, directions, kmeans  # noqa: F401  (part of what this module offers)
from lavra.runtime import materialise, pieces, release

PROFILES = 256  # profiles whose weights are put side by side and broadcast
CELLS = 4_000_000  # and their weights in all (about 32 MB); beyond, terms are joined
TOKENS = 2_000_000  # words of texts that are counted together (some 150 MB of a worker)
WORDS = 1_000_000  # different words that a worker keeps from one count to the next


class _Places(dict):
    """The place of each word, in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


class _Known(dict):
    """The place of each known word, -1 for others."""

    def __missing__(self, word: str) -> int:
        return -1


def _words(text: str | None, least: int) -> list[str]:
    """Words of `least` characters or more of a folded text, as often as they stand there."""
    return re.findall(f"[a-z0-9_]{{{least},}}", folded(text or ""))


def _tallied(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(each key, how many texts hold it, how often all do) of keys whose last `bits` are the text's number."""
    keys.sort()
    own = keys >> bits
    first = np.flatnonzero(np.diff(own, prepend=-1))
    df = np.add.reduceat(np.diff(keys, prepend=-1) != 0, first, dtype=np.int64) if len(first) else first
    return own[first], df, np.diff(first, append=len(keys))


def _counted(docs: DataFrame, text_col: str, least: int, bigrams: bool, salt: int) -> DataFrame:
    """(word, a, b, df, total): a row for each word, with its hash in a, and for each bigram, with its words' hashes in a and b; word is null there.
    They are counted where the texts are, as numbers, and summed."""
    names = ["word", "a", "b", "df", "total"]

    def run(batches):
        places, marks, texts = _Places(), [], []

        def out():
            ids, text = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(x) for x in texts])
            known, bits = list(places), (len(texts) - 1).bit_length()
            marks.extend(int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8, salt=salt.to_bytes(8)).digest(), "big", signed=True) for w in known[len(marks) :])
            of = np.array(marks, np.int64)
            own, df, total = _tallied(ids << bits | text, bits)
            columns = [pa.array(known, pa.string()).take(pa.array(own)), pa.array(of[own]), pa.nulls(len(own), pa.int64()), pa.array(df), pa.array(total)]
            yield from cut(pa.RecordBatch.from_arrays(columns, names))
            if bigrams:
                same, wide = text[1:] == text[:-1], len(known).bit_length()
                pairs, df, total = _tallied((ids[:-1][same] << wide | ids[1:][same]) << bits | text[1:][same], bits)
                columns = [pa.nulls(len(pairs), pa.string()), pa.array(of[pairs >> wide]), pa.array(of[pairs & (1 << wide) - 1]), pa.array(df), pa.array(total)]
                yield from cut(pa.RecordBatch.from_arrays(columns, names))
            texts.clear()
            if len(places) > WORDS:
                places.clear()
                marks.clear()

        def cut(rows):
            for at in range(0, rows.num_rows, 1 << 17):
                yield rows.slice(at, 1 << 17)

        n = 0
        for batch in pieces(batches, 0):
            for text in batch.column(0).to_pylist():
                words = _words(text, least)
                # Two words' places and a text's number have 63 bits together: a very long text has no others beside it.
                if texts and (n + len(words) > TOKENS or len(texts) == 1 << 17):
                    yield from out()
                    n = 0
                if words:
                    texts.append(np.fromiter(map(places.__getitem__, words), np.int64, len(words)))
                    n += len(words)
        if texts:
            yield from out()

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, a long, b long, df long, total long")
    return rows.groupBy("word", "a", "b").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def term_statistics(docs: DataFrame, text_col: str = "text", least: int = 3, bigrams: bool = True, min_df: int = 2) -> DataFrame:
    """`_counted`, written once: all words, and the bigrams that `min_df` texts hold. Where two words have one hash, other hashes are taken."""
    for salt in itertools.count():
        found = materialise(_counted(docs, text_col, least, bigrams, salt).where((F.col("df") >= min_df) | F.col("word").isNotNull()), "terms")
        if not bigrams or found.where("word is not null").groupBy("a").count().where("count > 1").isEmpty():
            return found


def vocabulary(statistics: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.75, max_features: int = 20_000) -> DataFrame:
    """(term, idf): the most frequent terms of `term_statistics` within the bounds of document frequency, with ln((1 + n) / (1 + df)) + 1. Bigrams
    get their words only where they are frequent enough."""
    within = statistics.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    least = within.select("total").orderBy(F.desc("total")).limit(max_features).agg(F.min("total")).first()[0] or 0
    likely, words = within.where(F.col("total") >= least), statistics.where("word is not null")
    a, b = (words.select(F.col("word").alias(f"word_{e}"), F.col("a").alias(e)) for e in "ab")
    both = likely.where("word is null").drop("word").join(a, "a").join(b, "b").select(F.concat_ws(" ", "word_a", "word_b").alias("term"), "df", "total")
    known = likely.where("word is not null").select(F.col("word").alias("term"), "df", "total").unionByName(both)
    return known.orderBy(F.desc("total"), "term").limit(max_features).select("term", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf"))


def weighted(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), least: int = 3, bigrams: bool = True) -> DataFrame:
    """(doc_id, *keep, term, w): raw tf x idf of the known terms (`vocabulary`, bounded by its `max_features`), rows at length 1. A text is weighted
    where it is read; the rows are written once."""
    terms = {r["term"]: r["idf"] for r in known.collect()}
    split = [t.split(" ") for t in terms]
    places = _Known((w, i) for i, w in enumerate(dict.fromkeys(w for t in split for w in t)))
    one = np.full(len(places) + 1, -1)  # the term of a word, and none at the place -1
    pairs = np.array(sorted((places[t[0]] << 32 | places[t[1]], i) for i, t in enumerate(split) if len(t) == 2), np.int64).reshape(-1, 2)
    for i, t in enumerate(split):
        if len(t) == 1:
            one[places[t[0]]] = i
    held = docs.sparkSession.sparkContext.broadcast((places, one, pairs[:, 0].copy(), pairs[:, 1].copy(), list(terms), np.array(list(terms.values()), float)))
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    names = ["doc_id", *keep]
    schema = T.StructType([*(T.StructField(n, rows.schema[n].dataType) for n in names), T.StructField("term", T.StringType()), T.StructField("w", T.DoubleType())])

    def run(batches):
        places, one, keys, term_of, terms, idf = held.value
        shown = pa.array(terms, pa.string())
        for batch in pieces(batches, len(names)):
            texts = [_words(text, least) for text in batch.column(len(names)).to_pylist()]
            row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
            ids = np.fromiter(map(places.__getitem__, itertools.chain.from_iterable(texts)), np.int64, len(row))
            single = one[ids]
            found = [(row * len(terms) + single)[single >= 0]]
            if bigrams and len(keys):
                ours = (ids[:-1] >= 0) & (ids[1:] >= 0) & (row[1:] == row[:-1])
                pair, at = ids[:-1][ours] << 32 | ids[1:][ours], row[1:][ours]
                near = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                same = keys[near] == pair
                found.append(at[same] * len(terms) + term_of[near[same]])
            own, tf = np.unique(np.concatenate(found), return_counts=True)
            at, term = np.divmod(own, max(1, len(terms)))
            raw = tf * idf[term]
            w = raw / np.sqrt(np.bincount(at, raw * raw, len(texts)))[at]
            place = pa.array(at)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(place) for i in range(len(names))), shown.take(pa.array(term)), pa.array(w)], schema.names)

    return materialise(rows.mapInArrow(run, schema), "weights")


def tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), min_df: int = 2, max_df: float = 0.75, max_features: int = 20_000, **terms) -> DataFrame:
    """`weighted` by the documents' own vocabulary."""
    statistics = term_statistics(docs, text_col, min_df=min_df, **terms)
    out = weighted(docs, vocabulary(statistics, docs.count(), min_df, max_df, max_features), id_col, text_col, keep, **terms)
    release(statistics)
    return out


def centroids(weights: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(cluster, term, w): mean vectors of the members (doc_id, cluster), or of weights that have their cluster with them; written once."""
    rows = weights if members is None else weights.join(members, "doc_id")
    size = (rows if members is None else members).groupBy("cluster").agg((F.count_distinct("doc_id") if members is None else F.count("*")).alias("n"))
    sums = rows.groupBy("cluster", "term").agg(F.sum("w").alias("s"))
    return materialise(sums.join(size, "cluster").select("cluster", "term", (F.col("s") / F.col("n")).alias("w")), "centroids")


def top_terms(centres: DataFrame, n: int = 12, least: int = 4) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("w", 9)), "term"))
    return centres.where(F.length("term") >= least).withColumn("rank", rank).where(F.col("rank") <= n)


def cosine_pairs(a: DataFrame, b: DataFrame, where: str = "true") -> DataFrame:
    """(id, profile, cosine) of sparse rows (id, term, w) with profiles (profile, term, w), of those that share a term; `where` is a
    condition on id and profile. A few profiles go to the rows side by side; for many, rows and profiles meet by term."""
    nb = materialise(b.groupBy("profile").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nb")), "norms")
    norms = {r["profile"]: r["nb"] for r in nb.limit(PROFILES + 1).collect()}
    length = F.sqrt(F.sum(F.col("w") * F.col("w")))
    if norms and len(norms) <= PROFILES and b.select("term").distinct().count() * len(norms) <= CELLS:
        names = list(norms)
        beside = b.groupBy("term").agg(*(F.sum(F.when(F.col("profile").eqNullSafe(F.lit(n)), F.col("w"))).alias(f"v{i}") for i, n in enumerate(names)))
        sums = a.join(F.broadcast(beside), "term", "left").groupBy("id").agg(length.alias("na"), *(F.sum(F.col("w") * F.col(f"v{i}")).alias(f"d{i}") for i in range(len(names))))
        each = F.array(*(F.struct(F.lit(n).alias("profile"), (F.col(f"d{i}") / F.lit(norms[n])).alias("dot")) for i, n in enumerate(names)))
        return sums.select("id", "na", F.inline(each)).where("dot is not null").where(where).select("id", "profile", F.round(F.col("dot") / F.col("na"), 6).alias("cosine"))
    dots = a.join(b.withColumnRenamed("w", "v"), "term").where(where).groupBy("id", "profile").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    rows = dots.join(a.groupBy("id").agg(length.alias("na")), "id").join(nb, "profile")
    return rows.select("id", "profile", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("cosine"))


def top_k(pairs: DataFrame, k: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "profile"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def consolidate(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node that edges (a, b) lead to; nodes without edges are their own."""
    found = components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("component"))


def family_vote(terms: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """(id, family): the family with most terms that hold one of its needles; ties to the later name, none is `indefinido`."""
    def held(needles: list[str]):
        return F.size(F.filter("terms", lambda t: functools.reduce(lambda a, b: a | b, (t.contains(n) for n in needles))))

    hits = [F.struct(held(needles).alias("n"), F.lit(name).alias("family")) for name, needles in sorted(families.items())]
    best = F.array_max(F.array(*hits))
    return terms.select("id", F.when(best["n"] > 0, best["family"]).otherwise("indefinido").alias("family"))


def merge_clusters(members: DataFrame, weights: DataFrame, families: DataFrame, threshold: float = 0.45, noise: int = -1) -> tuple[DataFrame, DataFrame]:
    """(doc_id, raw_cluster_id, cluster_id) of members (doc_id, cluster), and a record (cluster_id, merged, family, size) of each merged
    group: clusters of one family other than `indefinido` whose centroids have a cosine of `threshold` or more become one under the
    least id. Noise stays as it is."""
    real = members.where(F.col("cluster") != noise)
    centres = centroids(weights, real)
    close = cosine_pairs(centres.withColumnRenamed("cluster", "id"), centres.withColumnRenamed("cluster", "profile"), "id < profile").where(F.col("cosine") >= threshold)
    own = families.where("family <> 'indefinido'").select("cluster", "family")
    edges = close.join(own.withColumnRenamed("cluster", "id"), "id").join(own.select(F.col("cluster").alias("profile"), F.col("family").alias("other")), "profile").where("family = other")
    found = consolidate(edges.select(F.col("id").alias("a"), F.col("profile").alias("b")), real.select(F.col("cluster").alias("node")).distinct())
    rows = members.join(found.withColumnRenamed("node", "cluster"), "cluster", "left").select("doc_id", F.col("cluster").alias("raw_cluster_id"), F.coalesce("component", "cluster").alias("cluster_id"))
    groups = rows.groupBy("cluster_id").agg(F.count("*").alias("size"), F.array_sort(F.collect_set("raw_cluster_id")).alias("merged")).where("size(merged) > 1")
    return rows, groups.join(families.withColumnRenamed("cluster", "cluster_id"), "cluster_id", "left").select("cluster_id", "merged", F.coalesce("family", F.lit("indefinido")).alias("family"), "size")


def _first_distinct(rows: DataFrame, cluster: str, pos: str, item: str, most: int) -> DataFrame:
    """(cluster, list): the first distinct items of each cluster by position, cut before they are gathered."""
    each = rows.groupBy(cluster, item).agg(F.min(pos).alias("_at"))
    few = each.withColumn("_r", F.row_number().over(Window.partitionBy(cluster).orderBy("_at", item))).where(F.col("_r") <= most)
    return few.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", item))), lambda x: x[item]), " | ").alias("list"))


def summarize_clusters(rows: DataFrame, terms: DataFrame, noise: int = -1, titles: int = 8, tags: int = 20, domain: int = 200) -> DataFrame:
    """One row a cluster of (pos, cluster_id, raw_cluster_id, titulo, tags, domain_terms; the last two delimited by ` | `): raw ids, size,
    whether it is noise, top terms (cluster_id, term, rank), the first titles, tags and domain terms. Sort by is_noise, -size, cluster_id to show it."""
    sums = rows.groupBy("cluster_id").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_set("raw_cluster_id")), " | ").alias("raw_cluster_ids"))
    shown = rows.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("pos"))).where(F.col("_r") <= titles)
    shown = shown.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "titulo"))), lambda x: x["titulo"]), " | ").alias("sample_titles"))
    best = terms.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: F.replace(x["term"], F.lit("_"), F.lit(" "))), " | ").alias("top_terms"))
    out = sums.join(best, "cluster_id", "left").join(shown, "cluster_id", "left")
    for column, name, most in (("tags", "sample_tags", tags), ("domain_terms", "domain_terms", domain)):
        each = rows.select("cluster_id", F.posexplode(delimited_set(F.col(column))).alias("i", "item"), "pos").select("cluster_id", "item", F.struct("pos", "i").alias("at"))
        out = out.join(_first_distinct(each, "cluster_id", "at", "item", most).withColumnRenamed("list", name), "cluster_id", "left")
    return out.withColumn("is_noise", F.col("cluster_id") == noise).na.fill("", ["top_terms", "sample_titles", "sample_tags", "domain_terms"])


def cluster_view(summary: DataFrame, rows: DataFrame, cluster_id: int, size: int = 8) -> DataFrame:
    """One cluster's summary with its first rows (pos, titulo), 1 to 30 of them; no row where there is no such cluster."""
    if not 1 <= size <= 30:
        raise ValueError("size is from 1 to 30")
    own = rows.where(F.col("cluster_id") == cluster_id).orderBy("pos").limit(size)
    shown = own.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "titulo"))), lambda x: x["titulo"]).alias("samples"))
    return summary.where(F.col("cluster_id") == cluster_id).join(shown)  # one row each


def cluster_counts(rows: DataFrame, noise: int = -1) -> DataFrame:
    """One row: clusters and raw clusters without noise, and the share of noise rows, of (cluster_id, raw_cluster_id)."""
    real = F.col("cluster_id") != noise
    return rows.agg(F.count_distinct(F.when(real, F.col("cluster_id"))).alias("clusters"), F.count_distinct("raw_cluster_id").alias("raw_clusters"), F.round(F.avg((~real).cast("double")), 6).alias("noise_ratio"))


def tree_rows(summary: DataFrame, families: dict[str, list[str]], labels: dict[str, str] | None = None) -> DataFrame:
    """(theme, cluster_id, raw_cluster_ids, size, leaf_label, leaf_detail): clusters under the theme of their terms' dominant family."""
    terms = F.when(F.size(delimited_set(F.col("top_terms"))) > 0, delimited_set(F.col("top_terms"))).otherwise(delimited_set(F.col("domain_terms")))
    voted = family_vote(summary.select(F.col("cluster_id").alias("id"), F.transform(terms, F.lower).alias("terms")), families).withColumnRenamed("id", "cluster_id")
    name = F.col("family") if not labels else F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), F.col("family")), F.col("family"))
    leaf = F.concat(F.lit("cluster "), F.col("cluster_id"), F.lit(" ("), F.col("size"), F.lit(")"))
    return summary.join(voted, "cluster_id").select(name.alias("theme"), "cluster_id", "raw_cluster_ids", "size", leaf.alias("leaf_label"), compact_terms(F.col("top_terms")).alias("leaf_detail"))


def singular_values(vectors: DataFrame, k: int, vector_col: str = "embedding") -> list[float]:
    """The k largest singular values of the rows."""
    rows, width = dense_rows(vectors.withColumn("_row", F.lit(0)), "_row", vector_col)
    return directions(rows, width, k)[0].tolist()


def reduced(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", unit: bool = True) -> DataFrame:
    """(id, reduced): the rows along the k strongest directions (U S), at length 1 if `unit`. Each direction's sign is such that its
    largest component is positive."""
    rows, width = dense_rows(vectors, id_col, vector_col)
    return along(rows, directions(rows, width, k)[1], unit)


def lloyd(vectors: DataFrame, starts: list[list[float]], rounds: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster): k-means from given centres, so that the result can be repeated elsewhere; ties to the earlier centre. Centres are
    few and go to the rows as literals; a round is one pass with pre-aggregated sums."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))

    def assigned(centres):
        far = [F.struct(F.round(F.aggregate(F.zip_with("x", F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y), 9).alias("d"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)]
        return rows.withColumn("cluster", F.array_min(F.array(*far))["cluster"])

    centres = [list(map(float, c)) for c in starts]
    for _ in range(rounds):
        sums = assigned(centres).groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.get("x", F.lit(d))).alias(f"s{d}") for d in range(len(centres[0]))))
        for r in sums.collect():  # a row a centre
            centres[r["cluster"]] = [r[f"s{d}"] / r["n"] for d in range(len(centres[0]))]
    return assigned(centres).select("id", "cluster")


def hdbscan_size(n: int) -> tuple[int, int]:
    """(least cluster size, neighbours that make a point dense) for a sample of n."""
    size = max(8, min(60, 2 * int(n**0.5)))
    return size, max(4, size // 2)


def unstable(clusters: DataFrame, noise: int = -1) -> bool:
    """Whether a density clustering (cluster) is to be rejected: fewer than eight clusters, or more than 35% noise."""
    n, share = clusters.agg(F.count_distinct(F.when(F.col("cluster") != noise, F.col("cluster"))), F.avg((F.col("cluster") == noise).cast("double"))).first()
    return n < 8 or (share or 0) > 0.35
