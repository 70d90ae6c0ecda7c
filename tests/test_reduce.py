"""Directions of sparse rows and k-means by mini-batches, against exact ones."""

import numpy as np
from pyspark.sql import functions as F

from lavra.operators import features, reduce

SF = "/root/testdata/sf0.001"


def test_leading_directions_of_terms(spark):
    """The strongest directions of the TF-IDF rows, against an exact SVD of the whole matrix."""
    weights = features.tfidf(spark.read.parquet(f"{SF}/documents.parquet"), max_features=3000)
    rows, terms = reduce.sparse_rows(weights)
    held = {r["id"]: (r["at"], r["w"]) for r in rows.collect()}
    ids = sorted(held)
    whole = np.zeros((len(ids), len(terms)))
    for i, d in enumerate(ids):
        whole[i, held[d][0]] = held[d][1]
    exact = np.linalg.svd(whole, full_matrices=False)
    values, thin = reduce.directions(rows, len(terms), 20, power=6)
    assert np.allclose(values, exact[1][:20], rtol=1.5e-2) and np.allclose(values[:4], exact[1][:4], rtol=1e-6)
    assert np.allclose(thin.T @ thin, np.eye(20), atol=1e-9)
    got = {r["id"]: r["reduced"] for r in reduce.along(rows, thin, unit=False).collect()}
    mine = np.array([got[d] for d in ids])
    best = exact[0][:, :4] * exact[1][:4]
    assert np.allclose(mine[:, :4] @ mine[:, :4].T, best @ best.T, atol=1e-4)
    assert all(abs(np.linalg.norm(r["reduced"]) - 1) < 1e-9 for r in reduce.reduced_terms(weights, 10).collect())
    assert reduce.svd_size(5000, 20000) == 80 and reduce.svd_size(10, 3) == 2 and reduce.svd_size(1, 500) == 2


def test_rows_without_terms(spark):
    empty = spark.createDataFrame([], "doc_id long, term string, w double")
    assert reduce.reduced_terms(empty).count() == 0
    vectors = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert {r["id"]: np.round(np.linalg.norm(r["reduced"]), 6) for r in features.reduced(vectors, 2).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    assert {r["id"]: r["cluster"] for r in features.kmeans(vectors, 2).collect()}[2] is None
    assert features.kmeans(vectors.limit(0)).count() == 0


def test_minibatches_find_clusters(spark):
    """Far groups are told apart, whatever the first set of starts is; equal rows go together."""
    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(6)[i % 4] * 50 + rng.normal(size=6)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {r["id"]: r["cluster"] for r in features.kmeans(df, 4, size=128).collect()}
    assert len(got) == 2000 and len({(i % 4, c) for i, c in got.items()}) == 4
    bad = [[rows[0][1], rows[4][1], rows[8][1], rows[12][1]], [rows[i][1] for i in range(4)]]
    centres, inertia = reduce.minibatches(df, bad, 8)
    assert inertia < 2000 * 6 * 1.5 and len(centres) == 4
    assert df.where(F.col("vec_id") < 0).count() == 0


def test_terms_are_counted_as_numbers(spark):
    """Bigrams are summed without their words, and the vocabulary and the weights are those of a plain count, ties by the term."""
    import math
    import re
    from collections import Counter

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()} | {-1: None, -2: "", -3: "ab Ção ção ção"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    own = {i: re.findall("[a-z0-9_]{3,}", features.folded(t or "")) for i, t in texts.items()}
    own = {i: Counter([*w, *map(" ".join, zip(w, w[1:]))]) for i, w in own.items()}
    df, total = Counter(t for c in own.values() for t in c), sum(own.values(), Counter())
    found = features.term_statistics(docs, min_df=1)
    assert sorted(r["total"] for r in found.where("word is null").collect()) == sorted(n for t, n in total.items() if " " in t)
    assert {r["word"]: (r["df"], r["total"]) for r in found.where("word is not null").collect()} == {t: (df[t], n) for t, n in total.items() if " " not in t}
    for most in (50, 3000, 10**6):
        best = sorted((t for t in total if 2 <= df[t] <= 0.75 * len(texts)), key=lambda t: (-total[t], t))[:most]
        idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in best}
        got = {(r["doc_id"], r["term"]): r["w"] for r in features.tfidf(docs, max_features=most).collect()}
        raw = {(i, t): n * idf[t] for i, c in own.items() for t, n in c.items() if t in idf}
        norm = Counter()
        for (i, _), x in raw.items():
            norm[i] += x * x
        assert got.keys() == raw.keys() and all(math.isclose(got[k], x / math.sqrt(norm[k[0]]), rel_tol=1e-9) for k, x in raw.items())
