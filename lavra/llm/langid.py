"""Language identification by nearest centroids.

A text is a vector of hashed byte trigrams of its lower-cased UTF-8, weighted by TF-IDF and normalised. Each language
of a bounded sample of the learnable rows is clustered by spherical k-means into `clusters` centroids; a text has the
language of the nearest one by cosine. The score is the share of that language among exponentials of the best
cosines. A text further from every centroid than `reject` (a cosine distance) is marked as rejected; its nearest
language is still told.

A text that is null or has no letter is `und` with score 0 and rejected; very short ones are scored by what they have.
Where nothing could be learned every text is `und`. Ties go to the language first in order. Repeated rows get equal
results; very long texts are read whole; an empty table gives an empty result. Ids, texts and languages alone are read, so
other columns may have any name."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.llm.batches import pieces
from lavra.llm.labelled import fold, held_out
from lavra.runtime import materialise

BUCKETS = 1 << 13
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def counts(text: str) -> np.ndarray:
    """Trigram counts by bucket; anything but letters reads as one space, and the text stands between spaces."""
    plain = b" ".join(text.lower().encode().translate(LETTERS).split())
    a = np.frombuffer(b" " + plain + b" ", np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(BUCKETS)
    key = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761) >> np.uint32(19)
    return np.bincount(key, minlength=BUCKETS).astype(float)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-12, np.sqrt((x * x).sum(-1, keepdims=True)))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    of: np.ndarray  # the language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    reject: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        x = np.log1p(counts(text)) * self.idf
        cosine = self.centroids @ (x / max(1e-12, float(np.sqrt(x @ x))))
        best = np.full(len(self.languages), -1.0)
        np.maximum.at(best, self.of, cosine)
        k = int(np.argmax(best))
        share = np.exp(20 * (best - best[k]))
        return self.languages[k], float(share[k] / share.sum()), bool(1 - best[k] > self.reject)


def fit_vectors(texts: list[str], langs: list[str], clusters: int = 3, rounds: int = 15, reject: float | None = None, seed: int = 5) -> Model:
    """`reject` is the distance beyond which a text is rejected; by default half as far again as all but one in a hundred of the
    sample's own texts are from their nearest centroid, 1 at most."""
    tf = np.array([np.log1p(counts(t)) for t in texts], np.float32).reshape(-1, BUCKETS)
    idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))) + 1
    tf *= idf.astype(np.float32)
    tf /= np.maximum(1e-12, np.sqrt(np.einsum("ij,ij->i", tf, tf)))[:, None]
    rng = np.random.default_rng(seed)
    languages, of, centroids = sorted(set(langs)), [], []
    lang = np.array(langs)
    for n, name in enumerate(languages):
        own = tf[lang == name]
        k = min(clusters, len(own))
        c = own[rng.choice(len(own), k, replace=False)]
        for _ in range(rounds):
            near = np.argmax(own @ c.T, 1)
            c = _unit(np.array([own[near == j].sum(0) if (near == j).any() else c[j] for j in range(k)]))
        of += [n] * k
        centroids.append(c)
    held = np.concatenate(centroids).astype(float) if centroids else np.empty((0, BUCKETS))
    if reject is None:
        far = 1 - (tf @ held.T.astype(np.float32)).max(1) if len(tf) else np.ones(1)
        reject = min(1.0, 1.5 * float(np.quantile(far, 0.99)))
    return Model(languages, np.array(of, int), held, idf, reject)


def fit(docs: DataFrame, most: int = 3_000, least: int = 5, **options) -> Model:
    """Learns from about `most` documents outside the held-out fold, an even share of each language and `least` at least, chosen by
    the order of a hash."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(fold() != 2).select("doc_id", "lang")
    # The share of a language by a hash threshold, so that no language is gathered anywhere.
    sizes = materialise(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    each = max(least, most // max(1, sizes.count()))
    share = known.join(sizes, "lang").where(F.expr(f"pmod(xxhash64(doc_id), 1000000) < 1200000.0 * {each} / n or n <= {4 * least}"))
    ids = materialise(share.select("doc_id", "lang").distinct(), "sample")
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text").toArrow()
    texts, langs = rows.column("text").to_pylist(), rows.column("lang").to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (langs[i], texts[i]))  # whatever the partitions
    texts, langs = [texts[i] for i in order], [langs[i] for i in order]
    return fit_vectors(texts, langs, **options)


def predictions(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row."""
    kind, held = docs.schema[id_col].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for piece in pieces(batches):
            got = list(map(held.value.predict, piece.column(2).to_pylist()))
            lang, score, rejected = zip(*got)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    picked = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
