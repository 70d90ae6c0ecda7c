"""Bradley-Terry quality scores.

A document's strength is a linear function of its surface features; P(a preferred to b) = sigmoid(strength(a) -
strength(b)). Preference pairs are drawn between documents labelled good and bad in a bounded sample of the learnable
rows, and the weights minimise logistic loss on feature differences. The threshold is a quantile of the strengths of the
sample, chosen there by balanced accuracy; the score is a logistic curve on which that quantile lies at `cut`.

Null and empty texts have the features of an empty text and a score; repeated rows get equal scores. Where one of the
classes has no learnable row every score is `cut`. Features take time and memory in proportion to a text, so very long ones
are scored whole. Ties of strength share a threshold's side; ties in the sample's order are broken by a hash of the text. An
empty table gives an empty result. `keep_good` keeps all columns whatever their names; the others read ids, texts and
labels alone."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.llm.batches import pieces, raw
from lavra.llm.labelled import held_out, learnable, sample

FEATURES = ("log_bytes", "upper", "digit", "mark", "exclaim", "stop", "space", "high", "distinct", "commonest", "word_length", "wordless", "distinct_lines", "line_words", "marked_words", "shout")
MARKS = b"#$%&*|~^<>{}[]=\\@_/+"


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(members)] = 1
    return out


CLASSES = np.stack([_class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(b"0123456789"), _class(MARKS), _class(b"!?"), _class(b".,;:"), _class(b" \t\n\r"), _class(bytes(range(128, 256)))])
BLANK = bytes.maketrans(MARKS + b"!?.,;:\"'()-0123456789", b" " * (len(MARKS) + 21))


def features(text: bytes) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    upper, lower, digit, mark, exclaim, stop, space, high = (CLASSES @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)).tolist()
    words = text.split()
    plain = text.translate(BLANK).split()
    tally: dict[bytes, int] = {}
    for w in plain:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    many, kept = max(1, len(words)), max(1, len(plain))
    letters = max(1.0, upper + lower + high)
    return [
        np.log1p(n), upper / letters, digit / n, mark / n, exclaim / n, stop / n, space / n, high / letters,
        len(tally) / kept**0.8, max(tally.values(), default=0) / kept, min(30.0, n / many), 1 - min(1.0, len(plain) / many),
        len(set(lines)) / max(1, len(lines)), np.log1p(many / max(1, len(lines))), min(1.0, (mark + exclaim) / many), float(upper > 0.5 * letters),
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: float  # the strength of the threshold
    steep: float
    cut: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.steep * (self.strength(x) - self.at) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_pairs(x: np.ndarray, label: np.ndarray, cut: float = 0.7, pairs: int = 60_000, seed: int = 7) -> Model:
    """Weights by Newton steps on the logistic loss of (good - bad) differences, ridge 1."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    if not len(good) or not len(bad):
        return Model(mean, scale, np.zeros(len(FEATURES)), 0.0, 1.0, cut)
    z, rng = np.clip((x - mean) / scale, -6, 6), np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -60, 60)))
        gradient = d.T @ (1 - p) - w
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.eye(len(w)), gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    s = z @ w
    levels = np.quantile(s, np.linspace(0, 1, 1001))
    gain = [(s[good] >= t).mean() + (s[bad] < t).mean() for t in levels]
    best = np.flatnonzero(np.isclose(gain, max(gain)))
    at = float(levels[best].mean()) if np.all(np.diff(best) == 1) else float(levels[best[0]])
    spread = float(np.median(np.abs(s - at))) or 1.0
    return Model(mean, scale, w, at, 2.0 / spread, cut)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", cut: float = 0.7, most: int = 12_000) -> Model:
    """Learns from at most `most` labelled documents outside the held-out fold."""
    chosen = sample(learnable(labels, label_col).where("label in (0, 1)"), most)

    def run(batches):
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([*piece.columns[:3], pa.array([features(t) for t in raw(piece)], pa.list_(pa.float64()))], ["label", "h", "t", "x"])

    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select(F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), "text")
    # Ids may repeat: of more rows than `most` the first in this order stay, whatever the partitions.
    got = rows.mapInArrow(run, "label int, h long, t long, x array<double>").orderBy("h", "t").limit(most).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit_pairs(x, np.array(got.column("label").to_pylist(), int), cut)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    kind, cut = docs.schema[id_col].dataType.simpleString(), model.cut

    def run(batches):
        for piece in pieces(batches):
            s = model.score(np.array([features(t) for t in raw(piece)], float))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    picked = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text the model predicts as good, with all their columns."""
    place = docs.columns.index(text_col)

    def run(batches):
        for piece in pieces(batches, text_col):
            blobs = [x or b"" for x in piece.column(place).cast(pa.binary()).to_pylist()]
            yield piece.filter(pa.array(model.score(np.array([features(t) for t in blobs], float)) >= model.cut))

    return docs.mapInArrow(run, docs.schema)
