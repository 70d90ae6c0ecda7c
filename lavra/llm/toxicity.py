"""Toxicity by class-conditional Kneser-Ney bigram models.

Two interpolated Kneser-Ney models, of toxic and of ordinary labelled documents, share one vocabulary and one lowest
level: the continuation counts of both classes together. Class counts have a cutoff, as is usual where single events
mislead: those under `RARE` count as none, others are discounted by `DISCOUNT`. A rare expression therefore has the same
backoff probability in both models and says nothing. Words out of the vocabulary back off to their longest known prefix
of 7, 6 or 5 letters, so that inflected forms share counts. Log-likelihoods are normalised by length: over every window
of `WINDOW` words (the whole text where that is shorter); a text's evidence is the largest difference of the two, so that
a long text with one toxic passage isn't thinned out (the README has figures of the mean over whole texts, which is
returned beside it as `mean_ratio`, and of a discount estimated from the counts).

All learnable documents are counted, in Spark. The model keeps every word and prefix that toxic documents use `RARE`
times or more and every bigram with a class count from `RARE` on, so nothing that bears evidence is left out. It grows with
the input; workers map it from shipped files (`lavra.llm.shipped`). The cut is set on a sample of labelled documents of
stated size (`sample`), each scored as if its own counts were not in the model: its words, bigrams, contexts and
continuations are taken off first (those under the cutoff as if they were its alone).

Null, empty and wordless texts have evidence 0; repeated rows get equal scores; ties of evidence are ordered by label, so
that the cut doesn't hang on partitions. Very long texts are scored whole. Without toxic or ordinary learnable rows
every score is `cut / 2`. An empty table gives an empty result. Only ids, texts and labels are read, so other columns may
have any name."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.llm.batches import pieces, texts
from lavra.llm.labelled import held_out, learnable
from lavra.llm.shipped import Shipped, Writer, ship_array
from lavra.runtime import materialise

CHUNK = 2_000_000  # bigrams that the driver holds at a time
WINDOW = 3
WORD = re.compile(r"[^\W\d_]+")
FLUSH = 1_000_000  # words whose bigrams a task counts at a time
RARE = 5
DISCOUNT = 4.0  # of counts from RARE on
PREFIXES = (7, 6, 5)
SAMPLE = 10_000  # labelled documents that the cut is set on
LABELS = 4_000_000  # labelled ids that are broadcast (about 60 bytes each); beyond, the labelled texts are joined by a shuffle, once
MEMO = 250_000  # words whose id a worker remembers before it begins anew


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def forms(word: str) -> list[str]:
    """A word and its prefixes (behind a hyphen), longest first."""
    return [word, *("-" + word[:n] for n in PREFIXES if len(word) >= n)]


class Places(dict):
    """Places of words, in the order in which they were first asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        out = self[word] = len(self)
        self.new.append(word)
        return out


class Ids:
    """Word ids, and ids of prefixes behind a hyphen; other words have the id of their longest known prefix, or `size`.
    An id is a place in the order of the words' hashes; the words themselves are compared, so equal hashes do no harm."""

    def __init__(self, size: int, hashes: Shipped, ends: Shipped, letters: Shipped):
        self.size, self.parts, self.places, self.known = size, (hashes, ends, letters), Places(), np.empty(0, np.int64)

    @classmethod
    def of(cls, spark: SparkSession, known: list[str]) -> Ids:
        raw = sorted(w.encode() for w in known)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
        raw = [raw[i] for i in np.argsort(hashes, kind="stable")]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        return cls(len(raw), ship_array(spark, [np.sort(hashes)], "u8"), ship_array(spark, [ends], "i8"), ship_array(spark, (np.frombuffer(w, np.uint8) for w in raw), "u1"))

    def exact(self, some: list[str]) -> np.ndarray:
        """The ids of words and prefixes themselves, `size` for unknown ones."""
        raw = [w.encode(errors="replace") for w in some]
        hashes, ends, letters = (x.array() for x in self.parts)
        marks = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
        at = np.searchsorted(hashes, marks)
        out = np.full(len(raw), self.size)
        for k in np.flatnonzero((at < self.size) & (hashes[np.minimum(at, self.size - 1)] == marks)).tolist() if self.size else []:
            i = int(at[k])
            while i < self.size and hashes[i] == marks[k]:
                if letters[ends[i - 1] if i else 0 : ends[i]].tobytes() == raw[k]:
                    out[k] = i
                    break
                i += 1
        return out

    def resolve(self, some: list[str]) -> np.ndarray:
        """The id of each word: its own, or that of its longest known prefix."""
        out = self.exact(some)
        for n in PREFIXES:
            left = [k for k in np.flatnonzero(out == self.size).tolist() if len(some[k]) >= n]
            if left:
                out[left] = self.exact(["-" + some[k][:n] for k in left])
        return out

    def of_texts(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words of all texts, one behind the other; where each text's begin, and the end)."""
        if len(self.places) > MEMO:
            self.places, self.known = Places(), np.empty(0, np.int64)
        parts = list(map(words, many))
        bounds = np.cumsum([0, *map(len, parts)])
        at = np.fromiter(map(self.places.__getitem__, chain.from_iterable(parts)), np.int64, int(bounds[-1]))
        if self.places.new:
            self.known = np.concatenate((self.known, self.resolve(self.places.new)))
            self.places.new.clear()
        return self.known[at], bounds

    def __reduce__(self):
        return _ids_of, (self.size, *self.parts)


@lru_cache(4)
def _ids_of(*parts) -> Ids:
    """One object a process, so that what it remembers serves all its tasks."""
    return Ids(*parts)


def _count_words(rows: DataFrame) -> DataFrame:
    """(word, n): counts of every word of `text`."""

    def run(batches):
        held = Counter()

        def out():
            keys = list(held)
            for at in range(0, len(keys), 50_000):
                some = keys[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([held[k] for k in some], pa.int64())], ["word", "n"])
            held.clear()

        for piece in pieces(batches):
            for text in texts(piece):
                held.update(words(text))
            if len(held) > 100_000:
                yield from out()
        yield from out()

    return rows.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _contexts(ids: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """What stands before each word: the word before it, or the start mark."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[bounds[:-1][np.diff(bounds) > 0]] = start
    return out


def _count_pairs(rows: DataFrame, known: Ids) -> DataFrame:
    """(pair, toxic, ordinary): counts of every bigram of (toxic, text), pair = first * (ids) + second."""

    def run(batches):
        size = known.size + 2
        held, have = [[], []], 0

        def out():
            for kind, some in enumerate(held):
                if not some:
                    continue
                got = pc.value_counts(pa.array(np.concatenate(some)))
                keys, n = got.field(0), got.field(1)
                none = pa.array(np.zeros(len(keys), np.int64))
                table = pa.RecordBatch.from_arrays([keys, n, none] if kind else [keys, none, n], ["pair", "toxic", "ordinary"])
                for at in range(0, table.num_rows, 100_000):
                    yield table.slice(at, 100_000)
                some.clear()

        for piece in pieces(batches):
            kinds = piece.column(0).to_numpy()
            ids, bounds = known.of_texts(texts(piece))
            pairs, toxic = _contexts(ids, bounds, size - 1) * size + ids, np.repeat(kinds == 1, np.diff(bounds))
            held[0].append(pairs[~toxic])
            held[1].append(pairs[toxic])
            have += len(pairs)
            if have > FLUSH:
                yield from out()
                have = 0
        yield from out()

    return rows.select("toxic", "text").mapInArrow(run, "pair long, toxic long, ordinary long").groupBy("pair").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _kept(count: np.ndarray) -> np.ndarray:
    return np.where(count >= RARE, count - DISCOUNT, 0.0)


@dataclass(frozen=True)
class Model:
    known: Ids
    #: Sorted keys of the bigrams from RARE on; their counts by (bigram, class); by (id, class) the bigrams that begin with it, the
    #: discounted part of these, and the kinds of bigrams that end in it; by id those kinds over both classes; toxic uses by id.
    tables: tuple[Shipped, ...]
    at: float = 0.0
    steep: float = 1.0
    cut: float = 0.3

    pairs, counts, begun, kept, kinds, shared, uses = (property(lambda self, i=i: self.tables[i].array()) for i in range(7))

    @property
    def lower(self) -> np.ndarray:
        """(word id, class): the Kneser-Ney unigram over the shared one."""
        return _lower(self.tables)

    def _found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each bigram is kept, its place)."""
        if not len(self.pairs):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        some, back = np.unique(keys, return_inverse=True)  # neighbours are found faster in order
        place = np.minimum(np.searchsorted(self.pairs, some), len(self.pairs) - 1)
        return (self.pairs[place] == some)[back], place[back]

    def ratios(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The log-likelihood ratio of each word behind its context."""
        begun = np.maximum(1.0, self.begun[first])
        p = (1 - self.kept[first] / begun) * self.lower[second]
        hit, place = self._found(first * (self.known.size + 2) + second)
        p[hit] += _kept(self.counts[place[hit]]) / begun[hit]
        return np.log(p[:, 0] / p[:, 1])

    def evidence(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(largest ratio of a window, mean ratio) of each text."""
        ids, bounds = self.known.of_texts(many)
        return windows(self.ratios(_contexts(ids, bounds, self.known.size + 1), ids), bounds)

    def without(self, text: str, toxic: bool) -> float:
        """The evidence of a counted text by the model of all others."""
        found = words(text)
        if not found:
            return 0.0
        size, c = self.known.size + 2, 0 if toxic else 1
        ids = self.known.of_texts([text])[0]
        start = np.array([0, len(ids)])
        keys, own = np.unique(_contexts(ids, start, size - 1) * size + ids, return_counts=True)
        read = self._known_without(found) if toxic else ids
        hit, place = self._found(keys)
        had = np.where(hit, self.counts[place, c] if len(self.pairs) else 0, 0).astype(float)
        lost = _kept(had) - _kept(had - own)
        first, second = keys // size, keys % size
        context = _contexts(read, start, size - 1)
        begun, kept, lower = self.begun[context].astype(float), self.kept[context].astype(float), self.lower[read]
        begun[:, c] -= _sums(context, first, own)
        kept[:, c] -= _sums(context, first, lost)
        # Continuations that are the text's alone: of its bigrams, and of the whole of the lowest level.
        alone = (had <= own).astype(float)
        touched, back = np.unique(second, return_inverse=True)
        less = np.bincount(back, alone)
        was = self.kinds[touched, c]
        total, whole = _totals(self.tables)[c]
        rest, total = whole - (_kept(was) - _kept(was - less)).sum(), max(1.0, total - alone.sum())
        lower[:, c] = _kept(self.kinds[read, c] - _sums(read, second, alone)) / total + (1 - rest / total) * (self.shared[read] + 1) / _shared_total(self.tables)
        base = np.maximum(1.0, begun)
        p = (1 - kept / base) * lower
        now = context * size + read
        hit, place = self._found(now)
        counts = np.where(hit[:, None], self.counts[place] if len(self.pairs) else 0, 0).astype(float)
        counts[:, c] -= _sums(now, keys, own)
        p += _kept(counts) / base
        return float(windows(np.log(p[:, 0] / p[:, 1]), start)[0][0])

    def _known_without(self, found: list[str]) -> np.ndarray:
        """The ids of a toxic text's words where its own uses don't count."""
        own = Counter(chain.from_iterable(map(forms, found)))
        names = list(own)
        ids = self.known.exact(names)
        left = np.append(self.uses, 0)[np.minimum(ids, len(self.uses))] - np.fromiter(own.values(), np.int64, len(own))
        stay = {n: i for n, i, k in zip(names, ids.tolist(), left.tolist()) if i < self.known.size and k >= RARE}
        each = {w: next((stay[f] for f in forms(w) if f in stay), self.known.size) for w in set(found)}
        return np.fromiter(map(each.__getitem__, found), np.int64, len(found))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = self.steep * (evidence - self.at) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def windows(ratios: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(largest mean over `WINDOW` neighbours, mean) of each text's ratios; 0 for texts without any."""
    n, sums = np.diff(bounds), np.concatenate(([0.0], np.cumsum(ratios)))
    mean = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(1, n)
    out, long = mean.copy(), np.flatnonzero(n >= WINDOW)
    if len(long):
        # A window for each word that begins one within its text.
        of = np.append(sums[WINDOW:] - sums[:-WINDOW], np.full(WINDOW, -np.inf))
        for back in range(1, WINDOW):
            of[bounds[1:][n >= back] - back] = -np.inf
        out[long] = np.maximum.reduceat(of, bounds[:-1][long]) / WINDOW
    return out, mean


def _sums(asked: np.ndarray, keys: np.ndarray, amounts: np.ndarray) -> np.ndarray:
    """For each asked key the sum of the amounts that stand under it."""
    some, back = np.unique(keys, return_inverse=True)
    sums = np.bincount(back, amounts, len(some))
    at = np.minimum(np.searchsorted(some, asked), len(some) - 1)
    return np.where(some[at] == asked, sums[at], 0.0)


def _base(shared: np.ndarray) -> np.ndarray:
    return (shared + 1) / (shared + 1).sum()


@lru_cache(4)
def _totals(tables: tuple[Shipped, ...]) -> list[tuple[float, float]]:
    """For each class the kinds of bigrams, and the discounted part of them."""
    kinds = tables[4].array()
    return [(float(kinds[:, c].sum()), float(_kept(kinds[:, c]).sum())) for c in (0, 1)]


@lru_cache(4)
def _shared_total(tables: tuple[Shipped, ...]) -> float:
    return float((tables[5].array() + 1).sum())


@lru_cache(4)
def _lower(tables: tuple[Shipped, ...]) -> np.ndarray:
    base, kinds = _base(tables[5].array()), tables[4].array()
    return np.column_stack([_kept(kinds[:, c]) / max(1.0, total) + (1 - kept / max(1.0, total)) * base for c, (total, kept) in enumerate(_totals(tables))])


def _model(known: Ids, pairs: DataFrame, uses: np.ndarray) -> Model:
    """Kneser-Ney counts from all bigrams. Sums by context or by word come to the driver whole, bigrams in chunks."""
    spark, size = pairs.sparkSession, known.size + 2
    bears = f"greatest(toxic, ordinary) >= {RARE}"
    begun, kinds, kept = np.zeros((size, 2)), np.zeros((size, 2)), np.zeros((size, 2))
    shared, many = np.zeros(size), np.zeros(size, np.int64)
    first, second = (F.expr(f"pair div {size}"), F.expr(f"pair % {size}"))
    by = pairs.groupBy(first.alias("id")).agg(F.sum("toxic"), F.sum("ordinary"), F.expr(f"count_if({bears})")).toArrow()
    at = by.column(0).to_numpy()
    many[at] = by.column(3).to_numpy()
    for c in (0, 1):
        begun[at, c] = by.column(1 + c).to_numpy()
    by = pairs.groupBy(second.alias("id")).agg(F.count("*"), F.expr("count_if(toxic > 0)"), F.expr("count_if(ordinary > 0)")).toArrow()
    at = by.column(0).to_numpy()
    shared[at] = by.column(1).to_numpy()
    for c in (0, 1):
        kinds[at, c] = by.column(2 + c).to_numpy()
    before = np.concatenate(([0], np.cumsum(many)))
    keys_, counts_ = Writer("i8"), Writer("i8", 2)
    start = 0
    while start < size:
        stop = max(start + 1, int(np.searchsorted(before, before[start] + CHUNK, side="right")) - 1)
        if before[stop] > before[start]:
            some = pairs.where(bears).where(f"pair >= {start * size} and pair < {stop * size}").toArrow()
            keys = some.column("pair").to_numpy()
            order = np.argsort(keys)
            keys, counts = keys[order], np.column_stack([some.column(c).to_numpy()[order] for c in ("toxic", "ordinary")])
            for c in (0, 1):
                kept[:, c] += np.bincount(keys // size, _kept(counts[:, c]), size)
            keys_.add(keys)
            counts_.add(counts)
        start = stop
    sized = [(begun, 2), (kept, 2), (kinds, 2), (shared, 1)]
    return Model(known, (keys_.ship(spark), counts_.ship(spark), *(ship_array(spark, [x], "f8", n) for x, n in sized), ship_array(spark, [uses], "i8")))


def _calibrate(model: Model, evidence: np.ndarray, toxic: np.ndarray, cut: float) -> Model:
    """Puts `cut` where toxic and ordinary rows part best by F1, in the middle of the gap there."""
    bad = evidence[toxic == 1]
    if not len(bad) or len(bad) == len(evidence):
        return replace(model, at=float("inf"), steep=0.0, cut=cut)
    order = np.lexsort((toxic, -evidence))  # equal evidence in an order that partitions don't change
    hits = np.cumsum(toxic[order] == 1)
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + len(bad))
    k = int(np.argmax(f1))
    high = evidence[order[k]]
    under = evidence[evidence < high]
    at = float((high + under.max()) / 2) if len(under) else float(high)
    return replace(model, at=at, steep=4.0 / max(1e-6, float(np.median(bad)) - float(np.median(evidence))), cut=cut)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", cut: float = 0.3, labels_most: int = LABELS, sample: int = SAMPLE) -> Model:
    """Counts all learnable documents; sets the cut on up to `sample` of them, by the order of a hash of the id.
    Texts stay where they are read for up to `labels_most` labelled ids."""
    spark = docs.sparkSession
    labelled = materialise(learnable(labels, label_col).where("label in (0, 1)"), "labels")
    few = labelled.count() <= labels_most
    rows = docs.select("doc_id", "text").join(F.broadcast(labelled) if few else labelled, "doc_id").select(F.col("label").cast("int").alias("toxic"), "text", "doc_id")
    rows = rows if few else materialise(rows, "labelled")
    whole = materialise(_count_words(rows.where("toxic = 1")), "words")
    starts = F.filter(F.array(*(F.when(F.length("word") >= n, F.concat(F.lit("-"), F.substring("word", 1, n))) for n in PREFIXES)), lambda x: x.isNotNull())
    prefixes = whole.select(F.explode(starts).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    found = whole.union(prefixes).where(f"n >= {RARE}").toArrow()
    names = found.column("word").to_pylist()
    known = Ids.of(spark, names)
    uses = np.zeros(known.size, np.int64)
    uses[known.exact(names)] = found.column("n").to_numpy()
    model = _model(known, materialise(_count_pairs(rows, known), "pairs"), uses)

    def run(batches):
        for piece in pieces(batches):
            kinds = piece.column(0).to_numpy()
            got = [model.without(t, k == 1) for k, t in zip(kinds, texts(piece))]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(got, pa.float64())], ["toxic", "evidence"])

    chosen = F.broadcast(labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id"))
    got = rows.join(chosen, "doc_id").select("toxic", "text").mapInArrow(run, "toxic int, evidence double").toArrow()
    return _calibrate(model, got.column("evidence").to_numpy(), got.column("toxic").to_numpy(), cut)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, mean_ratio) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for piece in pieces(batches):
            if np.isinf(model.at):
                s, mean = np.full(piece.num_rows, model.cut / 2), np.zeros(piece.num_rows)
            else:
                best, mean = model.evidence(texts(piece))
                s = model.score(best)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(s), pa.array((s >= model.cut).astype(np.int32)), pa.array(mean)], ["doc_id", "held_out", "score", "predicted", "mean_ratio"])

    picked = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, mean_ratio double")
