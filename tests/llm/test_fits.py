"""Fitted models against plain re-computations: what they learn from, what they minimise, and what the queries return."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lavra.llm import langid, mixing, quality
from lavra.llm.queries import op3_quality, op6_mixing, op9_langid

SF = "/root/testdata/sf0.001"


def fold_of(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


def plain_features(text):
    """The features of a text, character by character."""
    n = len(text)
    if not n:
        return [0.0] * 16
    is_ = lambda members: sum(text.count(c) for c in members)
    upper, lower, digit, mark = is_(range(65, 91)), is_(range(97, 123)), is_(b"0123456789"), is_(quality.MARKS)
    exclaim, stop, space, high = is_(b"!?"), is_(b".,;:"), is_(b" \t\n\r"), sum(c >= 128 for c in text)
    words = text.split()
    cleaned = bytes(32 if c in quality.MARKS + b"!?.,;:\"'()-0123456789" else c for c in text).split()
    tally, lines = Counter(cleaned), [x for x in text.split(b"\n") if x.strip()]
    many, kept, letters = max(1, len(words)), max(1, len(cleaned)), max(1, upper + lower + high)
    return [
        math.log1p(n), upper / letters, digit / n, mark / n, exclaim / n, stop / n, space / n, high / letters, len(tally) / kept**0.8, max(tally.values(), default=0) / kept, min(30, n / many),
        1 - min(1, len(cleaned) / many), len(set(lines)) / max(1, len(lines)), math.log1p(many / max(1, len(lines))), min(1, (mark + exclaim) / many), float(upper > 0.5 * letters),
    ]


def test_op3_against_a_plain_fit(spark):
    """The rows that are learned from, their order, the features and every document's score."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    label = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r["quality"] is not None and fold_of(r["doc_id"]) != 2:
            label[r["doc_id"]] = min(r["quality"], label.get(r["doc_id"], 1))
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t")).collect()
    learned = sorted((r for r in rows if r["doc_id"] in label), key=lambda r: (r["h"], r["t"]))
    x = np.array([plain_features((r["text"] or "").encode()) for r in learned])
    model = quality.fit_pairs(x, np.array([label[r["doc_id"]] for r in learned]))
    got = {r["doc_id"]: r for r in op3_quality(spark, SF).collect()}
    for r in rows:
        z = np.clip((np.array(plain_features((r["text"] or "").encode())) - model.mean) / model.scale, -6, 6)
        score = 1 / (1 + math.exp(-(model.steep * (sum(z * model.weights) - model.at) + math.log(model.cut / (1 - model.cut)))))
        mine = got[r["doc_id"]]
        assert mine["score"] == pytest.approx(score, abs=1e-9) and mine["held_out"] == (fold_of(r["doc_id"]) == 2) and mine["predicted"] == int(mine["score"] >= 0.7)


def test_strengths_minimise_the_loss_of_pairs():
    """No step in any direction lowers the ridge-logistic loss on the drawn pairs; no threshold of the sample tells the classes better."""
    rng = np.random.default_rng(3)
    label = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 16)) + label[:, None] * np.linspace(-0.6, 0.9, 16)
    model = quality.fit_pairs(x, label, pairs=4000, seed=11)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -6, 6)
    draw = np.random.default_rng(11)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    d = z[draw.choice(good, 4000)] - z[draw.choice(bad, 4000)]
    loss = lambda w: np.log1p(np.exp(-(d @ w))).sum() + w @ w / 2
    least = loss(model.weights)
    for i in range(16):
        for step in (-1e-3, 1e-3, -0.1, 0.1):
            assert loss(model.weights + step * np.eye(16)[i]) >= least
    s = z @ model.weights
    told = lambda t: (s[good] >= t).mean() + (s[bad] < t).mean()
    assert told(model.at) >= max(told(t) for t in np.quantile(s, np.linspace(0, 1, 1001))) - 1e-9


def plain_trigrams(text):
    """Trigrams of the letters of a text, by the bucket that their bytes hash to."""
    out, data = Counter(), text.lower().encode()
    plain = b" " + b" ".join("".join(chr(c) if 97 <= c <= 122 or c >= 128 else " " for c in data).encode("latin-1").split()) + b" "
    for i in range(len(plain) - 2):
        out[(int.from_bytes(plain[i : i + 3], "big") * 2654435761 % (1 << 32)) >> 19] += 1
    return out


def test_op9_against_plain_centroids(spark):
    """Vectors by dictionaries, cosines one by one: the language and the score of every document; centroids are unit sums of sample texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    idf, held = model.idf.tolist(), [{int(i): float(c[i]) for i in np.flatnonzero(c)} for c in model.centroids]
    vector = lambda t: {k: math.log1p(v) * idf[k] for k, v in plain_trigrams(t).items()}
    learned = [r for r in docs.collect() if r["lang"] is not None and r["text"] is not None and fold_of(r["doc_id"]) != 2]
    df = Counter(k for r in learned for k in plain_trigrams(r["text"]))
    assert all(idf[k] == pytest.approx(math.log((1 + len(learned)) / (1 + df[k])) + 1, rel=1e-6) for k in df)
    assert all(sum(v * v for v in c.values()) == pytest.approx(1, abs=1e-5) for c in held)
    got = {r["doc_id"]: r for r in op9_langid(spark, SF).collect()}
    for r in docs.collect():
        mine = got[r["doc_id"]]
        if not any(map(str.isalpha, r["text"] or "")):
            assert (mine["lang_pred"], mine["score"]) == ("und", 0.0)
            continue
        x = vector(r["text"])
        norm = math.sqrt(sum(v * v for v in x.values()))
        best = {}
        for of, c in zip(model.of.tolist(), held):
            name = model.languages[of]
            best[name] = max(best.get(name, -1.0), sum(v * c.get(k, 0.0) for k, v in x.items()) / norm)
        top = max(best.values())
        assert best[mine["lang_pred"]] == pytest.approx(top, abs=1e-9)
        assert mine["score"] == pytest.approx(1 / sum(math.exp(20 * (b - top)) for b in best.values()), abs=1e-6)


def test_op6_against_plain_raking(spark):
    """Weights and probabilities of every document by dictionaries of cells, margin after margin."""
    rows = op6_mixing(spark, SF).collect()
    text = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    keys = ("source", "lang", "topic")
    tokens, cell = Counter(), {}
    for r in rows:
        own = text[r["doc_id"]]
        n = len((own["text"] or "").split())
        name = "note" if n < 50 else "brief" if n < 300 else "article" if n < 1500 else "long read"
        cell[r["doc_id"]] = (own["source"] or "(none)", own["lang"] or "(none)", name)
        tokens[cell[r["doc_id"]]] += n
        assert tuple(r[k] for k in keys) == cell[r["doc_id"]] and r["tokens"] == n
    total, fraction = sum(tokens.values()), 0.5
    from lavra.llm import queries

    targets = getattr(queries, "TARGETS", {})
    goals, bounded = [], []
    for i, key in enumerate(keys):
        sums = Counter()
        for c, n in tokens.items():
            sums[c[i]] += n
        stated = targets.get(key)
        share = {v: (stated.get(v, 0.0) if stated else n**0.7) if n else 0.0 for v, n in sums.items()}
        goals.append({v: s / sum(share.values()) * total for v, s in share.items()})
        factor = 0.0
        while True:  # the factor by which shares grow until the fraction of all tokens is reached
            full = sum(sums[v] for v in sums if factor * share[v] >= sums[v])
            free = sum(share[v] for v in sums if factor * share[v] < sums[v])
            if not free or (step := (fraction * total - full) / free) <= factor * (1 + 1e-12):
                break
            factor = step
        bounded.append({v: min(sums[v], factor * share[v]) for v in sums})

    def raked(w, wanted, bound):
        for _ in range(200):
            was = dict(w)
            for i in range(3):
                have = Counter()
                for c in w:
                    have[c[i]] += w[c] * tokens[c]
                w = {c: min(bound, x * (wanted[i][c[i]] / have[c[i]] if have[c[i]] > 0 else 1)) for c, x in w.items()}
            if max(abs(w[c] - was[c]) for c in w) <= 1e-9 * max(1, *w.values()):
                break
        return w

    weight = raked({c: 1.0 for c in tokens}, goals, math.inf)
    probability = raked({c: min(1.0, fraction * x) for c, x in weight.items()}, bounded, 1.0)
    for r in rows:
        assert r["weight"] == pytest.approx(weight[cell[r["doc_id"]]], rel=1e-6, abs=1e-9)
        assert r["probability"] == pytest.approx(probability[cell[r["doc_id"]]], rel=1e-6, abs=1e-9)
    kept = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.expr("shiftrightunsigned(xxhash64(11, doc_id, text), 11) / 9007199254740992d").alias("u"))
    number = {r["doc_id"]: r["u"] for r in kept.collect()}
    assert all(r["kept"] == (number[r["doc_id"]] < r["probability"]) for r in rows)
    assert mixing.CELLS >= len(tokens)


def test_joins_of_the_near_dedup_stage_stay_off_the_driver(spark):
    """Tables that grow with the texts aren't broadcast, small as they are here; those that are have a low limit."""
    import corpus_pipeline
    from lavra.llm import simhash

    docs = spark.createDataFrame([(i, f"one two three four five {i % 3} six seven eight") for i in range(30)], "doc_id long, text string")
    found = simhash.similar(docs)
    assert found.count() == 30 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert corpus_pipeline.DROPPED <= 200_000 and simhash.MET <= 200_000


def test_similar_leaves_no_link_out(spark):
    """Pairs that just meet 0.8 (36 shingles, and 9 more) or just don't (10 more), and a passage that all of some texts share: components
    are those of all pairs."""
    import random

    from lavra.llm import simhash

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    sketch = lambda t: simhash.sketch(simhash.shingles(t.encode()))
    texts = []
    while len(texts) < 12:  # pairs at 0.8 without a band in common, or far apart by their fingerprints; others just below
        base = [word() for _ in range(40)]
        two = [" ".join(base), " ".join([*base, *(word() for _ in range(9 + (len(texts) >= 6)))])]
        (_, fp, _, keys), (_, other, _, more) = map(sketch, two)
        if len(texts) >= 6 or not set(keys) & set(more) or ((fp ^ other) & (2**64 - 1)).bit_count() > simhash.FAR:
            texts += two
    passage = [word() for _ in range(30)]
    texts += [" ".join([*passage, *(word() for _ in range(rng.randint(0, 30)))]) for _ in range(60)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    at = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    top = list(range(len(texts)))
    for i, s in enumerate(sets):
        for j in {j for x in s for j in at[x] if j < i}:
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]) and top[i] != top[j]:
                lo, hi = sorted((top[i], top[j]))
                top = [lo if t == hi else t for t in top]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    assert [got[i] for i in range(len(texts))] == top


def test_near_dedup_holds_few_texts_and_sets(spark):
    """Workers get some megabytes at a time, whatever a row holds, and the sets of shingles go once their pairs are verified."""
    from pathlib import Path

    import pyarrow as pa

    from lavra import runtime
    from lavra.llm import simhash

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["n"])

    runtime.ship(spark)
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.md5(F.col("id").cast("string")), 500).alias("text"))  # 16 KB each
    sizes = [r["n"] for r in texts.mapInArrow(run, "n long").collect()]
    assert sum(sizes) > 40e6 and max(sizes) < 12e6
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("one and the same text of several words, again and again, until "), F.col("id") % 10).alias("text"))
    simhash.similar(docs).count()
    left = [p.rsplit("/", 1)[1].split("-")[0] for p in spark.sparkContext._lavra_written if Path(p.removeprefix("file://")).exists()]
    assert "apart" in left and not {"sets", "shared"} & {*left}


def family_of(rng, n, words=60, low=2, high=6):
    """A text and copies of it, each with some words replaced by others of its own."""
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    base = [word() for _ in range(words)]
    out = [base]
    while len(out) < n:
        own = list(base)
        for at in rng.sample(range(words), rng.randint(low, high)):
            own[at] = word()
        out.append(own)
    return [" ".join(x) for x in out]


def test_pairs_of_a_family_of_near_copies_grow_with_its_texts(spark, monkeypatch):
    """Copies that differ from their source by more than similarity allows don't meet each other: four times the texts of a family give about four times
    the pairs to verify, not sixteen times."""
    import random

    from lavra.llm import simhash

    met, kept = [], simhash._confirmed
    monkeypatch.setattr(simhash, "_confirmed", lambda docs, nodes, near, *more: met.append(near.count()) or kept(docs, nodes, near, *more))
    for n in (150, 600):
        texts = family_of(random.Random(n), n, low=3, high=6)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        simhash.similar(docs).count()
    assert len(met) == 4 and met[3] <= 6 * max(met[1], 150)


@pytest.mark.parametrize("hot, depth", [(2, 3), (5, 1), (2, 0)])
def test_similar_leaves_no_link_out_of_hot_shingles(spark, monkeypatch, hot, depth):
    """Families within families, of several sizes and with passages added, told by differences once, several times and not at all: components are those of all pairs."""
    import random

    from lavra.llm import simhash

    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "DEPTH", depth)
    monkeypatch.setattr(simhash, "sketch", lambda hashes, plain=simhash.sketch: (*plain(hashes)[:3], []))  # no bands, so that the exact part has much to do
    rng = random.Random(11)
    texts = family_of(rng, 60, low=1, high=4)
    for base in texts[1:4]:
        own = base.split()
        for _ in range(25):
            new = list(own)
            for at in rng.sample(range(len(new)), rng.randint(0, 2)):
                new[at] = "".join(rng.choices("abcdefghijklmnop", k=8))
            new = new[rng.randint(0, 4) : len(new) - rng.randint(0, 4)] + ["".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(rng.randint(0, 5))]
            texts.append(" ".join(new))
    texts += family_of(rng, 40, 24, 0, 1) + ["", "one", "one two three four five"]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t else set() for t in texts]
    top = list(range(len(texts)))
    for i, s in enumerate(sets):
        for j in range(i):
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]) and top[i] != top[j]:
                lo, hi = sorted((top[i], top[j]))
                top = [lo if t == hi else t for t in top]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    assert [got[i] for i in range(len(texts))] == top and 20 < len(set(top)) < len(texts) - 20
