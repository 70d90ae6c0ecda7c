"""The incremental loop: transactions over several tables, and rules that count from the next document on."""

import random

import pytest
from pyspark.sql import functions as F

from lavra.functions.text import folded
from lavra.operators import rules as R
from lavra.streaming import loop
from lavra.streaming.ledger import Ledger

SEED = [("crime", "base", r"\bfirst\w*\b\s+\bsecond\w*\b", 1.4, "seed", 1, [], 1)]
DOCS = "doc_id long, pos long, title string, tags array<string>, text string"
LABELS = ["tema_a", "tema_b", "tema_c", "tema_d"]
WORDS = ["".join(random.Random(i).choices("bcdfghjklmnprstvz", k=3)) + "".join(random.Random(-i).choices("aeiou", k=2)) + str("xyz"[i % 3]) for i in range(40)]
SETUP = {"allowed": [*LABELS, "noticias_raras"], "required": {x: WORDS for x in [*LABELS, "sinal_um", "sinal_dois"]}, "signs": [("sinal_um", ["alfa"]), ("sinal_dois", ["beta"])]}


def texts(n, seed):
    rng = random.Random(seed)
    return [(i, i, f"titulo {i}", [], " ".join(rng.choices(WORDS, k=rng.randint(4, 30)) + (["first", "second"] if i % 17 == 0 else []))) for i in range(n)]


def reviewer(docs):
    """By document: labels that are allowed, new ones, rare cases of two signatures and failures; the evidence is three words of the text."""
    words = F.slice(F.split("text", " "), 1, 3)
    kind = F.col("doc_id") % 7
    return docs.select(
        "doc_id", F.when(kind == 1, "novo_tema_candidato").when(kind == 2, "quarentena").otherwise("classificar").alias("decision"),
        F.when(kind == 1, "Novo Tema").when(kind == 3, "fora da lista").otherwise(F.concat(F.lit("tema_"), F.substring(F.lit("abcd"), (F.col("doc_id") % 4 + 1).cast("int"), F.lit(1)))).alias("label"),
        F.lit(0.8).alias("confidence"), F.concat(F.array_join(words, " "), F.when(kind == 2, " alfa").otherwise(" beta")).alias("evidence"), F.lit("porque").alias("rationale"), F.lit("").alias("summary"),
        F.lit("canned").alias("provider"), F.lit("m").alias("model"), F.lit(3).cast("long").alias("prompt_tokens"), F.lit(1).cast("long").alias("completion_tokens"),
        F.when(kind == 5, "failed").alias("error"),
    )


def confidence(hits):
    """The confidence and labels of crime hits, best first."""
    by = {}
    for h in hits:
        by.setdefault(h["label"], []).append(h)
    rows = sorted(((round(sum(round(h["weight"] * h["hit_count"], 3) for h in hs), 3), sum(h["hit_count"] for h in hs)) for hs in by.values()), reverse=True)
    if not rows:
        return 0.0
    top = rows[0][0]
    kept = [rows[0], *(r for r in rows[1:] if r[0] >= max(2.0, 0.35 * top))]
    return min(0.95, 0.61 + min(0.27, 0.15 * top) + min(0.12, 0.045 * sum(n for _, n in kept)))


def one_by_one(spark, docs, setup, size):
    """Each document after the other, by plain Python: {doc_id: (accepted, decision, label, learned)}."""
    bank = {(r[0], r[1], r[2]) for r in SEED}
    rare, out = {}, {}
    for at in range(0, len(docs), size):
        batch = docs[at : at + size]
        frame = spark.createDataFrame(batch, DOCS)
        said = loop._answers(frame.withColumn("at", F.col("pos")), setup, reviewer, None)
        reviews = {r["doc_id"]: r for r in said.collect()}
        suggested, every = {}, []
        found = loop._suggested(said, frame.orderBy("pos").limit(setup.negatives).select("doc_id", "text"), setup)
        gated = {tuple(r) for r in loop._as_rules(found).collect()}
        for r in found.where("accepted").collect():
            suggested.setdefault((r["doc_id"], r["promoted"]), []).append(("crime", r["label"], r["pattern"]))
        every = sorted(bank | gated)
        tool = R.Matcher([(*k, 1.4, "", 1, [], i) for i, k in enumerate(every)])
        asked = 0
        for doc in batch:
            hits = [h for h in tool.hits(folded(doc[4])) if every[h["pos"]] in bank]
            if round(confidence(hits), 10) >= 0.85:
                out[doc[0]] = (True, None, None, [])
                continue
            asked += 1
            if setup.budget is not None and asked > setup.budget:
                out[doc[0]] = (False, None, None, [])
                continue
            r = reviews[doc[0]]
            decision, label, promoted = r["decision"], r["label"], False
            if r["signature"]:
                rare[r["signature"]] = rare.get(r["signature"], 0) + 1
                if promoted := rare[r["signature"]] >= 2:
                    decision, label = "novo_tema_candidato", r["signature"]
            rules = suggested.get((doc[0], promoted), [])
            bank |= {x for x in rules if x in gated}
            out[doc[0]] = (False, decision, label, sorted(p for _, _, p in rules))
    return out


@pytest.mark.parametrize(("n", "size", "budget"), [(1000, 1000, None), (360, 130, None), (200, 200, 25)])
def test_rules_count_from_the_next_document_on(spark, tmp_path, n, size, budget):
    docs, setup = texts(n, size), loop.Setup(**SETUP, exact=True, budget=budget)
    ledger = Ledger(spark, f"file://{tmp_path}/run")
    loop.begin(ledger, R.bank(spark, SEED))
    for k, at in enumerate(range(0, n, size)):
        assert loop.run_batch(spark.createDataFrame(docs[at : at + size], DOCS), k, ledger, setup, reviewer)
    got = {r["doc_id"]: (r["accepted"], r["decision"], r["canonical_label"], r["learned"]) for r in ledger.read("rows").collect()}
    want = one_by_one(spark, docs, setup, size)
    assert got == want
    assert sum(a for a, *_ in want.values()) > len(want) / 4 and any(x[3] for x in want.values())


def test_batches_are_transactions(spark, tmp_path):
    """A batch that stops between two tables shows nothing, and is whole when it is run again."""

    class Stops(Ledger):
        def _at(self, path):
            if path.endswith("candidates/batch=1/try") or f"{self.root}/_commits/.1-" in path:
                raise OSError("lost")
            return super()._at(path)

    root, setup = f"file://{tmp_path}/run", loop.Setup(**SETUP)
    docs = texts(60, 5)
    batches = [spark.createDataFrame(docs[i : i + 20], DOCS) for i in (0, 20, 40)]
    ledger = Ledger(spark, root)
    loop.begin(ledger, R.bank(spark, SEED))
    assert loop.run_batch(batches[0], 0, ledger, setup, reviewer)
    seen = {t: ledger.read(t).count() for t in loop.TABLES}
    with pytest.raises(OSError):
        loop.run_batch(batches[1], 1, Stops(spark, root), setup, reviewer)
    assert {t: ledger.read(t).count() for t in loop.TABLES} == seen
    assert loop.run_batch(batches[1], 1, ledger, setup, reviewer) and not loop.run_batch(batches[1], 1, ledger, setup, reviewer)
    assert loop.run_batch(batches[2], 2, ledger, setup, reviewer)
    assert ledger.read("rows").count() == 60 and ledger.batches() == [-1, 0, 1, 2]
    last = ledger.last("metrics")[0].first()
    assert last["cumulative_docs"] == 60 and ledger.read("metrics").count() == 3
    assert last["cumulative_llm_processed"] == ledger.read("events").where("stage = 'llm_residual' and status = 'ok'").count()
    assert ledger.read("candidates").count() == ledger.read("rows").where("decision = 'novo_tema_candidato'").count()
    assert ledger.vacuum() == 6 and ledger.vacuum() == 0 and ledger.read("rows").count() == 60


def test_loop_as_a_stream_and_odd_batches(spark, tmp_path):
    docs = texts(40, 9)
    spark.createDataFrame(docs[:20], DOCS).coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda: loop.stream(spark.readStream.schema(DOCS).parquet(f"{tmp_path}/in"), R.bank(spark, SEED), f"file://{tmp_path}/run", loop.Setup(**SETUP), reviewer)
    run()
    spark.createDataFrame(docs[20:], DOCS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    ledger = Ledger(spark, f"file://{tmp_path}/run")
    assert ledger.batches() == [-1, 0, 1] and ledger.read("rows").count() == 40
    odd = spark.createDataFrame([(100, 1, None, None, None)], DOCS)
    assert loop.run_batch(odd, 2, ledger, loop.Setup(**SETUP), reviewer)
    assert loop.run_batch(odd.limit(0), 3, ledger, loop.Setup(**SETUP, exact=True), reviewer)
    assert ledger.read("rows").count() == 41
