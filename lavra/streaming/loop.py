"""The incremental loop as transactions: rules first, residuals to a reviewer, and what it says kept with the rows.

A batch is classified by the bank that the batches before it left. Residuals go to a reviewer with their five nearest themes;
its answers become labels, candidates for themes, observations of rare cases (the second of a signature makes a candidate) and
rules. Rows, candidates, rare cases, events, measures and the bank are written as one transaction under the batch's id
(`ledger`), so that a batch that was cut short is run again as if it had never begun.

With `exact` a rule counts from the next document on, as if documents came one by one. The batch is decided in rounds:
all documents are matched once with the bank and with all rules that their reviews may bring; each rule counts for the
documents behind the first one that brings it, a document brings rules where it is a residual, and whether it is one
is decided anew until nothing changes. Each round settles one more document at least, and in most batches all of them;
a document that becomes a residual on the way is reviewed then. Reviews are taken as the same whenever a document is
reviewed. Without `exact`, rules of a batch count from the next batch on.

Documents are (doc_id, pos, title, tags, text), `pos` telling their order; null titles, tags and texts are empty ones. A
reviewer that fails for a document says so in its row (`error`); nothing else is learned from that document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions.text import fold
from lavra.operators import features, learning, reports, taxonomy, themes
from lavra.operators import rules as R
from lavra.runtime import materialise, working
from lavra.streaming.ledger import Ledger

TABLES = ("rows", "candidates", "rare", "events", "metrics", "bank")
ANSWER = "doc_id long, decision string, label string, confidence double, evidence string, rationale string, summary string, provider string, model string, prompt_tokens long, completion_tokens long, error string"
#: (doc_id, title, tags, text, nearest) -> rows of `ANSWER`.
Reviewer = Callable[[DataFrame], DataFrame]
#: (doc_id, text) -> (doc_id, rank, label, score), the nearest themes of each.
Nearest = Callable[[DataFrame], DataFrame]
NEAR = "array<struct<rank: int, label: string, score: double>>"
MADE = "Noticia rara recorrente promovida automaticamente para candidato de tema: "  # fixed value: what a promotion says


@dataclass(frozen=True)
class Setup:
    """What stays the same over a run: labels, word lists of the field, limits."""

    allowed: list[str]
    signs: list[tuple[str, list[str]]] = field(default_factory=list)  # signatures of rare cases, and their needles
    known: list[tuple[str, str]] = field(default_factory=list)  # new themes that need no reviewer, and their patterns
    required: dict[str, list[str]] = field(default_factory=dict)
    domain: tuple[str, ...] = ()
    places: tuple[str, ...] = ()
    noisy: tuple[str, ...] = ()
    stop: tuple[str, ...] = ()
    fixed: dict[str, list[str]] = field(default_factory=dict)
    keywords: dict[str, list[str]] = field(default_factory=dict)
    threshold: float = 0.85
    budget: int | None = None  # residuals of a batch that are reviewed
    negatives: int = 40
    never: str = "operacao_sem_contexto"
    at: int = 2  # the observation of a signature that makes a candidate
    exact: bool = False


def nearest_themes(known: DataFrame, profiles: DataFrame, k: int = 5) -> Nearest:
    """By cosine of the weighted terms (`features.vocabulary`) with theme profiles (profile, term, w)."""

    def near(docs: DataFrame) -> DataFrame:
        weights = features.weighted(docs, known).withColumnRenamed("doc_id", "id")
        best = features.top_k(features.cosine_pairs(weights, profiles), k)
        return best.select(F.col("id").alias("doc_id"), "rank", F.col("profile").alias("label"), F.col("cosine").alias("score"))

    return near


def _answers(docs: DataFrame, setup: Setup, reviewer: Reviewer, nearest: Nearest | None) -> DataFrame:
    """Reviews of docs as they are taken: rows of `ANSWER` with nearest, the signature of a rare case and its reason."""
    if nearest is None:
        shown = docs.withColumn("nearest", F.array().cast(NEAR))
    else:
        near = nearest(docs.select("doc_id", "text")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "score"))).alias("nearest"))
        shown = docs.join(near, "doc_id", "left").withColumn("nearest", F.coalesce("nearest", F.array()).cast(NEAR))
    shown = materialise(shown, "residuals")
    said = F.concat_ws(" ", "title", F.array_join("tags", " "), F.substring("text", 1, 1200))
    marked = themes.new_themes(shown, said, setup.allowed, setup.known)
    own = marked.where("new_theme is not null").select(
        "doc_id", F.lit("novo_tema_candidato").alias("decision"), F.col("new_theme").alias("label"), F.lit(0.9).alias("confidence"), F.col("new_theme").alias("evidence"),
        F.lit("sinais de um tema novo").alias("rationale"), F.lit("").alias("summary"), F.lit("deterministic").alias("provider"), F.lit("theme_candidate_rules").alias("model"),
        F.lit(0).cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"), F.lit(None).cast("string").alias("error"),
    )
    names = [x.split()[0] for x in ANSWER.split(", ")]
    asked = reviewer(marked.where("new_theme is null").select("doc_id", "title", "tags", "text", "nearest")).select(*names)
    answers = materialise(own.unionByName(asked), "answers")
    good = themes.reviewed(answers.where("error is null"), setup.allowed).select(*names)
    faulty = answers.where("error is not null").withColumns({"decision": F.lit("error"), "label": F.lit(""), "rationale": F.col("error")})
    rows = good.unionByName(faulty.select(*names)).join(shown, "doc_id")
    text = fold(F.concat_ws(" ", "title", "evidence", "rationale"))
    case = taxonomy.rare_case(text, setup.signs)
    rare = (F.col("decision") == "classificar") & (F.col("label") == themes.RARE)
    rows = rows.withColumn("_case", F.when(rare, case)).withColumns({"signature": F.col("_case.label"), "signature_reason": F.col("_case.reason")}).drop("_case")
    return rows.na.fill("", ["evidence", "rationale", "summary", "provider", "model"]).na.fill(0, ["prompt_tokens", "completion_tokens", "confidence"])


def _suggested(reviews: DataFrame, negatives: DataFrame, setup: Setup) -> DataFrame:
    """(doc_id, promoted, label, pattern, title, accepted, reason): the rules that each review brings, as it is and, for a rare case, as
    the candidate that it becomes where its signature comes again."""
    sides = []
    own = reviews.where(F.col("error").isNull() & (F.col("label") != themes.RARE) & (F.col("label") != ""))
    again = reviews.where(F.col("signature") != setup.never).withColumn("label", F.col("signature"))
    for promoted, rows in ((False, own), (True, again)):
        asked = rows.select("doc_id", "label", "title", "text", "evidence", "summary")
        words = (setup.required, setup.domain, setup.places, setup.noisy, setup.stop)
        found = learning.learned_rules(asked, negatives, *words, fixed=setup.fixed, keywords=setup.keywords)
        sides.append(found.select("doc_id", F.lit(promoted).alias("promoted"), "label", "pattern", "title", "accepted", "reason"))
    return materialise(sides[0].unionByName(sides[1]), "suggestions")


def _as_rules(found: DataFrame) -> DataFrame:
    """Accepted suggestions as gated rules (kind, label, pattern)."""
    own = found.where("accepted").select(
        F.lit("crime").alias("kind"), "label", "pattern", F.lit(R.WEIGHT).alias("weight"), F.lit("review").alias("source"), F.lit(1).alias("uses"),
        F.array().cast("array<string>").alias("examples"), F.lit(0).alias("pos"),
    ).distinct()
    return R.gate(own).select("kind", "label", "pattern").distinct()


def _ordered(bank: DataFrame, more: DataFrame | None = None) -> list[tuple]:
    """The rules of a bank, and others (kind, label, pattern) that it doesn't hold, in the one order that any bank has: kind, label, pattern."""
    held = {(r["kind"], r["label"], r["pattern"]): r for r in bank.collect()}  # a bank
    keys = set(held) | ({tuple(r) for r in more.collect()} if more is not None else set())  # what one batch learned
    out = []
    for pos, key in enumerate(sorted(keys), 1):
        r = held.get(key)
        out.append((*key, r["weight"], r["source"], r["uses"], r["examples"], pos) if r else (*key, R.WEIGHT, "review", 1, [], pos))
    return out


def _seen_at(matched: DataFrame, born: dict[int, int], threshold: float) -> DataFrame:
    """The records of `matched` (with `at`) by the rules that count at each row: a rule counts behind the row that brought it."""
    if born:
        since = F.map_from_arrays(F.array(*map(F.lit, born)), F.array(*(F.lit(v).cast("long") for v in born.values())))
    else:
        since = F.create_map().cast("map<int,bigint>")
    counts = lambda m: F.coalesce(F.element_at(since, m["pos"]) < F.col("at"), F.lit(False))
    rows = matched.withColumns({"body": F.filter("body", counts), "tag": F.filter("tag", counts)})
    return R.judged(rows, threshold).join(matched.select("doc_id", "at"), "doc_id")


def _within(residual: DataFrame, budget: int | None) -> DataFrame:
    """The residuals (doc_id, at) that are reviewed: the first of a batch."""
    return residual if budget is None else residual.orderBy("at").limit(budget)


def _promoted(reviews: DataFrame, before: DataFrame | None, setup: Setup) -> DataFrame:
    """`reviews` with signature_count and promoted: how often its signature has been seen, with the batches before."""
    order = Window.partitionBy("signature").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = reviews.where("signature is not null").select("doc_id", "signature", F.count("*").over(order).alias("n"))  # rare cases of one batch
    if before is not None:
        rare = rare.join(before.groupBy("signature").agg(F.count("*").alias("old")), "signature", "left").withColumn("n", F.col("n") + F.coalesce("old", F.lit(0)))
    rare = rare.select("doc_id", F.col("n").cast("long").alias("signature_count"), ((F.col("n") >= setup.at) & (F.col("signature") != setup.never)).alias("promoted"))
    return reviews.join(rare, "doc_id", "left").withColumn("promoted", F.coalesce("promoted", F.lit(False)))


def decide(docs: DataFrame, bank: DataFrame, setup: Setup, reviewer: Reviewer, nearest: Nearest | None = None, rare_before: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records of all docs with `at`; reviews of those that were reviewed, with signature_count and promoted; the suggestions that count)."""
    spark = docs.sparkSession
    empty = F.array().cast("array<string>")
    docs = docs.select("doc_id", F.col("pos").cast("long").alias("at"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "text")), F.coalesce("tags", empty).alias("tags"))
    docs = materialise(docs, "batch")
    negatives = docs.orderBy("at").limit(setup.negatives).select("doc_id", "text")  # a batch's first few
    rules, reviews, found = _ordered(bank), None, None
    own = {(r[0], r[1], r[2]) for r in rules}
    born, mark = {r[-1]: -1 for r in rules}, None  # a rule of the bank counts from the start

    def match(by):
        return materialise(R.matched(docs, by, "doc_id", "text", "tags").join(docs.select("doc_id", "at"), "doc_id"), "matched")

    matched = match(rules)
    while True:
        records = materialise(_seen_at(matched, born, setup.threshold), "records")
        asked = materialise(_within(records.where("not accepted").select("doc_id", "at"), setup.budget), "asked")
        new = asked if reviews is None else asked.join(reviews.select("doc_id"), "doc_id", "left_anti")
        if reviews is None or not new.isEmpty():
            more = materialise(_answers(docs.join(new.select("doc_id"), "doc_id", "left_semi"), setup, reviewer, nearest), "reviews")
            reviews = more if reviews is None else reviews.unionByName(more)
            also = _suggested(more, negatives, setup)
            found = also if found is None else found.unionByName(also)
            if setup.exact:
                rules = _ordered(bank, _as_rules(found))
                matched = match(rules)
        counted = materialise(_promoted(reviews.join(asked.select("doc_id"), "doc_id", "left_semi"), rare_before, setup), "counted")
        active = materialise(found.join(counted.select("doc_id", "at", "promoted"), ["doc_id", "promoted"], "left_semi"), "active")
        if not setup.exact:
            break
        place = {(r[0], r[1], r[2]): r[-1] for r in rules}
        first = active.where("accepted").join(asked, "doc_id").groupBy("label", "pattern").agg(F.min("at").alias("at"))
        since = {pos: -1 for key, pos in place.items() if key in own}
        for r in first.collect():  # what one batch learned
            # A rule that the gate refuses has no place.
            if (pos := place.get(("crime", r["label"], r["pattern"]))) is not None and pos not in since:
                since[pos] = r["at"]
        now = (tuple(asked.agg(F.count("*"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)"))).first()), tuple(sorted(since.items())))
        born = since
        if now == mark:
            break
        mark = now
    return records, counted, active


def run_batch(docs: DataFrame, batch_id: int, ledger: Ledger, setup: Setup, reviewer: Reviewer, nearest: Nearest | None = None) -> bool:
    """Decides one batch and commits its six tables; False where it is committed already. What it writes on the way goes."""
    if batch_id in ledger.batches():
        return False
    with working(docs.sparkSession):
        return _run(docs, batch_id, ledger, setup, reviewer, nearest)


def _run(docs: DataFrame, batch_id: int, ledger: Ledger, setup: Setup, reviewer: Reviewer, nearest: Nearest | None) -> bool:
    bank, folder = ledger.last("bank", batch_id)
    rare_before = ledger.read("rare", batch_id)
    records, reviews, active = decide(docs, bank, setup, reviewer, nearest, rare_before)
    taken = F.col("accepted")
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    said = reviews.withColumns({
        "rationale": F.when(F.col("promoted"), F.concat(F.lit(MADE), "signature", F.lit("."))).otherwise(F.col("rationale")),
        "decision": F.when(F.col("promoted"), "novo_tema_candidato").otherwise(F.col("decision")), "label": F.when(F.col("promoted"), F.col("signature")).otherwise(F.col("label")),
        "total_tokens": tokens,
    })
    learned = active.where("accepted").groupBy("doc_id").agg(F.array_sort(F.collect_list("pattern")).alias("learned"))  # up to three a document
    parts = ["decision", "label", "confidence", "evidence", "rationale", "summary", "provider", "model", "prompt_tokens", "completion_tokens", "total_tokens", "nearest", "error"]
    rows = records.select(
        "doc_id", "at", "accepted", F.col("confidence").alias("regex_confidence"), "source", "identity", "classification", "crimes", "modus", F.size("matched_rules").alias("matched_rules"))
    rows = rows.join(said.select("doc_id", *parts).withColumnRenamed("label", "canonical_label"), "doc_id", "left").join(learned, "doc_id", "left")
    source = F.when(taken, "agent2_regex").when(F.col("decision").isNull(), "residual_pending_agent3").when(F.col("decision") == "error", "agent3_review_error").otherwise("agent3_review")
    rows = rows.withColumns({"classification_source": source, "learned": F.coalesce("learned", F.array().cast("array<string>")), "batch_id": F.lit(batch_id)})
    rows = materialise(rows, "loop-rows")
    candidates = said.where("decision = 'novo_tema_candidato'").select(F.lit(batch_id).alias("batch_id"), "doc_id", "title", "label", "confidence", "evidence", "rationale")
    why = ["signature", "signature_reason", "signature_count", "confidence", "evidence", "rationale"]
    rare = reviews.where("signature is not null").select(F.lit(batch_id).alias("batch_id"), "doc_id", "title", *why, F.when(F.col("promoted"), F.col("signature")).otherwise("").alias("promoted_label"))
    review = F.to_json(F.struct("provider", "model", "decision", "label", "confidence", "evidence", "rationale", "prompt_tokens", "completion_tokens", "total_tokens", "nearest", "error"))
    status = F.when(F.col("decision") == "error", "error").otherwise("ok")
    events = said.select("doc_id", F.lit("llm_residual").alias("stage"), status.alias("status"), review.alias("payload"))
    refused = active.where("not accepted").select("doc_id", F.lit("agente_aprendiz_regex").alias("stage"), F.col("reason").alias("status"), F.to_json(F.struct("label", "pattern")).alias("payload"))
    events = events.unionByName(refused).withColumn("batch_id", F.lit(batch_id))
    gained = active.where("accepted").select(F.lit("crime").alias("kind"), "label", "pattern", F.lit("review").alias("source"), "title")
    tables = {"rows": rows.drop("error"), "candidates": candidates, "rare": rare, "events": events, "metrics": measures(rows, ledger.last("metrics", batch_id))}
    carry = {"bank": folder}
    if not gained.isEmpty():
        tables["bank"] = R.compact(R.gate(R.upsert(bank, materialise(gained, "gained"))))
        carry = None
    return ledger.commit(batch_id, tables, carry)


def measures(rows: DataFrame, last: tuple[DataFrame, str] | None) -> DataFrame:
    """The measures of one batch, with the running sums since the first one."""
    status = F.when(F.col("accepted"), "regex").otherwise("regex_below_threshold")
    own = rows.select("batch_id", status.alias("status"), "decision", F.col("canonical_label").alias("label"), F.size("learned").alias("learned"), "prompt_tokens", "completion_tokens", "total_tokens")
    sums = ("docs", "regex_accepted", "llm_processed")
    before = last[0].select(*(F.col(f"cumulative_{c}").alias(c) for c in sums)).first().asDict() if last else None
    return reports.cumulative(reports.batch_measures(own), before)


def begin(ledger: Ledger, rules: DataFrame) -> None:
    """The bank that a run begins with, as batch -1; a run that has begun goes on with its own."""
    ledger.commit(-1, {"bank": R.compact(R.gate(rules))})


def stream(source: DataFrame, rules: DataFrame, root: str, setup: Setup, reviewer: Reviewer, nearest: Nearest | None = None):
    """Runs all micro-batches of a stream of documents that are there, and returns the query."""
    ledger = Ledger(source.sparkSession, root)
    begin(ledger, rules)
    writer = source.writeStream.foreachBatch(lambda batch, n: run_batch(batch, n, ledger, setup, reviewer, nearest) and None)
    query = writer.option("checkpointLocation", f"{root}/_state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
