"""Queries of the incremental loop, each with the SQL that states what its tables hold."""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.functions import providers
from lavra.functions import table as table_functions
from lavra.operators import rules, sampling
from lavra.plans.queries import FOLD, RULES, SQUEEZE, _values, docs_of, query  # isort: skip  (first: it imports the others)
from lavra.plans.more import MEASURED, _measured
from lavra.runtime import shared_dir, table
from lavra.streaming import incremental, loop
from lavra.streaming.ledger import Ledger

BANK = [r for r in RULES if r[-1] != 6]  # all but one are valid
#: What the reviews of each language's new theme bring, where the checks let it.
NEW = {"en": ("the", "her"), "de": ("und", "die"), "fr": ("les", "des"), "es": ("los", "men")}
PATTERNS = {lang: rf"\b{a}\w*\b.{{0,60}}\b{b}\w*\b" for lang, (a, b) in NEW.items()}
ADDED = [("crime", f"qxzvtema_{lang}", p, 1.4, "review", 1, [], 100 + i) for i, (lang, p) in enumerate(PATTERNS.items())]
SETUP = {
    "allowed": ["alpha", "beta", "noticias_raras"], "required": {f"qxzvtema_{x}": list(w) for x, w in NEW.items()}, "fixed": {f"qxzvtema_{x}": [p] for x, p in PATTERNS.items()},
    "signs": [("sinal_de", ["caso de"]), ("sinal_fr", ["caso fr"])],
}
BATCHES = 3


def _review(docs: DataFrame) -> DataFrame:
    """A reviewer whose answer hangs on the document's number and language."""
    n, lang = F.col("doc_id") % 6, F.get("tags", F.lit(0))
    return docs.select(
        "doc_id", F.when(n.isin(0, 5), "novo_tema_candidato").when(n == 3, "quarentena").otherwise("classificar").alias("decision"),
        F.when(n == 0, F.concat(F.lit("Qxzvtema "), lang)).when(n == 1, "alpha").when(n == 5, "").otherwise("zzzzz qqqqq").alias("label"),
        (F.col("doc_id") % 10 / 10).alias("confidence"), F.concat(F.lit("caso "), lang).alias("evidence"), F.lit("porque").alias("rationale"), F.lit("").alias("summary"),
        F.lit("canned").alias("provider"), F.lit("m").alias("model"), (F.col("doc_id") % 5).alias("prompt_tokens"), F.lit(1).cast("long").alias("completion_tokens"),
        F.when(n == 4, "failed").alias("error"),
    )


class _Stops(Ledger):
    """A run that is lost when all tables of a batch are written, and their marker isn't."""

    def _at(self, path: str):
        if f"{self.root}/_commits/." in path:
            raise ConnectionError("lost")
        return super()._at(path)


def _decided(n: int) -> str:
    """SQL of one batch: what the bank of the batches before it makes of its documents, and what their reviews bring."""
    learned = " UNION ".join(f"SELECT pos FROM l{k}" for k in range(n)) or "SELECT -1"
    return f"""
  g{n} AS (SELECT doc_id, kind, label, sum(hit_count) AS hit_count, round(sum(score), 3) AS score FROM m WHERE b = {n} AND (pos < 100 OR pos IN ({learned})) GROUP BY ALL),
  k{n} AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, hit_count DESC) AS rank, max(score) OVER (PARTITION BY doc_id) AS top FROM g{n} WHERE kind = 'crime'),
  o{n} AS (SELECT doc_id, max(top) AS top, sum(hit_count) AS hits FROM k{n} WHERE rank = 1 OR score >= greatest(2.0, 0.35 * top) GROUP BY 1),
  z{n} AS (
    SELECT d.doc_id, d.lang, d.b, CASE WHEN top IS NULL THEN 0.0 ELSE round(least(0.95::DOUBLE, 0.61::DOUBLE + least(0.27::DOUBLE, 0.15::DOUBLE * top)
        + least(0.12::DOUBLE, 0.045::DOUBLE * hits) + CASE WHEN d.doc_id IN (SELECT doc_id FROM g{n} WHERE kind = 'modus') THEN 0.05::DOUBLE ELSE 0::DOUBLE END), 4) END AS confidence
    FROM docs AS d LEFT JOIN o{n} USING (doc_id) WHERE d.b = {n}),
  s{n} AS (
    SELECT z.doc_id, r.pos, r.label, r.pattern, CASE WHEN m.pos IS NULL THEN 'no_positive' WHEN neg.hits > (SELECT greatest(2, floor(0.15 * least(40, count(*)))) FROM docs WHERE b = {n}) THEN 'negatives' ELSE 'ok' END AS reason
    FROM z{n} AS z JOIN added AS r ON r.label = 'qxzvtema_' || z.lang LEFT JOIN m ON m.doc_id = z.doc_id AND m.pos = r.pos LEFT JOIN neg ON neg.pos = r.pos AND neg.b = {n}
    WHERE z.confidence < 0.85 AND z.doc_id % 6 = 0),
  l{n} AS (SELECT * FROM s{n} WHERE reason = 'ok')"""


def _all(name: str) -> str:
    return " UNION ALL ".join(f"SELECT {n} AS batch_id, * FROM {name}{n}" for n in range(BATCHES))


LOOP = f"""WITH docs AS (SELECT doc_id, lang, doc_id % {BATCHES} AS b, {FOLD.format('text')} AS t FROM documents),
  added AS (SELECT * FROM {_values(ADDED)} AS r), rules AS (SELECT * FROM {_values(BANK)} AS a UNION ALL SELECT * FROM added),
  h AS (SELECT doc_id, b, pos, kind, label, weight, list_distinct(list_transform(regexp_extract_all(t, pattern, 0, 'i'), lambda x: {SQUEEZE.format('x')})) AS hits FROM docs CROSS JOIN rules),
  m AS (SELECT doc_id, b, pos, kind, label, len(hits) AS hit_count, round(weight * len(hits), 3) AS score FROM h WHERE len(hits) > 0),
  first AS (SELECT doc_id, b FROM docs QUALIFY row_number() OVER (PARTITION BY b ORDER BY doc_id) <= 40),
  neg AS (SELECT m.b, m.pos, count(*) AS hits FROM m JOIN first USING (doc_id) GROUP BY ALL),
  {', '.join(_decided(n) for n in range(BATCHES))},
  z AS ({_all('z')}), s AS ({_all('s')}),
  a AS (SELECT batch_id, doc_id, lang, confidence, doc_id % 6 AS n FROM z WHERE confidence < 0.85),
  rare AS (
    SELECT *, row_number() OVER (PARTITION BY signature ORDER BY batch_id, doc_id) AS seen
    FROM (SELECT *, CASE lang WHEN 'de' THEN 'sinal_de' WHEN 'fr' THEN 'sinal_fr' ELSE 'rara_caso_classificado_como' END AS signature FROM a WHERE n IN (2, 3, 5))),
  said AS (
    SELECT a.batch_id, a.doc_id, a.n, CASE WHEN a.n = 4 THEN 'error' WHEN a.n = 0 OR seen >= 2 THEN 'novo_tema_candidato' ELSE 'classificar' END AS decision,
      CASE WHEN a.n = 0 THEN 'qxzvtema_' || a.lang WHEN a.n = 1 THEN 'alpha' WHEN a.n = 4 THEN '' WHEN seen >= 2 THEN signature ELSE 'noticias_raras' END AS label, 'caso ' || a.lang AS evidence
    FROM a LEFT JOIN rare USING (doc_id)),
  lc AS (SELECT doc_id, count(*) AS learned FROM s WHERE reason = 'ok' GROUP BY 1),
  w AS (
    SELECT z.batch_id, z.doc_id, z.confidence, said.decision, said.label, coalesce(lc.learned, 0) AS learned,
      CASE WHEN z.confidence >= 0.85 THEN 'agent2_regex' WHEN decision = 'error' THEN 'agent3_review_error' ELSE 'agent3_review' END AS source
    FROM z LEFT JOIN said USING (doc_id) LEFT JOIN lc USING (doc_id)),
  me AS (
    SELECT batch_id, count(*) AS docs, count_if(decision IS NULL) AS accepted, count_if(decision <> 'error') AS llm, count_if(decision = 'classificar') AS classified,
      count_if(decision = 'novo_tema_candidato') AS candidates, count_if(decision = 'classificar' AND label = 'noticias_raras') AS rare_news, count_if(decision = 'error') AS errors,
      sum(learned) AS learned, sum(CASE WHEN decision IS NOT NULL THEN doc_id % 5 + 1 ELSE 0 END) AS tokens FROM w GROUP BY 1)
SELECT 'rows' AS tbl, batch_id::INTEGER AS batch_id, doc_id, source AS k, concat_ws('|', decision, label, learned::VARCHAR) AS v FROM w
UNION ALL SELECT 'candidates', batch_id::INTEGER, doc_id, label, evidence FROM said WHERE decision = 'novo_tema_candidato'
UNION ALL SELECT 'rare', batch_id::INTEGER, doc_id, signature, seen || '|' || CASE WHEN seen >= 2 THEN signature ELSE '' END FROM rare
UNION ALL SELECT 'events', batch_id::INTEGER, doc_id, 'llm_residual', CASE WHEN n = 4 THEN 'error' ELSE 'ok' END FROM said
UNION ALL SELECT 'events', batch_id::INTEGER, doc_id, 'agente_aprendiz_regex', reason FROM s WHERE reason <> 'ok'
UNION ALL SELECT 'metrics', batch_id::INTEGER, -1, 'measures', concat_ws('|', docs, accepted, llm, classified, candidates, rare_news, errors, learned, tokens, sum(docs) OVER o, sum(accepted) OVER o, sum(llm) OVER o) FROM me WINDOW o AS (ORDER BY batch_id)
UNION ALL SELECT 'bank', -1, -1, label, pattern || '|' || uses FROM {_values(BANK)} AS c
UNION ALL SELECT 'bank', -1, -1, label, pattern || '|' || count(*) FROM s WHERE reason = 'ok' GROUP BY label, pattern"""


@query(LOOP)
def loop_tables(spark, sf):
    """All documents in three batches, the second of which is lost once between its tables and their marker: what the six tables hold."""
    root = f"{shared_dir(spark)}/lavra/loop-{uuid.uuid4().hex}"
    ledger, setup = Ledger(spark, root), loop.Setup(**SETUP)
    docs = docs_of(spark, sf).select("doc_id", F.col("doc_id").alias("pos"), F.lit("T").alias("title"), F.array("lang").alias("tags"), "text")
    loop.begin(ledger, rules.bank(spark, BANK))
    for n in range(BATCHES):
        batch = docs.where(F.col("doc_id") % BATCHES == n)
        if n == 1:
            try:
                loop.run_batch(batch, n, _Stops(spark, root), setup, _review)
            except ConnectionError:
                pass
        loop.run_batch(batch, n, ledger, setup, _review)
    text = lambda *parts: F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    measures = ("docs", "regex_accepted", "llm_processed", "classified", "new_theme_candidates", "rare_news", "errors", "learned_rules", "tokens", "cumulative_docs", "cumulative_regex_accepted", "cumulative_llm_processed")
    told = {
        "rows": ("classification_source", text("decision", "canonical_label", F.size("learned"))), "candidates": ("label", F.col("evidence")),
        "rare": ("signature", text("signature_count", "promoted_label")), "events": ("stage", F.col("status")), "metrics": (F.lit("measures"), text(*measures)), "bank": ("label", text("pattern", "uses")),
    }
    out = None
    for name, (k, v) in told.items():
        rows = ledger.last("bank")[0] if name == "bank" else ledger.read(name)
        has = lambda c, kind, rows=rows: (F.col(c) if c in rows.columns else F.lit(-1)).cast(kind).alias(c)
        part = rows.select(F.lit(name).alias("tbl"), has("batch_id", "int"), has("doc_id", "long"), (F.col(k) if isinstance(k, str) else k).alias("k"), v.alias("v"))
        out = part if out is None else out.unionByName(part)
    return out


# Table functions

CHECKED = f"""WITH docs AS (SELECT doc_id, lang, doc_id % {BATCHES} AS b, {FOLD.format('text')} AS t FROM documents), added AS (SELECT * FROM {_values(ADDED)} AS r),
  first AS (SELECT doc_id, b FROM docs QUALIFY row_number() OVER (PARTITION BY b ORDER BY doc_id) <= 40),
  neg AS (SELECT d.b, r.pos, count_if(regexp_matches(d.t, r.pattern, 'i')) AS hits, count(*) AS n FROM docs AS d JOIN first USING (doc_id) CROSS JOIN added AS r GROUP BY ALL)
SELECT d.b AS batch_id, d.doc_id, r.label, r.pattern, reason = 'ok' AS accepted, reason FROM (
  SELECT d.*, r.label, r.pattern, CASE WHEN NOT regexp_matches(d.t, r.pattern, 'i') THEN 'no_positive' WHEN neg.hits > greatest(2, floor(0.15 * neg.n)) THEN 'negatives' ELSE 'ok' END AS reason
  FROM docs AS d JOIN added AS r ON r.label = 'qxzvtema_' || d.lang JOIN neg ON neg.b = d.b AND neg.pos = r.pos) AS d JOIN added AS r ON r.label = d.label"""


@query(CHECKED.replace("d.b AS batch_id, d.doc_id, r.label, r.pattern, reason", "d.b AS batch_id, d.doc_id, d.label, d.pattern, reason"))
def checked_rules_sql(spark, sf):
    """The rules that a review of each document brings, by a table function over documents, reviews and negatives in SQL."""
    table_functions.register(spark)
    d = docs_of(spark, sf)
    d.createOrReplaceTempView("lavra_documents")
    options = json.dumps({k: SETUP[k] for k in ("required", "fixed")})
    parts = d.count() // 4000 + 1  # of a batch, each with the batch's negatives, so that a task's reviews don't grow with the table
    return spark.sql(f"""
        WITH d AS (SELECT doc_id % {BATCHES} AS batch_id, doc_id, lang, text FROM lavra_documents),
          n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY doc_id) AS n FROM d) WHERE n <= 40)
        SELECT r.batch_id div {parts} AS batch_id, r.doc_id, r.label, r.pattern, r.accepted, r.reason FROM checked_rules(TABLE(
            SELECT batch_id * {parts} + part AS batch_id, 'negative' AS side, doc_id, '' AS label, '' AS title, text, '' AS evidence, '' AS summary, '' AS pattern FROM n, (SELECT explode(sequence(0, {parts - 1})) AS part)
            UNION ALL SELECT batch_id * {parts} + pmod(hash(doc_id), {parts}), 'review', doc_id, 'qxzvtema_' || lang, 'T', text, '', '', '' FROM d), r'{options}') AS r""")


# Providers

def _local(session, model: str, prompt: str, timeout: float) -> tuple[str, dict]:
    """A slow model: it fails for every third conversation; what it was out of patience for it answers in 300 seconds."""
    conv, turn = map(int, prompt.split(":", 2)[:2])
    if model == "small" and conv % 3 == 0:
        raise ConnectionError("refused")
    if turn % 4 == 1 and timeout < 300:
        raise TimeoutError("too slow")
    return f'said {{"label": "l{conv % 5}"}} thus', {"prompt_eval_count": len(prompt), "eval_count": 2}


def _remote(session, model: str, prompt: str, timeout: float) -> tuple[str, dict]:
    """A service that counts its session's prompts; it is out of its rate for some turns, and answers others without an object."""
    conv, turn = map(int, prompt.split(":", 2)[:2])
    if turn % 4 == 1 and conv % 2:
        raise providers.Limited("429")
    if conv % 10 == 4:
        return "nothing", {}
    return '{"label": "remote"}', {"prompt_tokens": 7, "completion_tokens": 1, "total_tokens": 0}


def _chain() -> list[providers.Provider]:
    return [providers.Provider("local", _local, ("small", "large"), retries=0), providers.Provider("remote", _remote, ("r",), retries=0, when_limited="local")]


@query("""WITH c AS (SELECT conv_id, turn, length(conv_id || ':' || turn || ':' || text) AS n, turn % 4 = 1 AS slow, turn % 4 = 1 AND conv_id % 2 = 1 AS limited, conv_id % 10 = 4 AS empty, conv_id % 3 = 0 AS refused FROM conversations)
SELECT conv_id, turn, CASE WHEN NOT slow OR limited THEN 'local' WHEN NOT empty THEN 'remote' END AS provider, CASE WHEN (NOT slow OR limited) AND refused THEN 'large' WHEN NOT slow OR limited THEN 'small' WHEN NOT empty THEN 'r' END AS model,
  CASE WHEN NOT slow OR limited THEN n WHEN NOT empty THEN 7 ELSE 0 END AS prompt_tokens, CASE WHEN NOT slow OR limited THEN n + 2 WHEN NOT empty THEN 8 ELSE 0 END AS total_tokens,
  CASE WHEN NOT slow OR limited THEN 'l' || conv_id % 5 WHEN NOT empty THEN 'remote' END AS label,
  (CASE WHEN NOT slow THEN refused::INTEGER WHEN limited THEN 3 + refused::INTEGER WHEN empty THEN 3 ELSE 2 END)::INTEGER AS faults, slow AND NOT limited AND empty AS unanswered FROM c""")
def provider_chain(spark, sf):
    """Each turn of the conversations asked of a chain of two providers: who answered, with which tokens and after how many faults."""
    c = table(spark, sf, "conversations").withColumn("prompt", F.concat_ws(":", "conv_id", "turn", "text"))
    got = providers.answered(c, _chain())
    return got.select(
        "conv_id", "turn", "provider", "model", "prompt_tokens", "total_tokens", F.get_json_object("answer", "$.label").alias("label"), F.size("faults").alias("faults"), F.col("error").isNotNull().alias("unanswered")
    )


# Keys that are used up, and keys of a time

@query("""WITH e AS (SELECT event_id, event_type || user_id % 50 AS k, event_id % 3 = 0 AS held FROM events), i AS (SELECT k, count(*) AS n FROM e WHERE held GROUP BY 1),
r AS (SELECT event_id, k, row_number() OVER (PARTITION BY k ORDER BY event_id) AS o FROM e WHERE NOT held AND NOT starts_with(k, 'view1'))
SELECT 'row' AS what, event_id, k, o AS a, coalesce(n, 0) AS b, o <= coalesce(n, 0) AS matched FROM r LEFT JOIN i USING (k)
UNION ALL SELECT 'key', -1, k, least(coalesce(n, 0), coalesce(m, 0)), greatest(coalesce(n, 0) - coalesce(m, 0), 0) - greatest(coalesce(m, 0) - coalesce(n, 0), 0), false FROM i FULL JOIN (SELECT k, count(*) AS m FROM r GROUP BY 1) USING (k)""")
def consuming_match(spark, sf):
    """Events matched with an inventory of others of their kind, each item once; and what either side has left."""
    e = table(spark, sf, "events").select("event_id", F.concat("event_type", F.col("user_id") % 50).alias("k"))
    inventory, rows = e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0 and not startswith(k, 'view1')")
    each = sampling.consume(rows, inventory, "k", ["event_id"])
    left = sampling.balance(rows, inventory, "k")
    keys = left.select(F.lit("key").alias("what"), F.lit(-1).cast("long").alias("event_id"), "k", F.col("matched").alias("a"), (F.col("surplus") - F.col("missing")).alias("b"), F.lit(False).alias("matched"))
    return each.select(F.lit("row").alias("what"), "event_id", "k", F.col("occurrence").cast("long").alias("a"), F.col("held").alias("b"), "matched").unionByName(keys)


LATE = 4 * 86400 + 1  # seconds
PARTS = [("2024-01-01", "2024-01-09"), ("2024-01-09", "2024-01-12"), ("2024-01-12", "2024-02-01")]


@query(f"""WITH e AS (SELECT event_id, user_id, ts, CASE {' '.join(f"WHEN ts < TIMESTAMP '{b}' THEN {i}" for i, (_, b) in enumerate(PARTS))} END AS f FROM events),
  p0 AS (SELECT user_id, min(ts) AS ts FROM e WHERE f = 0 GROUP BY 1), w0 AS (SELECT max(ts) - INTERVAL {LATE} SECOND AS w FROM e WHERE f = 0),
  p1 AS (SELECT user_id, min(ts) AS ts FROM e WHERE f = 1 AND user_id NOT IN (SELECT user_id FROM p0, w0 WHERE p0.ts + INTERVAL {LATE} SECOND > w) GROUP BY 1),
  w1 AS (SELECT max(ts) - INTERVAL {LATE} SECOND AS w FROM e WHERE f <= 1),
  s1 AS (SELECT user_id, max(ts) AS ts FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1) GROUP BY 1),
  p2 AS (SELECT user_id, min(ts) AS ts FROM e WHERE f = 2 AND user_id NOT IN (SELECT user_id FROM s1, w1 WHERE s1.ts + INTERVAL {LATE} SECOND > w) GROUP BY 1)
SELECT user_id, ts FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2""")
def stream_first_seen(spark, sf):
    """Users of an event stream over three runs; who comes again within the watermark's time is left out, later ones count anew."""
    root = f"{shared_dir(spark)}/lavra/seen-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    for n, (a, b) in enumerate(PARTS):  # a run takes what has come by then
        day = lambda x: F.lit(datetime.datetime.fromisoformat(x))
        e.where((F.col("ts") >= day(a)) & (F.col("ts") < day(b))).coalesce(1).sortWithinPartitions("ts").write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(e.schema).parquet(f"{root}/in")
        out = incremental.first_seen(source, "user_id", late=f"{LATE} seconds").writeStream.format("parquet").option("path", f"{root}/out")
        out.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


SUMS = ", ".join(f"({'1000 + ' if m == 'docs' else '7 + ' if m == 'tokens' else ''}sum({m}))::BIGINT AS {m}" for m in incremental.MEASURES)


@query(f"""WITH {MEASURED}, t AS (SELECT {SUMS} FROM me)
SELECT *, CASE WHEN llm_processed > 0 THEN round(tokens / llm_processed, 4) ELSE 0 END AS avg_tokens, round(regex_accepted / docs, 6) AS rate FROM t""")
def stream_measures(spark, sf):
    """All measures of a stream over two runs, on top of those of an earlier run."""
    root = f"{shared_dir(spark)}/lavra/measures-{uuid.uuid4().hex}"
    rows = _measured(spark, sf)
    before = spark.createDataFrame([tuple(1000 if m == "docs" else 7 if m == "tokens" else 0 for m in incremental.MEASURES)], ", ".join(f"{m} long" for m in incremental.MEASURES))
    for side in ("batch_id <= 3", "batch_id > 3"):
        rows.where(side).write.mode("append").parquet(f"{root}/in")
        incremental.total_stream(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), f"{root}/run", before)
    return incremental.totals(spark, f"{root}/run")
