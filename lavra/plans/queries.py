"""The engine's queries, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lavra.functions import text as tx
from lavra.operators import features, learning, reduce, reports, rules, sampling, taxonomy
from lavra.runtime import materialise, spread, table
from lavra.sources import markup
from lavra.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# A neutral bank: frequent syllables of the tables' languages.
STOP = ["the", "and", "der", "die", "und", "que", "les", "des", "del", "las", "los", "for", "was", "est", "une"]
ANCHORS = ["tion", "heit", "eau", "ado"]
RULES = [
    ("crime", "alpha", r"\bthe\w*\b\s+\bone\w*\b", 1.4, "seed", 1, ["x"], 1),
    ("crime", "alpha", r"\bhet\w*\b\s+\band\w*\b", 1.4, "seed", 2, ["y"], 2),
    ("crime", "beta", r"\bder\w*\b\s+\bein\w*\b", 1.4, "seed", 1, ["z"], 3),
    ("crime", "beta", r"\bdie\w*\b.{0,40}\bver\w*\b", 1.4, "learned", 3, ["x", "y"], 4),
    ("crime", "gamma", r"\blas\w*\b\s+\bcio\w*\b", 1.2, "seed", 1, [], 5),
    ("crime", "gamma", r"\bque\w*\b.{0,40}\bmen\w*\b", 1.6, "learned", 1, ["w"], 6),
    ("crime", "delta", r"\bLES\w*\b\s+\bEau\w*\b", 1.4, "seed", 4, [], 7),
    ("modus", "omega", r"\band\w*\b\s+\bing\w*\b", 1.4, "seed", 1, [], 8),
    ("modus", "sigma", r"\bund\w*\b\s+\bgeb\w*\b", 1.4, "seed", 1, [], 9),
]
#: Raw rules as they come in: repeats, a numeric anchor, a single anchor, an unknown kind.
RAW = [
    *RULES,
    ("crime", "alpha", r"\bthe\w*\b\s+\bone\w*\b", 2.0, "learned", 5, ["x", "q"], 10),
    ("crime", "beta", r"\bder\w*\b\s+\b2024\w*\b", 1.4, "seed", 1, [], 11),
    ("crime", "delta", r"\bles\w*\b", 1.4, "seed", 1, [], 12),
    ("other", "delta", r"\bles\w*\b\s+\bune\w*\b", 1.4, "seed", 1, [], 13),
    ("modus", "omega", r"\band\w*\b\s+\bing\w*\b", 1.4, "learned", 0, ["k"], 14),
    ("crime", "Épsilon Um", r"\bThe\w*\b\s+\bher\w*\b", 0.0, " ", 2, [" e ", "", "e"], 15),
    ("crime", "beta", r"\bder\w*\b\s+\bg20\w*\b", 1.4, "seed", 1, [], 16),
    ("crime", "beta", r"\bder\w*\b\s+\boperacao\w*\b", 1.4, "seed", 1, [], 17),
    ("crime", "beta", r"\bder\w*\b\s+\bein\w*\b\s+\bhttp\w*\b", 1.4, "seed", 1, [], 18),
    ("crime", "beta", r"\bder\w*\b\s+(\bein\w*\b", 1.4, "seed", 1, [], 19),
]


def _values(rows) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    items = ", ".join(f"({q(k)}, {q(l)}, {q(p)}, {w}::DOUBLE, {q(s)}, {u}, [{', '.join(map(q, e))}]::VARCHAR[], {n})" for k, l, p, w, s, u, e, n in rows)
    return f"(SELECT * FROM (VALUES {items}) AS r(kind, label, pattern, weight, source, uses, examples, pos))"


def _list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


FOLD = "lower(regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g'))"
SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
TOKENS = "regexp_extract_all(" + FOLD + ", '[a-z0-9]{{3,}}')"
STOPS = "[" + ", ".join(f"'{s}'" for s in STOP) + "]"

HITS = f"""
  f AS (SELECT doc_id, {FOLD.format('text')} AS t FROM documents),
  h AS (SELECT doc_id, pos, kind, label, weight, list_distinct(list_transform(regexp_extract_all(t, pattern, 0, 'i'), lambda x: {SQUEEZE.format('x')})) AS hits FROM f CROSS JOIN {_values(RULES)} AS r),
  m AS (SELECT doc_id, pos, kind, label, len(hits)::INTEGER AS hit_count, round(weight * len(hits), 3) AS score FROM h WHERE len(hits) > 0)"""
MERGED = HITS + """,
  g AS (SELECT doc_id, kind, label, sum(hit_count)::INTEGER AS hit_count, round(sum(score), 3) AS score, min(struct_pack(s := -score, p := pos)) AS f FROM m GROUP BY 1, 2, 3),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, f) AS rank, max(score) OVER (PARTITION BY doc_id) AS top FROM g WHERE kind = 'crime'),
  c AS (SELECT * FROM k WHERE rank = 1 OR score >= greatest(2.0, 0.35 * top))"""
CLASSIFIED = MERGED + """,
  o AS (SELECT doc_id, min_by(label, rank) AS label, max(top) AS top, sum(hit_count) AS hits, string_agg(label, ',' ORDER BY rank) AS labels FROM c GROUP BY 1),
  n AS (SELECT doc_id, count(*) AS n_modus FROM g WHERE kind = 'modus' GROUP BY 1),
  z AS (SELECT d.doc_id, o.label, labels, CASE WHEN o.label IS NULL THEN 0.0::DOUBLE ELSE round(least(0.95::DOUBLE, 0.61::DOUBLE + least(0.27::DOUBLE, 0.15::DOUBLE * top) + least(0.12::DOUBLE, 0.045::DOUBLE * hits) + CASE WHEN n_modus > 0 THEN 0.05::DOUBLE ELSE 0::DOUBLE END), 4) END AS confidence
        FROM documents d LEFT JOIN o USING (doc_id) LEFT JOIN n USING (doc_id)),
  cl AS (SELECT doc_id, label, labels, confidence, CASE WHEN confidence < 0.85 THEN 'regex_below_threshold' ELSE 'classificado_regex' END AS status FROM z)"""


def docs_of(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return rules.classify(docs_of(spark, sf), RULES)


# Text

@query(f"SELECT doc_id, md5({FOLD.format('text')}) AS folded_md5, length({FOLD.format('text')})::INTEGER AS n FROM documents")
def fold_text(spark, sf):
    f = tx.fold(F.col("text"))
    return docs_of(spark, sf).select("doc_id", F.md5(f).alias("folded_md5"), F.length(f).alias("n"))


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace({FOLD.format('text')}, '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug_md5 FROM documents")
def slug(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.md5(tx.slug(F.col("text"))).alias("slug_md5"))


@query(f"SELECT doc_id, md5(array_to_string(list_filter({TOKENS.format('text')}, lambda x: NOT list_contains({STOPS}, x) AND NOT regexp_matches(x, '^[0-9]+[a-z]*$')), ' ')) AS tokens_md5 FROM documents")
def clean_tokens(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.md5(F.array_join(tx.domain_tokens(F.col("text"), STOP), " ")).alias("tokens_md5"))


@query(f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex({FOLD.format('text')}, '[.!?;\\n]+'), lambda x: {SQUEEZE.format('x')}), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s)::INTEGER AS sentences, len(list_distinct(list_filter(s, lambda x: contains(x, 'tion') OR contains(x, 'heit') OR contains(x, 'eau') OR contains(x, 'ado'))))::INTEGER AS held FROM s""")
def sentence_split(spark, sf):
    t = F.col("text")
    return docs_of(spark, sf).select("doc_id", F.size(tx.sentences(tx.fold(t))).alias("sentences"), F.size(tx.anchored(t, ANCHORS, 1_000_000)).alias("held"))


@query(f"""WITH w AS (SELECT doc_id, lang, {TOKENS.format('text')} AS w FROM documents),
g AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM w)
SELECT lang, gram, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 3""")
def ngrams(spark, sf):
    grams = docs_of(spark, sf).select("lang", F.explode(tx.ngrams(tx.tokens(F.col("text")), 2)).alias("gram"))
    return grams.groupBy("lang", "gram").agg(F.count("*").alias("n")).where("n >= 3")


@query("SELECT doc_id, CASE WHEN length(text) > 240 THEN rtrim(substr(text, 1, 237)) || '...' ELSE text END AS short FROM documents")
def truncate_text(spark, sf):
    return docs_of(spark, sf).select("doc_id", tx.truncate(F.col("text")).alias("short"))


@query("""SELECT doc_id, md5(concat_ws(chr(10) || chr(10), CASE WHEN trim(source) <> '' THEN 'titulo:' || chr(10) || trim(source) END, CASE WHEN trim(lang) <> '' THEN 'subtitulo:' || chr(10) || trim(lang) END,
'tags:' || chr(10) || source || ', ' || lang, CASE WHEN trim(text) <> '' THEN 'corpo:' || chr(10) || trim(text) END)) AS context_md5 FROM documents""")
def context_blocks(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.md5(tx.context(F.col("source"), F.col("lang"), F.array("source", "lang"), F.col("text"))).alias("context_md5"))


@query("""SELECT o_orderkey, coalesce(strftime(o_orderdate, '%Y'), 'sem_data') AS year, coalesce(strftime(o_orderdate, '%Y-%m'), 'sem_data') AS month FROM orders""")
def date_buckets(spark, sf):
    d = table(spark, sf, "orders").withColumn("said", F.date_format("o_orderdate", "dd/MM/yyyy"))
    at = tx.parse_date(F.col("said"))
    return d.select("o_orderkey", tx.bucket(at).alias("year"), tx.bucket(at, "month").alias("month"))


@query("""WITH u AS (SELECT page_id, url, string_split(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '/')[-1] AS s FROM pages),
v AS (SELECT page_id, url, lower(regexp_replace(regexp_replace(s, '[^a-zA-Z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS s FROM u)
SELECT page_id, CASE WHEN s = '' THEN 'noticia-' || substr(md5(url), 1, 10) ELSE s END || '-' || substr(md5(url), 1, 8) || '.md' AS name FROM v""")
def url_slug_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.markdown_name(F.col("url")).alias("name"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title, len(regexp_extract_all(html, '(?i)<a\\s[^>]*href'))::INTEGER AS n_links FROM pages""")
def html_title_links(spark, sf):
    p = table(spark, sf, "pages").select("page_id", markup.page(F.col("html")).alias("p"))
    return p.select("page_id", "p.title", "p.n_links")


# Rules

@query(f"WITH {HITS} SELECT * FROM m")
def rule_hits(spark, sf):
    return rules.match(docs_of(spark, sf), RULES).drop("hits")


@query(f"WITH {HITS} SELECT * FROM m")
def rule_hits_many(spark, sf):
    """The same in a bank of 5,000 rules, few of which match anything."""
    letters = [chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676) for i in range(5000)]
    filler = [("crime", f"none{x}", rf"\b{x}qz\w*\b\s+\bthe\w*\b", 1.4, "seed", 1, [], 100 + i) for i, x in enumerate(letters)]
    return rules.match(docs_of(spark, sf), RULES + filler).drop("hits")


@query(f"WITH {MERGED} SELECT doc_id, kind, label, hit_count, score FROM g")
def label_scores(spark, sf):
    return rules.merge(rules.match(docs_of(spark, sf), RULES)).select("doc_id", "kind", "label", "hit_count", "score")


@query(f"WITH {MERGED} SELECT doc_id, label, score, rank FROM c")
def competitive_filter(spark, sf):
    return rules.competitive(rules.merge(rules.match(docs_of(spark, sf), RULES))).select("doc_id", "label", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {CLASSIFIED} SELECT * FROM cl")
def classify(spark, sf):
    return classified(spark, sf)


@query(f"WITH {CLASSIFIED} SELECT doc_id, confidence FROM cl WHERE status = 'regex_below_threshold'")
def residuals(spark, sf):
    return classified(spark, sf).where("status = 'regex_below_threshold'").select("doc_id", "confidence")


@query(f"WITH {CLASSIFIED} SELECT coalesce(label, '-') AS label, status, count(*) AS docs FROM cl GROUP BY 1, 2")
def label_counts(spark, sf):
    return classified(spark, sf).groupBy(F.coalesce("label", F.lit("-")).alias("label"), "status").agg(F.count("*").alias("docs"))


COMPACT = f"""b AS (SELECT kind, label, pattern, min_by(weight, pos) AS weight, min_by(source, pos) AS source, sum(uses)::INTEGER AS uses, min(pos) AS pos FROM {_values(RAW)} AS r GROUP BY 1, 2, 3)"""


TELLING = f"len(list_filter(t, lambda x: NOT regexp_matches(x, '^[0-9]+$') AND NOT list_contains({_list(rules.STOP + rules.BAD)}, x)))"


@query(f"""WITH {HITS}, s AS (SELECT DISTINCT doc_id, 1 AS side FROM labels WHERE quality = 1 UNION SELECT DISTINCT doc_id, 0 FROM labels WHERE toxic = 1),
c AS (SELECT pos, count_if(side = 1) AS p, count_if(side = 0) AS n FROM m JOIN s USING (doc_id) GROUP BY 1), l AS (SELECT greatest(2, floor(0.15 * count_if(side = 0))) AS most FROM s)
SELECT r.pos, coalesce(p, 0)::BIGINT AS positive_hits, coalesce(n, 0)::BIGINT AS negative_hits, coalesce(p, 0) >= 1 AND coalesce(n, 0) <= most AS accepted FROM {_values(RULES)} AS r LEFT JOIN c USING (pos) CROSS JOIN l""")
def validate_rules(spark, sf):
    known = table(spark, sf, "labels")
    return rules.validate(docs_of(spark, sf), RULES, known.where("quality = 1"), known.where("toxic = 1")).drop("reason")


# Samples, batches, metrics

@query("SELECT strftime(o_orderdate, '%Y') AS stratum, count(*) AS n FROM orders GROUP BY 1")
def strata_counts(spark, sf):
    return table(spark, sf, "orders").groupBy(tx.bucket(F.col("o_orderdate")).alias("stratum")).agg(F.count("*").alias("n"))


SAMPLE = """
  k AS (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS stratum, md5('42:' || o_orderkey) AS h FROM orders),
  t AS (SELECT greatest(1, round_even(count(*) * 0.15, 0))::BIGINT AS target, count(*) AS total FROM k),
  s AS (SELECT stratum, count(*) AS size FROM k GROUP BY 1),
  q AS (SELECT stratum, greatest(1, round_even(size / total * target, 0))::BIGINT AS quota FROM s, t),
  c AS (SELECT stratum, least(quota, target - coalesce(sum(quota) OVER (ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - coalesce(count(*) OVER (ORDER BY stratum ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS quota FROM q, t),
  r AS (SELECT k.*, c.quota, row_number() OVER (PARTITION BY stratum ORDER BY h, o_orderkey) AS r FROM k JOIN c USING (stratum)),
  f AS (SELECT o_orderkey, row_number() OVER (ORDER BY h, o_orderkey) AS n FROM r WHERE r > quota),
  p AS (SELECT r.o_orderkey, stratum, r.r <= quota OR coalesce(f.n <= (SELECT target FROM t) - (SELECT sum(quota) FROM c), false) AS sampled FROM r LEFT JOIN f USING (o_orderkey))"""


def _sample(spark, sf):
    return sampling.stratified(table(spark, sf, "orders"), tx.bucket(F.col("o_orderdate")), "o_orderkey")


@query(f"WITH {SAMPLE} SELECT * FROM p")
def strat_sample(spark, sf):
    return _sample(spark, sf)


@query(f"WITH {SAMPLE} SELECT sampled, count(*) AS n, min(o_orderkey) AS least FROM p GROUP BY 1")
def sample_reserve_split(spark, sf):
    return _sample(spark, sf).groupBy("sampled").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"))


BATCHED = "ba AS (SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 100) + 1 AS BIGINT) AS batch_id FROM documents)"


@query(f"WITH {BATCHED} SELECT doc_id, batch_id, md5(text) AS k FROM ba JOIN documents USING (doc_id)")
def batch_assign(spark, sf):
    return sampling.batches(docs_of(spark, sf).select("doc_id", F.md5("text").alias("k")), ["doc_id"], 100)


def _batched(spark, sf):
    return classified(spark, sf).join(sampling.batches(docs_of(spark, sf).select("doc_id"), ["doc_id"], 100), "doc_id")


METRICS = f"{CLASSIFIED}, {BATCHED}, me AS (SELECT batch_id, count(*) AS docs, count_if(status <> 'regex_below_threshold')::BIGINT AS accepted, round(count_if(status <> 'regex_below_threshold') / count(*), 6) AS rate FROM cl JOIN ba USING (doc_id) GROUP BY 1)"


@query(f"WITH {METRICS} SELECT * FROM me")
def batch_metrics(spark, sf):
    return incremental.metrics(_batched(spark, sf))


@query(f"WITH {METRICS} SELECT batch_id, (sum(docs) OVER w)::BIGINT AS docs, (sum(accepted) OVER w)::BIGINT AS accepted, round(sum(accepted) OVER w / sum(docs) OVER w, 6) AS rate FROM me WINDOW w AS (ORDER BY batch_id)")
def cumulative_metrics(spark, sf):
    w = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a batch
    run = incremental.metrics(_batched(spark, sf)).select("batch_id", F.sum("docs").over(w).alias("docs"), F.sum("accepted").over(w).alias("accepted"))
    return run.withColumn("rate", F.round(F.col("accepted") / F.col("docs"), 6))


@query(f"WITH {CLASSIFIED}, {BATCHED}, rs AS (SELECT doc_id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY doc_id) AS r FROM cl JOIN ba USING (doc_id) WHERE status = 'regex_below_threshold') SELECT doc_id, batch_id, CASE WHEN r <= 10 THEN 'review' ELSE 'residual_pending' END AS state FROM rs")
def residual_budget(spark, sf):
    rows = _batched(spark, sf).where("status = 'regex_below_threshold'").withColumn("r", F.row_number().over(Window.partitionBy("batch_id").orderBy("doc_id")))
    return rows.select("doc_id", "batch_id", F.when(F.col("r") <= 10, "review").otherwise("residual_pending").alias("state"))


# Keys and index

@query("SELECT doc_id, k FROM (SELECT doc_id, md5(text) AS k, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_first(spark, sf):
    return sampling.first_by(docs_of(spark, sf).select("doc_id", F.md5("text").alias("k")), ["k"], [F.col("doc_id")])


@query("SELECT doc_id, k FROM (SELECT doc_id, md5(text) AS k, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1")
def dedupe_last(spark, sf):
    return sampling.first_by(docs_of(spark, sf).select("doc_id", F.md5("text").alias("k")), ["k"], [F.desc("doc_id")])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND md5(text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id))")
def anti_join_new(spark, sf):
    d = docs_of(spark, sf).select("doc_id", F.md5("text").alias("k"))
    known = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return d.join(known.select("doc_id"), "doc_id", "left_anti").join(known.select("k").distinct(), "k", "left_anti").select("doc_id")


@query("""WITH k AS (SELECT page_id, md5(url) AS k FROM pages), old AS (SELECT * FROM k WHERE page_id < 100), new AS (SELECT * FROM k WHERE page_id >= 100 AND k NOT IN (SELECT k FROM old))
SELECT page_id, k FROM old UNION ALL SELECT min(page_id), k FROM new GROUP BY k""")
def index_append(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.md5("url").alias("k"))
    old = p.where("page_id < 100")
    return old.unionByName(sampling.new_rows(p.where("page_id >= 100"), old, ["k"], [F.col("page_id")]).select("page_id", "k"))


# Features and clusters

TFIDF = f"""
  w AS (SELECT doc_id, {TOKENS.format('text').replace('a-z0-9', 'a-z0-9_')} AS w FROM documents),
  e AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM e GROUP BY 1, 2),
  nd AS (SELECT count(*) AS n FROM documents),
  vo AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1), nd WHERE df >= 2 AND df <= 0.75 * n ORDER BY total DESC, term LIMIT 20000),
  ra AS (SELECT doc_id, term, tf * idf AS raw FROM tf JOIN vo USING (term)),
  ti AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM ra)"""


def _tfidf(spark, sf, cluster: str | None = None):
    d = docs_of(spark, sf)
    return features.tfidf(d.withColumn("cluster", F.col(cluster)), keep=("cluster",)) if cluster else features.tfidf(d)


@query(f"WITH {TFIDF} SELECT doc_id, count(*) AS terms, round(sum(w), 4) AS total FROM ti GROUP BY 1")
def tfidf(spark, sf):
    return _tfidf(spark, sf).groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("w"), 4).alias("total"))


CENTRES = TFIDF + """,
  sz AS (SELECT {c} AS cluster, count(*) AS n FROM documents GROUP BY 1),
  ce AS (SELECT cluster, term, sum(w) / any_value(n) AS w FROM ti JOIN (SELECT doc_id, {c} AS cluster FROM documents) USING (doc_id) JOIN sz USING (cluster) GROUP BY 1, 2)"""


def centres_of(column: str) -> str:
    return CENTRES.replace("{c}", column)


@query(f"WITH {centres_of('lang')} SELECT cluster, term, rank FROM (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY round(w, 9) DESC, term)::INTEGER AS rank FROM ce WHERE length(term) >= 4) WHERE rank <= 12")
def top_terms(spark, sf):
    return features.top_terms(features.centroids(_tfidf(spark, sf, "lang"))).select("cluster", "term", "rank")


@query(f"""WITH {centres_of('source')}, p AS (SELECT doc_id AS id, cluster AS profile, round(sum(ti.w * ce.w) / (any_value(na) * any_value(nb)), 6) AS cosine FROM ti JOIN ce USING (term)
JOIN (SELECT doc_id, sqrt(sum(w * w)) AS na FROM ti GROUP BY 1) USING (doc_id) JOIN (SELECT cluster, sqrt(sum(w * w)) AS nb FROM ce GROUP BY 1) USING (cluster) GROUP BY 1, 2)
SELECT id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, profile)::INTEGER AS rank FROM p) WHERE rank <= 5""")
def cosine_topk(spark, sf):
    w = _tfidf(spark, sf, "source")
    centres = features.centroids(w)
    return features.top_k(features.cosine_pairs(w.withColumnRenamed("doc_id", "id"), centres.withColumnRenamed("cluster", "profile"))).select("id", "cosine", "rank")


@query(f"""WITH {centres_of('source')}, no AS (SELECT cluster, sqrt(sum(w * w)) AS n FROM ce GROUP BY 1)
SELECT a.cluster AS a, b.cluster AS b, round(round(sum(a.w * b.w) / (any_value(x.n) * any_value(y.n)), 6), 4) AS cosine FROM ce a JOIN ce b ON a.term = b.term AND a.cluster < b.cluster JOIN no x ON x.cluster = a.cluster JOIN no y ON y.cluster = b.cluster GROUP BY 1, 2""")
def centroid_pairs(spark, sf):
    centres = features.centroids(_tfidf(spark, sf, "source"))
    pairs = features.cosine_pairs(centres.withColumnRenamed("cluster", "id"), centres.withColumnRenamed("cluster", "profile"), "id < profile")
    return pairs.select(F.col("id").alias("a"), F.col("profile").alias("b"), F.round("cosine", 4).alias("cosine"))


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS a, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders),
s AS (SELECT a, b FROM e WHERE b IS NOT NULL UNION SELECT b, a FROM e WHERE b IS NOT NULL), r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, s.b FROM r JOIN s ON r.seen = s.a)
SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def components(spark, sf):
    """Chains of each customer's orders, an edge to the one before."""
    e = table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("b"))
    return features.consolidate(e.where("b is not null"), e.select(F.col("a").alias("node")))


DISTANCE = "round(list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - m[i]) * (e[i] - m[i]))), 9)"


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT vec_id AS k, e AS m FROM v WHERE vec_id < 4),
a AS (SELECT vec_id, e, arg_min(k, ({DISTANCE}, k)) AS k FROM v, s GROUP BY 1, 2), c AS (SELECT k, list(x ORDER BY i) AS m FROM (SELECT k, i, avg(e[i]) AS x FROM a, range(1, 1 + (SELECT max(len(e)) FROM v)) AS r(i) GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id AS id, arg_min(k, ({DISTANCE}, k))::INTEGER AS cluster FROM v, c GROUP BY 1""")
def kmeans_round(spark, sf):
    """One round of k-means from the first four vectors."""
    v = table(spark, sf, "embeddings")
    starts = [r[0] for r in v.where("vec_id < 4").orderBy("vec_id").select("embedding").collect()]
    return features.lloyd(v, starts, 1)


# Mini-batch k-means: two sets of three starts, three batches by a hash of the id, a rate a centre; the set of least inertia is kept.
FAR = "round(list_sum(list_transform(range(1, len(e) + 1), lambda i: (e[i] - m[i]) * (e[i] - m[i]))), 9)"
STARTS = [(0, 1, 2), (3, 4, 5)]


def _minibatch(n: int) -> str:
    """SQL of one mini-batch: the centres (s, k, m, had) that it moves."""
    return f"""
  a{n} AS (SELECT s, vec_id, e, arg_min(k, ({FAR}, k)) AS k FROM v JOIN c{n} ON v.b = {n} GROUP BY ALL),
  u{n} AS (SELECT s, k, i, sum(e[i]) AS x, count(*) AS n FROM a{n}, range(1, 1 + (SELECT max(len(e)) FROM v)) AS r(i) GROUP BY ALL),
  y{n} AS (SELECT s, k, list(x ORDER BY i) AS x, any_value(n) AS n FROM u{n} GROUP BY ALL),
  c{n + 1} AS (
    SELECT c.s, c.k, c.had + coalesce(n, 0) AS had, CASE WHEN n IS NULL THEN m ELSE list_transform(range(1, len(m) + 1), lambda i: m[i] + (x[i] - n * m[i]) / (c.had + n)) END AS m
    FROM c{n} AS c LEFT JOIN y{n} AS y ON y.s = c.s AND y.k = c.k)"""


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, ('0x' || substr(md5(vec_id::VARCHAR), 1, 6))::BIGINT % 3 AS b FROM embeddings),
  c0 AS (SELECT (vec_id // 3)::INTEGER AS s, (vec_id % 3)::INTEGER AS k, 0 AS had, e AS m FROM v WHERE vec_id < 6), {', '.join(map(_minibatch, range(3)))},
  f AS (SELECT s, vec_id, min({FAR}) AS far, arg_min(k, ({FAR}, k)) AS k FROM v, c3 GROUP BY ALL),
  best AS (SELECT arg_min(s, total) AS s FROM (SELECT s, sum(far) AS total FROM f GROUP BY 1))
SELECT vec_id AS id, k AS cluster FROM f WHERE s = (SELECT s FROM best)""")
def kmeans_minibatch(spark, sf):
    """Clusters after three mini-batches from stated starts."""
    v = table(spark, sf, "embeddings")
    held = {r["vec_id"]: r["embedding"] for r in v.where("vec_id < 6").select("vec_id", "embedding").collect()}
    centres, _ = reduce.minibatches(v, [[held[i] for i in own] for own in STARTS], 3)
    return reduce.assigned(v, centres)


@query("SELECT vec_id AS id, true AS nearer FROM embeddings")
def kmeans_sizes(spark, sf):
    """k-means with its usual number of clusters: each row has one, and the mean of its own cluster isn't further than that of the others' on the whole."""
    v = table(spark, sf, "embeddings")
    got = features.kmeans(v)
    sums = v.join(got, v.vec_id == got.id).select("id", "cluster", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    own = sums.groupBy("cluster", "i").agg(F.avg("x").alias("m"))
    whole = sums.groupBy("i").agg(F.avg("x").alias("all"))
    far = sums.join(own, ["cluster", "i"]).join(F.broadcast(whole), "i").agg(F.sum((F.col("x") - F.col("m")) ** 2).alias("within"), F.sum((F.col("x") - F.col("all")) ** 2).alias("around"))
    return got.join(F.broadcast(far)).select("id", (F.col("cluster").isNotNull() & (F.col("within") < 0.97 * F.col("around"))).alias("nearer"))  # one row of sums


@query("""WITH v AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), i AS (SELECT unnest(range(1, 1 + (SELECT max(len(e)) FROM v))) AS i),
g AS (SELECT a.i AS i, b.i AS j, sum(e[a.i] * e[b.i]) AS g FROM v, i AS a, i AS b GROUP BY 1, 2)
SELECT 2 AS power, round(sum(g), 3) AS total FROM g WHERE i = j UNION ALL SELECT 4, round(sum(g * g), 3) FROM g""")
def svd_components(spark, sf):
    """Sums of powers of all singular values: the trace of the Gram matrix of the columns and the sum of its squares."""
    v = table(spark, sf, "embeddings")
    s = features.singular_values(v, len(v.first()["embedding"]))
    return spark.createDataFrame([(n, round(sum(x**n for x in s), 3)) for n in (2, 4)], "power int, total double")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT a.vec_id AS id, round(list_inner_product(a.e, b.e), 4) AS product FROM v AS a, v AS b WHERE b.vec_id = 0""")
def svd_reduced(spark, sf):
    """Rows along all directions: their inner products with one of them stay as they were."""
    v = table(spark, sf, "embeddings")
    r = features.reduced(v, len(v.first()["embedding"]), unit=False)
    one = F.broadcast(r.where("id = 0").select(F.col("reduced").alias("other")))  # one row
    dot = F.aggregate(F.zip_with("reduced", "other", lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return r.join(one).select("id", F.round(dot, 4).alias("product"))


@query(f"""WITH {TFIDF.replace('LIMIT 20000', 'LIMIT 60')}, one AS (SELECT term, w FROM ti WHERE doc_id = (SELECT min(doc_id) FROM ti))
SELECT doc_id AS id, round(coalesce(sum(ti.w * one.w), 0), 5) AS product FROM ti LEFT JOIN one USING (term) GROUP BY 1""")
def svd_terms(spark, sf):
    """TF-IDF rows of the 60 commonest terms along all directions: inner products with one of them stay as they were."""
    r = materialise(reduce.reduced_terms(features.tfidf(docs_of(spark, sf), max_features=60), 60, unit=False), "reduced")
    one = F.broadcast(r.orderBy("id").limit(1).select(F.col("reduced").alias("other")))
    dot = F.aggregate(F.zip_with("reduced", "other", lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return r.join(one).select("id", F.round(dot, 5).alias("product"))  # one row beside each


FAMILIES = {"nominal": ["tion", "heit", "keit"], "verbal": ["ing", "ado", "ent"], "vocalic": ["eau", "aux", "oui"]}


@query(f"""WITH w AS (SELECT doc_id AS id, list_distinct({TOKENS.format('text')}) AS w FROM documents),
c AS (SELECT id, unnest([struct_pack(n := len(list_filter(w, lambda x: contains(x, 'tion') OR contains(x, 'heit') OR contains(x, 'keit'))), f := 'nominal'), struct_pack(n := len(list_filter(w, lambda x: contains(x, 'ing') OR contains(x, 'ado') OR contains(x, 'ent'))), f := 'verbal'), struct_pack(n := len(list_filter(w, lambda x: contains(x, 'eau') OR contains(x, 'aux') OR contains(x, 'oui'))), f := 'vocalic')]) AS s FROM w)
SELECT id, CASE WHEN max(s.n) > 0 THEN max(s).f ELSE 'indefinido' END AS family FROM c GROUP BY 1""")
def family_vote(spark, sf):
    terms = docs_of(spark, sf).select(F.col("doc_id").alias("id"), F.array_distinct(tx.tokens(F.col("text"))).alias("terms"))
    return features.family_vote(terms, FAMILIES)


@query(f"""WITH f AS (SELECT doc_id, {FOLD.format('text')} AS t FROM documents) SELECT doc_id, coalesce(nullif(concat_ws(', ', CASE WHEN regexp_matches(t, '\\bthe\\w*\\b') THEN 'en' END, CASE WHEN regexp_matches(t, '\\bund\\w*\\b') THEN 'de' END, CASE WHEN regexp_matches(t, '\\bque\\w*\\b') THEN 'es' END, CASE WHEN regexp_matches(t, '\\bles\\w*\\b') THEN 'fr' END), ''), 'tema_operacional') AS themes FROM f""")
def theme_from_terms(spark, sf):
    t = tx.fold(F.col("text"))
    held = F.concat_ws(", ", *(F.when(t.rlike(rf"\b{n}\w*\b"), name) for name, n in (("en", "the"), ("de", "und"), ("es", "que"), ("fr", "les"))))
    return docs_of(spark, sf).select("doc_id", F.coalesce(F.nullif(held, F.lit("")), F.lit("tema_operacional")).alias("themes"))


# Rare cases and the tree

SIGNS = [("sinal_tion", ["tion "]), ("sinal_heit", ["heit "])]
SIGNED = f"""si AS (SELECT conv_id, turn, t, CASE WHEN contains(t, 'tion ') THEN 'sinal_tion' WHEN contains(t, 'heit ') THEN 'sinal_heit' WHEN len(ws) > 0 THEN 'rara_' || array_to_string(ws[1:3], '_') ELSE 'rara_sem_assinatura' END AS signature FROM (SELECT conv_id, turn, {FOLD.format('text')} AS t, list_filter(regexp_extract_all({FOLD.format('text')}, '[a-z0-9]{{4,}}'), lambda y: NOT list_contains({STOPS}, y)) AS ws FROM conversations))"""


def _signed(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", taxonomy.rare_signature(tx.fold(F.col("text")), SIGNS, STOP).alias("signature"))


@query(f"WITH {SIGNED} SELECT conv_id, turn, signature FROM si")
def rare_signature(spark, sf):
    return _signed(spark, sf)


@query(f"WITH {SIGNED} SELECT conv_id, turn, signature, row_number() OVER (PARTITION BY signature ORDER BY conv_id, turn)::INTEGER AS signature_count, row_number() OVER (PARTITION BY signature ORDER BY conv_id, turn) >= 2 AND signature <> 'operacao_sem_contexto' AS promoted FROM si")
def rare_promotion(spark, sf):
    return taxonomy.promote(_signed(spark, sf), "signature", ["conv_id", "turn"])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events)
SELECT event_type AS label, count(*) AS occurrences, count(DISTINCT user_id) AS iterations, string_agg(CASE WHEN r <= 5 THEN props END, ' | ' ORDER BY r) AS examples FROM r GROUP BY 1""")
def candidate_groups(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("event_type", "label")
    return taxonomy.candidate_groups(e, "label", "user_id", "props", "event_id")


GROUPS = "gr AS (SELECT p_brand || ' ' || p_name AS label, count(*) AS occurrences, CASE WHEN length(label) % 3 = 0 THEN 'pai_' || substr(p_name, 1, 1) END AS parent, CASE WHEN length(label) % 2 = 0 THEN 'fam_' || p_brand || substr(p_name, 1, 1) END AS family FROM part GROUP BY p_brand, p_name)"


def _decided(spark, sf):
    g = table(spark, sf, "part").groupBy(F.expr("p_brand || ' ' || p_name").alias("label"), "p_brand", "p_name").agg(F.count("*").alias("occurrences"))
    g = g.withColumns({"parent": F.expr("if(length(label) % 3 = 0, 'pai_' || substr(p_name, 1, 1), null)"), "family": F.expr("if(length(label) % 2 = 0, 'fam_' || p_brand || substr(p_name, 1, 1), null)")})
    return taxonomy.tree_policy(g)


POLICY = GROUPS + """, ft AS (SELECT *, CASE WHEN family IS NULL THEN 0 ELSE sum(occurrences) OVER (PARTITION BY family) END AS total FROM gr),
  po AS (SELECT label, occurrences, CASE WHEN parent IS NOT NULL AND family IS NULL THEN 'merge_into_existing' WHEN total >= 3 THEN 'promote_to_canonical' WHEN parent IS NOT NULL THEN 'merge_into_existing' WHEN occurrences >= 3 THEN 'promote_to_canonical' WHEN family IS NOT NULL THEN 'keep_as_leaf' ELSE 'merge_into_existing' END AS decision,
  CASE WHEN parent IS NOT NULL AND family IS NULL THEN parent WHEN total >= 3 THEN family WHEN parent IS NOT NULL THEN parent WHEN occurrences >= 3 THEN label WHEN family IS NOT NULL THEN family ELSE 'noticias_raras' END AS target FROM ft)"""


@query(f"WITH {POLICY} SELECT * FROM po")
def tree_policy(spark, sf):
    return _decided(spark, sf).select("label", "occurrences", "decision", "target")


@query(f"WITH {POLICY} SELECT coalesce(target, p_brand || ' ' || p_name) AS label_final, CASE decision WHEN 'promote_to_canonical' THEN 'candidato_promovido' WHEN 'keep_as_leaf' THEN 'candidato_folha' WHEN 'merge_into_existing' THEN 'candidato_mesclado' ELSE 'classificado_regex' END AS status_final, count(*) AS n FROM part LEFT JOIN po ON p_brand || ' ' || p_name = label GROUP BY 1, 2")
def refined_labels(spark, sf):
    rows = table(spark, sf, "part").select(F.expr("p_brand || ' ' || p_name").alias("label"), F.lit("classificado_regex").alias("status"))
    return taxonomy.refined(rows, _decided(spark, sf)).groupBy("label_final", "status_final").agg(F.count("*").alias("n"))


# Learning from residuals

TERMS = ["tion", "heit", "eau", "ment", "ado", "ing", "der", "que"]
SENTENCES = "list_filter(list_transform(string_split_regex(t, '[.!?;\\n]+'), lambda x: " + SQUEEZE.format("x") + "), lambda x: x <> '')"
ANCHORED = "list_transform({0}, lambda x: '\\b' || x || '\\w*\\b')"


@query(f"""WITH w AS (SELECT p_partkey, {ANCHORED.format(TOKENS.format('p_name'))} AS w FROM part)
SELECT p_partkey, array_to_string(w, '\\W+') AS phrase, array_to_string(w, '\\s+') AS term, array_to_string(w, '.{{0,90}}') AS near FROM w""")
def pattern_build(spark, sf):
    w = tx.tokens(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", learning.phrase_pattern(w).alias("phrase"), learning.term_pattern(w).alias("term"), learning.gap_pattern(w).alias("near"))


WORDS = "regexp_extract_all({0}, '[a-z0-9_]+')"
PARTS = "list_filter(list_transform(string_split_regex(t, '{0}'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
#: The evidence of the label `einu_tation` in a text: the first sentence with a word that begins like one of its words.
WINDOW = f"w AS (SELECT doc_id, substr(coalesce(list_filter({PARTS.format('[.!?;\\n]+')}, lambda s: regexp_matches(s, '\\beinu\\w*|\\btation\\w*'))[1], t), 1, 600) AS e FROM (SELECT doc_id, {FOLD.format('text')} AS t FROM documents))"


@query(f"WITH {WINDOW} SELECT doc_id, md5(e) AS window_md5 FROM w")
def evidence_window(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.md5(learning.evidence_window(F.col("text"), F.lit("einu_tation"))).alias("window_md5"))


@query(f"""WITH {WINDOW}, x AS (SELECT doc_id, e, list_filter(['einu', 'tation'], lambda t: regexp_matches(e, '\\b' || t || '\\w*')) AS own FROM w),
q AS (SELECT doc_id, e, own, unnest(list_filter(regexp_extract_all(e, '\\b[a-z0-9]{{4,}}\\b'), lambda y: NOT regexp_matches(y, '^[0-9]+$') AND NOT list_contains({_list(rules.STOP + rules.BAD)}, y))) AS t FROM x),
n AS (SELECT doc_id, t, count(*) AS n, any_value(instr(e, t)) AS pl FROM q GROUP BY 1, 2), o AS (SELECT doc_id, list(t ORDER BY n DESC, pl, t) AS ts FROM n GROUP BY 1),
c AS (SELECT doc_id, e, (own || list_filter(coalesce(ts, []), lambda y: NOT list_contains(own, y)))[1:4] AS ts, own FROM x LEFT JOIN o USING (doc_id)),
p AS (SELECT doc_id, own, ts, u.t AS t, u.i AS i, instr(e, u.t) AS pl FROM c, LATERAL (SELECT unnest(ts) AS t, generate_subscripts(ts, 1) AS i) AS u),
j AS (SELECT doc_id, string_agg('\\b' || t || '\\w*\\b', '.{{0,240}}' ORDER BY pl, i) AS pattern FROM p GROUP BY 1)
SELECT doc_id, array_to_string(ts, ' ') AS terms, CASE WHEN len(own) >= 2 AND len(ts) >= 2 THEN pattern END AS pattern FROM c LEFT JOIN j USING (doc_id)""")
def learned_pattern(spark, sf):
    label = F.lit("einu_tation")
    def learned(evidence: Column) -> Column:
        return tx.let(learning.candidate_terms(label, evidence), lambda ts: F.struct(F.array_join(ts, " ").alias("terms"), learning.pattern_of(ts, label, evidence).alias("pattern")))

    found = F.inline(F.array(tx.let(learning.evidence_window(F.col("text"), label), learned)))  # both columns from one evaluation
    return docs_of(spark, sf).select("doc_id", found)


TELL = "list_filter(regexp_extract_all({0}, '\\b[a-z0-9]{{4,}}\\b'), lambda y: NOT list_contains({1}, y))"


@query(f"""WITH f AS (SELECT doc_id, {FOLD.format('text')} AS t FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\\r\\n|\\r|\\n'), lambda x: {TELL.format('x', STOPS)}), lambda w: len(w) BETWEEN 2 AND 8) AS ls FROM f),
ln AS (SELECT doc_id, len(ls) AS lines, u.i AS i, array_to_string(u.w, ' ') AS phrase FROM l, LATERAL (SELECT unnest(ls) AS w, generate_subscripts(ls, 1) AS i) AS u),
s AS (SELECT doc_id, u.i AS si, u.w AS w FROM (SELECT doc_id, list_transform({PARTS.format('[.!?;\\n|:]+')}, lambda x: {TELL.format('x', STOPS)}) AS ws FROM f), LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i) AS u),
g AS (SELECT doc_id, si, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM s, range(2, 6) AS a(n), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
r AS (SELECT doc_id, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY si, n DESC, i) AS r FROM g), c AS (SELECT doc_id, len(ls) AS lines FROM l),
k AS (SELECT doc_id, 0 AS part, i AS pl, phrase FROM ln UNION ALL SELECT doc_id, 1, r, phrase FROM r JOIN c USING (doc_id) WHERE r <= greatest(80 - lines, 1)),
d AS (SELECT doc_id, phrase, min((part, pl)) AS pl FROM k GROUP BY 1, 2)
SELECT doc_id, count(phrase) AS n, md5(coalesce(string_agg(phrase, ',' ORDER BY pl), '')) AS phrases_md5 FROM documents LEFT JOIN d USING (doc_id) GROUP BY 1""")
def phrase_candidates(spark, sf):
    p = docs_of(spark, sf).select("doc_id", learning.phrases(F.col("text"), tuple(STOP)).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", ",")).alias("phrases_md5"))


CLEAN = "array_to_string(list_filter(regexp_extract_all({0}, '[a-z0-9]{{3,}}'), lambda y: NOT list_contains({1}, y) AND NOT regexp_matches(y, '^[0-9]+[a-z]*$')), ' ')"


@query(f"""WITH f AS (SELECT doc_id, source, {FOLD.format('text')} AS t FROM documents),
s AS (SELECT *, list_filter(list_transform(list_filter({SENTENCES}, lambda x: contains(x, 'tion') OR contains(x, 'heit') OR contains(x, 'eau') OR contains(x, 'ado')), lambda x: {CLEAN.format('x', "['der', 'the']")}), lambda x: x <> '') AS s FROM f),
u AS (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM s) GROUP BY 1, 2), v AS (SELECT doc_id, list(x ORDER BY i)[1:4] AS told FROM u GROUP BY 1),
h AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(t, '\\bthe\\w*\\W+and\\w*\\b') THEN 'the_and' END, CASE WHEN regexp_matches(t, '\\bder\\w*\\b') THEN 'der' END, CASE WHEN contains(t, 'ment') THEN 'ment' END], lambda x: x IS NOT NULL) AS h, coalesce(told, []) AS told, t FROM f LEFT JOIN v USING (doc_id)),
p AS (SELECT *, flatten(list_transform(range(8), lambda k: h)) || flatten(list_transform(range(4), lambda k: ['une_tion'])) || told AS p FROM h)
SELECT doc_id, md5(array_to_string(p, ' ')) AS text_md5 FROM p""")
def domain_cluster_text(spark, sf):
    """Terms by phrases and stems; of the tags one is telling, one is a stop word and one says nothing."""
    tags = F.array(F.lit("Uné: tion 12"), F.lit("der"), F.lit("xyz"))
    made = learning.domain_text(F.col("text"), ["the and", "der"], tags, ANCHORS, {"ment": "ment"}, ["der", "the"])
    return docs_of(spark, sf).select("doc_id", F.md5(made).alias("text_md5"))


@query("""WITH a AS (SELECT n_regionkey, n_name AS a FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) <= 8),
p AS (SELECT n_regionkey AS label, x.a, y.a AS b FROM a AS x JOIN a AS y USING (n_regionkey) WHERE x.a <> y.a)
SELECT DISTINCT label, '\\b' || a || '\\w*\\b' || '.{0,90}' || '\\b' || b || '\\w*\\b' AS pattern FROM p""")
def pair_candidates(spark, sf):
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    return learning.pair_candidates(n, "n_regionkey", "names", "names")


ALLOWED = ["ring_gear", "Red_Bolt", "small_ring", "blue_widget"]


@query(f"""WITH l AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS label FROM part), a AS (SELECT generate_subscripts({_list(ALLOWED)}, 1) AS pos, unnest({_list(ALLOWED)}) AS canonical),
t AS (SELECT label, unnest(list_filter(string_split(replace(lower(label), ' ', '_'), '_'), lambda x: length(x) >= 4)) AS t FROM l), b AS (SELECT pos, canonical, unnest(list_filter(string_split(lower(canonical), '_'), lambda x: length(x) >= 4)) AS t FROM a),
n AS (SELECT label, min_by(canonical, pos) AS near FROM t JOIN b USING (t) GROUP BY 1)
SELECT label, coalesce(canonical, near) AS canonical FROM l LEFT JOIN a ON replace(lower(label), ' ', '_') = lower(canonical) LEFT JOIN n USING (label)""")
def canonical_labels(spark, sf):
    said = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return learning.canonical_labels(table(spark, sf, "part").select(said.alias("label")), ALLOWED)


@query("""SELECT s_nationkey AS cluster_id, string_agg(DISTINCT theme, ', ' ORDER BY theme) AS themes FROM (SELECT s_nationkey, 'tema_' || (s_suppkey % 7) AS theme FROM supplier) GROUP BY 1""")
def cluster_theme_map(spark, sf):
    themes = table(spark, sf, "supplier").groupBy(F.concat(F.lit("tema_"), F.col("s_suppkey") % 7).alias("theme")).agg(F.collect_set("s_nationkey").alias("ids"))
    return learning.theme_map(themes, "theme", "ids")


@query("""WITH e AS (SELECT event_id, event_type, props AS title, CASE WHEN user_id % 3 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS date FROM events), k AS (SELECT * FROM e WHERE event_type = 'click')
SELECT event_id FROM e WHERE event_type <> 'click' AND CASE WHEN date <> '' THEN NOT EXISTS (SELECT 1 FROM k WHERE k.title = e.title AND k.date = e.date) ELSE NOT EXISTS (SELECT 1 FROM k WHERE k.title = e.title) END""")
def missing_articles(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.col("props").alias("title"), F.when(F.col("user_id") % 3 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"))
    return learning.missing(e.where("event_type <> 'click'"), e.where("event_type = 'click'"), "title", "date").select("event_id")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def payload_unwrap(spark, sf):
    said = F.concat(F.lit('{"resultado":'), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('{"data":{"output":'), "props", F.lit("}}"))).otherwise(F.col("props")), F.lit("}"))
    inner = learning.unwrapped(said, ["resultado", "data", "output"])
    return table(spark, sf, "events").select("event_id", F.get_json_object(inner, "$.k").cast("long").alias("k"))


RESCUE = [("rescue_heit", ["heit", "keit"]), ("rescue_eau", ["eau"]), ("rescue_ado", ["ado ", "ados "])]


@query(f"""WITH f AS (SELECT role, {FOLD.format('text')} AS t FROM conversations),
l AS (SELECT role, CASE WHEN contains(t, 'heit') OR contains(t, 'keit') THEN 'rescue_heit' WHEN contains(t, 'eau') THEN 'rescue_eau' WHEN contains(t, 'ado ') OR contains(t, 'ados ') THEN 'rescue_ado' ELSE 'noticias_raras' END AS label FROM f)
SELECT label, count_if(role = 'user')::BIGINT AS user, count_if(role = 'assistant')::BIGINT AS assistant, count(*) AS total FROM l GROUP BY 1""")
def rescue_labels(spark, sf):
    said = table(spark, sf, "conversations").select("role", taxonomy.suggested(tx.fold(F.col("text")), RESCUE)["label"].alias("label"))
    return said.groupBy("label").agg(F.count_if(F.col("role") == "user").alias("user"), F.count_if(F.col("role") == "assistant").alias("assistant"), F.count("*").alias("total"))


# Reports and payloads

@query("SELECT count_if(role <> 'assistant')::BIGINT AS calls, sum(length(text))::BIGINT AS prompt_tokens, sum(turn)::BIGINT AS completion_tokens, sum(length(text) + turn)::BIGINT AS tokens, round(sum(length(text) + turn) / count_if(role <> 'assistant'), 4) AS mean FROM conversations")
def token_cost(spark, sf):
    """Metrics without tokens, so that the events' count; one role stands for failed calls."""
    c = table(spark, sf, "conversations")
    events = c.select(F.when(F.col("role") == "assistant", "error").alias("status"), F.length("text").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"), (F.length("text") + F.col("turn")).alias("total_tokens"))
    metrics = c.select(F.lit(1).alias("llm_processed"), *(F.lit(0).alias(n) for n in ("prompt_tokens", "completion_tokens", "tokens")))
    return reports.token_cost(metrics, events)


@query(f"WITH {CLASSIFIED} SELECT coalesce(label, '-') AS label, count_if(status = 'classificado_regex')::BIGINT AS accepted, count_if(status <> 'classificado_regex')::BIGINT AS residual, count(*) AS total FROM cl GROUP BY 1")
def status_pivot(spark, sf):
    p = classified(spark, sf).groupBy(F.coalesce("label", F.lit("-")).alias("label")).pivot("status", ["classificado_regex", "regex_below_threshold"]).count().na.fill(0)
    return p.select("label", F.col("classificado_regex").alias("accepted"), F.col("regex_below_threshold").alias("residual"), F.expr("classificado_regex + regex_below_threshold").alias("total"))


@query(f"""WITH {CLASSIFIED}, e AS (SELECT doc_id, substr(text, 1, 20) AS title, unnest(CASE WHEN doc_id % 3 = 0 THEN ['Id ' || source] ELSE list_distinct([lower(source), lang]) END) AS l FROM cl JOIN documents USING (doc_id) WHERE status = 'regex_below_threshold'),
kk AS (SELECT doc_id, trim(title) AS title, trim(regexp_replace({FOLD.format('l')}, '[^a-z0-9_]+', '_', 'g'), '_') AS label FROM e WHERE l IS NOT NULL), cc AS (SELECT label, count(*) AS n, min(doc_id) AS f FROM kk GROUP BY 1 ORDER BY n DESC, f, label LIMIT 10),
t AS (SELECT label, title, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS r FROM kk WHERE title <> '')
SELECT label, any_value(n) AS count, md5(string_agg(title, '|' ORDER BY r)) AS examples_md5 FROM cc LEFT JOIN (SELECT * FROM t WHERE r <= 5) AS t USING (label) GROUP BY 1""")
def incremental_report(spark, sf):
    rows = classified(spark, sf).join(docs_of(spark, sf), "doc_id").select(
        F.col("doc_id").alias("pos"), (F.col("status") != "regex_below_threshold").alias("accepted"), F.substring("text", 1, 20).alias("title"),
        F.when(F.col("doc_id") % 3 != 0, F.array_compact(F.array(F.upper("source"), F.col("lang")))).alias("labels"), F.concat(F.lit("Id "), "source").alias("identity"),
    )
    return reports.residual_labels(rows, 10).select("label", "count", F.md5(F.array_join("examples", "|")).alias("examples_md5"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, regexp_extract('answer: ' || props || ' end', '(?s)\\{.*\\}') AS payload FROM events")
def json_payload_coerce(spark, sf):
    said = F.concat(F.lit("answer: "), "props", F.lit(" end"))
    got = tx.json_object(said)
    return table(spark, sf, "events").select("event_id", F.from_json(got, "k bigint")["k"].alias("k"), got.alias("payload"))


@query("SELECT event_id, event_type IN ('click', 'view') AS flag, CASE WHEN event_type = event_type THEN event_type || '|' || user_id || '|' || event_type END AS list FROM events")
def bool_list_coerce(spark, sf):
    said = F.when(F.col("event_type").isin("click", "view"), " Sim ").otherwise("nao")
    raw = F.concat("event_type", F.lit(" ; "), "user_id", F.lit(";;"), "event_type")
    return table(spark, sf, "events").select("event_id", tx.truthy(said).alias("flag"), F.array_join(tx.list_value(raw), "|").alias("list"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_time_windows(spark, sf):
    return incremental.windows(table(spark, sf, "events"))


@query(f"WITH {CLASSIFIED} SELECT doc_id, label, confidence, status FROM cl")
def stream_foreach_batch(spark, sf):
    """The documents as a file stream, classified by micro-batch."""
    import uuid

    from lavra.runtime import shared_dir

    root = f"{shared_dir(spark)}/lavra/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(docs_of(spark, sf).schema).parquet(f"{sf}/documents.parquet*")
    incremental.stream(source, RULES, root)
    return spark.read.parquet(f"{root}/rows").select("doc_id", "label", "confidence", "status")


from lavra.plans import banks, intake, loops, more  # noqa: E402, F401  (they register further queries)
