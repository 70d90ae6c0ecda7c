"""Queries of texts, learning, themes and records, each with the SQL that states its result. Where a function's outcome depends on odd
spellings, rows of a table take turns through stated cases and the SQL states each case's outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions import table as table_functions
from lavra.functions import text as tx
from lavra.operators import density, features, learning, records, reports, rules, sampling, taxonomy, themes
from lavra.plans.queries import ANCHORS, CLEAN, FOLD, HITS, RAW, RULES, SENTENCES, SQUEEZE, STOPS, TFIDF, TOKENS, _list, _tfidf, _values, docs_of, query
from lavra.runtime import shared_dir, table
from lavra.streaming import incremental


def turns(key: str, cases: list, spark_type: str = "string") -> Column:
    """Row by row the next of the cases."""
    return F.get(F.array(*(F.lit(c).cast(spark_type) for c in cases)), (F.col(key) % len(cases)).cast("int"))


def told(key: str, outcomes: list) -> str:
    """SQL for the outcome of `turns`."""
    q = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"CASE {key} % {len(outcomes)} " + " ".join(f"WHEN {i} THEN {q(x)}" for i, x in enumerate(outcomes)) + " END"


# Texts

ODD = ["Việt Nam", "ﬁm da ﬁla", "ＡＢＣ１２", "fim…", "ẽ ø ß", "① ⑩ ½ Ⅷ", "Ação É", "ÅNGSTRÖM Å", "日本 kana", "plain Text"]


@query(f"SELECT p_partkey, {told('p_partkey', ['viet nam', 'fim da fila', 'abc12', 'fim...', 'e  ', '1 10 12 viii', 'acao e', 'angstrom a', ' kana', 'plain text'])} AS folded, {told('p_partkey', ['viet_nam', 'fim_da_fila', 'abc12', 'fim', 'e', '1_10_12_viii', 'acao_e', 'angstrom_a', 'kana', 'plain_text'])} AS slug FROM part")
def fold_letters(spark, sf):
    c = turns("p_partkey", ODD)
    return table(spark, sf, "part").select("p_partkey", tx.fold(c).alias("folded"), tx.slug(c).alias("slug"))


NAMES = [
    ("A Operação Mar Aberto da PF", "mar aberto", "Mar Aberto"), ("operacao contra o trafico", "", ""), ("Operacao PF cumpre", "", ""), ("Operação Três-Irmãos por terra", "tres-irmaos", "Tres-Irmaos"),
    ("operacao policia federal", "", ""), ("a Operacao Um Dois Tres Quatro Cinco Seis Sete", "um dois tres quatro cinco seis", "Um Dois Tres Quatro Cinco Seis"), ("nada aqui", "", ""), ("Operacao pf", "", ""),
    ("x" * 1795 + " operacao longe", "", ""), ("deflagrou operacao lei e ordem em rio", "lei e ordem", ""), ("operação de apoio; Operação Farol", "farol", "Farol"),
]


@query(f"SELECT p_partkey, {told('p_partkey', [n[1] for n in NAMES])} AS name, {told('p_partkey', [n[2] for n in NAMES])} AS direct FROM part")
def operation_names(spark, sf):
    c = turns("p_partkey", [n[0] for n in NAMES])
    return table(spark, sf, "part").select("p_partkey", tx.operation_name(c).alias("name"), tx.operation_name_direct(c, F.lit(None).cast("string"), F.lit("")).alias("direct"))


@query(f"""SELECT doc_id, md5(array_to_string({TOKENS.format('text')}, '_')) AS tokens_md5, trim(regexp_replace(lower(source), '[^a-z0-9_]+', '_', 'g'), '_') AS plain, 'crime_' || lang AS identity, lang AS label,
CASE WHEN length({SQUEEZE.format('text')}) > 240 THEN substr({SQUEEZE.format('text')}, 1, 237) || '...' ELSE {SQUEEZE.format('text')} END AS line, concat_ws(chr(10), source, lang, nullif(trim(text), '')) AS whole,
'prompt=' || doc_id || ' | completion=2 | total=' || (doc_id + 2) AS usage FROM documents""")
def text_forms(spark, sf):
    identity = tx.crime_identity(F.col("lang"))
    return docs_of(spark, sf).select(
        "doc_id", F.md5(tx.token_slug(F.col("text"))).alias("tokens_md5"), tx.plain_slug(F.col("source")).alias("plain"), identity.alias("identity"), tx.identity_label(identity).alias("label"), tx.truncate_line(F.col("text")).alias("line"),
        tx.combined(F.col("source"), F.col("lang"), F.col("text")).alias("whole"), tx.usage_line(F.col("doc_id"), F.lit(2).cast("long"), F.lit(0).cast("long")).alias("usage"),
    )


TAGS = [["Destaque", " Tráfico ", "PF"], ["operação pf", ""], ["a|b"], []]


@query(f"SELECT p_partkey, {told('p_partkey', ['trafico', '', 'a|b', ''])} AS tags, {told('p_partkey', ['Destaque;Trafico;x', 'um;dois', '', 'a'])} AS flat, {told('p_partkey', ['3', '2', '0', '1'])}::INTEGER AS n FROM part")
def tag_forms(spark, sf):
    tags = turns("p_partkey", TAGS, "array<string>")
    flat = tx.flatten_tags(turns("p_partkey", ["Destaque | Trafico, x", "um,,dois |", " , ", "a"]))
    return table(spark, sf, "part").select("p_partkey", F.array_join(tx.folded_tags(tags), ";").alias("tags"), F.array_join(flat, ";").alias("flat"), F.size(tx.delimited_set(F.array_join(flat, " | "))).alias("n"))


ANCHOR_TEST = " OR ".join(f"contains(x, '{a}')" for a in ANCHORS)


@query(f"""WITH f AS (SELECT doc_id, {FOLD.format('text')} AS t FROM documents), s AS (SELECT doc_id, t, list_filter(list_transform(list_filter({SENTENCES}, lambda x: {ANCHOR_TEST}), lambda x: {CLEAN.format('x', STOPS)}), lambda x: x <> '') AS s FROM f),
u AS (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM s) GROUP BY 1, 2), v AS (SELECT doc_id, list(x ORDER BY i)[1:12] AS told FROM u GROUP BY 1)
SELECT doc_id, coalesce(len(told), 0)::INTEGER AS n, md5(array_to_string(coalesce(told, []), '|')) AS told_md5, array_to_string(list_filter([CASE WHEN regexp_matches(t, '\\bthe\\w*\\W+and\\w*\\b') THEN 'the and' END, CASE WHEN regexp_matches(t, '\\bund\\w*\\b') THEN 'und' END, CASE WHEN contains(t, 'heit') THEN 'abstract' END, CASE WHEN contains(t, 'keit') AND NOT contains(t, 'heit') THEN 'abstract' END], lambda x: x IS NOT NULL), ',') AS terms
FROM f LEFT JOIN v USING (doc_id)""")
def domain_sentences(spark, sf):
    from lavra.plans.queries import STOP

    told_ = tx.domain_sentences(F.col("text"), ANCHORS, STOP)
    terms = tx.domain_terms(F.col("text"), ["the and", "und"], {"heit": "abstract", "keit": "abstract"})
    return docs_of(spark, sf).select("doc_id", F.size(told_).alias("n"), F.md5(F.array_join(told_, "|")).alias("told_md5"), F.array_join(terms, ",").alias("terms"))


SHINGLES = " UNION ALL ".join(f"SELECT conv_id, turn, {6 - n} AS part, unnest(regexp_extract_all(t, '\\b[a-z0-9]{{4,}}(?:\\s+[a-z0-9]{{2,}}){{{n - 1}}}\\b')) AS p, generate_subscripts(regexp_extract_all(t, '\\b[a-z0-9]{{4,}}(?:\\s+[a-z0-9]{{2,}}){{{n - 1}}}\\b'), 1) AS i FROM f" for n in (6, 5, 4, 3, 2))


@query(f"""WITH f AS (SELECT conv_id, turn, {FOLD.format('text')} AS t FROM conversations), s AS ({SHINGLES}),
k AS (SELECT *, list_filter(regexp_extract_all(p, '[a-z0-9]{{4,}}'), lambda x: NOT list_contains({_list(learning.RESIDUAL_STOP)}, x)) AS w FROM s), d AS (SELECT conv_id, turn, p, any_value(w) AS w, min((part, i)) AS pl FROM k WHERE len(w) >= 2 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pl) AS r FROM d)
SELECT conv_id, turn, count(*) AS n, md5(string_agg(p, '|' ORDER BY r)) AS phrases_md5, md5(any_value(array_to_string(list_transform(w[1:5], lambda x: '\\b' || x || '\\w*\\b'), '.{{0,80}}')) FILTER (r = 1)) AS pattern_md5 FROM r WHERE r <= 10 GROUP BY 1, 2""")
def evidence_phrases(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", learning.evidence_phrases(F.col("text")).alias("p")).where(F.size("p") > 0)
    return rows.select("conv_id", "turn", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|")).alias("phrases_md5"), F.md5(learning.residual_pattern(F.get("p", F.lit(0)))).alias("pattern_md5"))


# Rules

STORED = [
    '{"kind":"crime","label":"a","pattern":"p1","uses":3}', '{"kind":"crime","classificador":"b","pattern_do_classificador":"p2","weight":2.0,"source":"s","examples":["x"]}',
    '{"kind":"modus","classificador":"c","source":"g","examples":["y"],"patterns_do_classificador":[{"pattern_do_classificador":"p3","weight":1.1,"uses":4},{"pattern":"p4","source":"own","examples":["z"]}]}', '{"kind":"modus","label":"d","uses":7,"weight":1.2,"patterns":["p5","p6"]}',
]


SIDES = "s AS (SELECT doc_id, 1 AS side FROM documents WHERE doc_id % 10 = 1 UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id % 10 IN (2, 3))"


@query(f"""WITH {HITS}, {SIDES}, c AS (SELECT pos, count_if(side = 1) AS p, count_if(side = 0) AS n FROM m JOIN s USING (doc_id) GROUP BY 1)
SELECT r.pos, coalesce(p, 0)::BIGINT AS positive_hits, coalesce(n, 0)::BIGINT AS negative_hits, CASE WHEN coalesce(p, 0) = 0 THEN 'no_positive' WHEN n > 0 THEN 'negatives' ELSE 'ok' END AS reason FROM {_values(RULES)} AS r LEFT JOIN c USING (pos)
UNION ALL SELECT 50, 0, 0, 'invalid' UNION ALL SELECT 51, 0, 0, 'place'""")
def validate_strict(spark, sf):
    """No negative may be hit; one pattern doesn't compile, one is made of places."""
    d = docs_of(spark, sf)
    more = RULES + [("crime", "x", r"\b(the", 1.4, "s", 1, [], 50), ("crime", "x", r"\brio\w*\b\s+\bbahia\w*\b", 1.4, "s", 1, [], 51)]
    return rules.validate(d, more, d.where("doc_id % 10 = 1"), d.where("doc_id % 10 in (2, 3)"), ("rio", "bahia"), strict=True).drop("accepted")


TAGGED = HITS.replace("SELECT doc_id, pos, kind, label, weight, list", "SELECT doc_id, which, pos, kind, label, weight, list").replace("FROM f CROSS", "FROM fw CROSS").replace("SELECT doc_id, pos, kind, label, len(hits)", "SELECT doc_id, which, pos, kind, label, hits, len(hits)").replace("h AS (", f"fw AS (SELECT doc_id, 1.0::DOUBLE AS which, t FROM f UNION ALL SELECT doc_id, 0.55, trim({FOLD.format('substr(text, 1, 300)')}) FROM documents),\n  h AS (")
RECORD = TAGGED + """,
  g AS (SELECT doc_id, kind, label, sum(hit_count)::INTEGER AS n, round(sum(score * which), 3) AS score, min(struct_pack(w := -which, s := -score, p := pos)) AS f, count_if(which < 1) AS tags FROM m GROUP BY 1, 2, 3),
  k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, f) AS r, max(score) OVER (PARTITION BY doc_id) AS top FROM g WHERE kind = 'crime'),
  c AS (SELECT * FROM k WHERE r = 1 OR score >= greatest(2.0, 0.35 * top)),
  o AS (SELECT doc_id, max(top) AS top, sum(n) AS hits, string_agg(label, ',' ORDER BY r) FILTER (r <= 5) AS labels FROM c GROUP BY 1), ct AS (SELECT doc_id, sum(tags) AS ctags FROM k GROUP BY 1),
  mo AS (SELECT doc_id, count(*) AS modus, sum(tags) AS mtags, string_agg(label, ',' ORDER BY score DESC, f) AS mlabels FROM g WHERE kind = 'modus' GROUP BY 1),
  z AS (SELECT doc_id, labels, coalesce(mlabels, '') AS mlabels, CASE WHEN labels IS NULL THEN 0.0::DOUBLE ELSE least(0.95::DOUBLE, 0.61::DOUBLE + least(0.27::DOUBLE, 0.15::DOUBLE * top) + least(0.12::DOUBLE, 0.045::DOUBLE * hits) + CASE WHEN modus > 0 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN ctags > 0 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN mtags > 0 THEN 0.02::DOUBLE ELSE 0 END) END AS conf
    FROM documents LEFT JOIN o USING (doc_id) LEFT JOIN ct USING (doc_id) LEFT JOIN mo USING (doc_id))"""


@query(f"""WITH {RECORD} SELECT doc_id, round(conf, 4) AS confidence, conf >= 0.85 AS accepted, CASE WHEN conf >= 0.85 THEN 'regex' ELSE 'regex_below_threshold' END AS source, CASE WHEN conf >= 0.85 THEN 'crime_' || split_part(labels, ',', 1) END AS identity, CASE WHEN conf >= 0.85 THEN 'Por crime' END AS classification,
CASE WHEN conf >= 0.85 THEN labels END AS crimes, CASE WHEN conf >= 0.85 THEN mlabels END AS modus FROM z""")
def classification_record(spark, sf):
    """The whole record of each document; the head of a text stands for its tags."""
    d = docs_of(spark, sf).withColumn("tags", F.array(F.substring("text", 1, 300)))
    r = rules.record(d, RULES, tags_col="tags")
    return r.select("doc_id", "confidence", "accepted", "source", "identity", "classification", F.array_join("crimes", ",").alias("crimes"), F.array_join("modus", ",").alias("modus"))


@query(f"""WITH {RECORD}
SELECT doc_id, label, score, n AS hit_count, CASE WHEN (f).w < -0.9 THEN CASE WHEN tags > 0 THEN 'body,tag' ELSE 'body' END ELSE 'tag' END AS sources FROM k WHERE r = 1""")
def best_match(spark, sf):
    """The best crime of each document with its score, hits and where they are from."""
    d = docs_of(spark, sf).withColumn("tags", F.array(F.substring("text", 1, 300)))
    r = rules.record(d, RULES, tags_col="tags").select("doc_id", F.get("matched_rules", F.lit(0)).alias("m"), "candidates").where("size(candidates) > 0")
    return r.select("doc_id", "m.label", "m.score", "m.hit_count", F.array_join("m.sources", ",").alias("sources"))


REQUIRED = {"garimpo_ilegal": ["garimpo", "ilegal", "ouro"], "moeda_falsa": ["moeda", "cedulas", "falsas"]}
CHECKED = [
    ("garimpo_ilegal", r"\bgarimpo\w*\b\s+\bilegal\w*\b", True, True), ("garimpo_ilegal", r"\bgarimpo\w*\b", False, False), ("garimpo_ilegal", r"\bouro\w*\b.{0,80}\bbahia\w*\b", True, False), ("garimpo_ilegal", r"\bouro\w*\b.{0,80}\bfraude\w*\b", True, True),
    ("moeda_falsa", r"\brio\w*\b\s+\bbahia\w*\b", False, False), ("moeda_falsa", "cedulas falsas", True, True), ("moeda_falsa", r"\bmoeda\w*\b\s+\bapura\w*\b", False, False), ("sem_lista", r"\blista\w*\b\s+\boutra\w*\b", True, False),
]


PREFERRED = {"garimpo_ilegal": ["garimpo ilegal", "extracao ouro"]}
THEMES = [("garimpo_ilegal", [0, 1], ["Ouro ilegal em terra", "garimpo ilegal", "rio bahia"]), ("moeda_falsa", [2], ["moeda falsas"])]


def _w(*words: str, gap: str = r"\s+") -> str:
    return gap.join(rf"\b{w}\w*\b" for w in words)


def _pairs(anchors: list[str], terms: list[list[str]]) -> list[str]:
    return [_w(*p, gap=".{0,90}") for term in terms for a in anchors for w in term for p in ((a, w), (w, a)) if a != w]


CANDIDATES = [("garimpo_ilegal", p) for p in dict.fromkeys([_w("garimpo", "ilegal"), _w("extracao", "ouro"), _w("ouro", "ilegal", "terra"), *_pairs(["garimpo", "ilegal", "extracao", "ouro"], [["garimpo", "ilegal"], ["extracao", "ouro"], ["ouro", "ilegal", "terra"]])])]
CANDIDATES += [("moeda_falsa", p) for p in dict.fromkeys([_w("moeda", "falsas"), *_pairs(["moeda", "falsa"], [["moeda", "falsas"]])])]


#: Patterns that the documents of this query can match.
MADE = ["garimpo ilegal de ouro", "ouro ilegal terra adentro", "garimpo do ilegal", "moeda falsas aqui", "nada", "extracao de ouro", "moeda e falsas"]


@query(f"""WITH d AS (SELECT doc_id, {told('doc_id', MADE)} AS t, doc_id % 4 AS cluster, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS r, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
p0 AS (SELECT 'garimpo_ilegal' AS label, doc_id, t FROM d WHERE cluster IN (0, 1) AND r <= 20), p AS (SELECT * FROM p0 WHERE regexp_matches(t, '\\bgarimpo\\w*\\b\\s+\\bilegal\\w*\\b|\\bextracao\\w*\\b\\s+\\bouro\\w*\\b') UNION ALL SELECT 'moeda_falsa', doc_id, t FROM d WHERE cluster = 2 AND r <= 20),
q AS (SELECT label, doc_id, t FROM d, (SELECT unnest(['garimpo_ilegal', 'moeda_falsa']) AS label) AS l WHERE n <= 50 AND NOT EXISTS (SELECT 1 FROM p WHERE p.label = l.label AND p.doc_id = d.doc_id)),
c AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{x}')" for a, x in CANDIDATES)}) AS t(label, pattern)), s AS (SELECT label, count(*) AS q FROM q GROUP BY 1),
h AS (SELECT label, pattern, (SELECT count(*) FROM p WHERE p.label = c.label AND regexp_matches(p.t, c.pattern)) AS ph, (SELECT count(*) FROM q WHERE q.label = c.label AND regexp_matches(q.t, c.pattern)) AS nh FROM c)
SELECT label, pattern, ph AS positive_hits, nh AS negative_hits, ph > 0 AND nh <= greatest(2, floor(0.15 * q)) AS accepted FROM h JOIN s USING (label)""")
def initial_rules(spark, sf):
    d = docs_of(spark, sf).select("doc_id", F.col("doc_id").alias("pos"), (F.col("doc_id") % 4).alias("cluster_id"), turns("doc_id", MADE).alias("text"))
    t = spark.createDataFrame(THEMES, "label string, cluster_ids array<long>, terms array<string>")
    return learning.initial_rules(d, t, PREFERRED, REQUIRED, ("rio", "bahia"), ("em",))


REVIEWS = [
    (1, "garimpo_ilegal", "t1", "Houve garimpo bem ilegal na terra do ouro. fim", "", ""), (2, "radio_clandestina", "t2", "sem nada", "", ""), (3, "armas_municoes", "t3", "sem nada", "Fuzil e municao pesada; arma de fogo branca", ""), (4, "outro_tema", "", "sem nada", "", ""),
]
SUGGESTED = [
    (1, "garimpo_ilegal", _w("garimpo", "ilegal", "terra", "ouro", gap=".{0,240}")), (2, "radio_clandestina", _w("anatel", "radio", gap=".{0,120}")), (3, "armas_municoes", _w("arma", "fogo", "branca", gap=".{0,80}")),
    (3, "armas_municoes", _w("arma", "fogo", gap=".{0,80}")), (3, "armas_municoes", _w("municao", "pesada", gap=".{0,80}")),
]


def _reviews(spark):
    return spark.createDataFrame(REVIEWS, "doc_id int, label string, title string, text string, evidence string, summary string")


# Themes and clusters

NEEDLES = [("en", ["the and", "thou"]), ("de", ["und"]), ("es", ["que los"]), ("fr", ["les", "eau"])]


@query(f"""WITH f AS (SELECT doc_id, {FOLD.format("concat_ws(' ', source, text)")} AS t FROM documents) SELECT doc_id, nullif(concat_ws(',', CASE WHEN regexp_matches(t, '\\bthe\\w*\\s+and\\w*\\b|\\bthou\\w*\\b') THEN 'en' END, CASE WHEN regexp_matches(t, '\\bund\\w*\\b') THEN 'de' END, CASE WHEN regexp_matches(t, '\\bque\\w*\\s+los\\w*\\b') THEN 'es' END, CASE WHEN regexp_matches(t, '\\bles\\w*\\b|\\beau\\w*\\b') THEN 'fr' END), '') AS themes FROM f""")
def theme_needles(spark, sf):
    """The themes whose needles a document has; null for documents that name none."""
    named = themes.named_themes(F.array("source", "text"), NEEDLES)
    return docs_of(spark, sf).select("doc_id", F.nullif(F.array_join(named, ","), F.lit("")).alias("themes"))


SUMMARY = [(0, "garimpo | ouro ilegal", "", "t"), (1, "moeda falsa | cedulas", "garimpo ilegal", "t"), (2, "nada dito", "bahia", "t"), (-1, "garimpo", "", "t")]
RULED = [("garimpo_ilegal", ["garimpo", "ouro ilegal"]), ("moeda_falsa", ["moeda falsa", "cedulas"])]


PROFILED = TFIDF.replace("w AS (SELECT doc_id, ", "dd AS (SELECT 'doc:' || doc_id AS doc_id, text FROM documents UNION ALL SELECT 'seed:' || l, l || ' ' || l2 FROM (VALUES ('en', 'the and the and'), ('de', 'und und'), ('es', '')) AS s(l, l2)),\n  w AS (SELECT doc_id, ", 1).replace("AS w FROM documents)", "AS w FROM dd)").replace("count(*) AS n FROM documents)", "count(*) AS n FROM dd)").replace("0.75 * n", "0.9 * n").replace("LIMIT 20000", "LIMIT 30000")


@query(f"""WITH {PROFILED},
  me AS (SELECT 'doc:' || doc_id AS doc_id, lang AS label, CASE lang WHEN 'en' THEN regexp_matches({FOLD.format('text')}, '\\bthe\\w*\\s+and\\w*\\b') WHEN 'de' THEN regexp_matches({FOLD.format('text')}, '\\bund\\w*\\b') ELSE true END AS hit FROM documents WHERE lang IN ('en', 'de', 'es')),
  kn AS (SELECT label, count(*) AS n, count_if(hit) AS matched FROM me GROUP BY 1), us AS (SELECT doc_id, label FROM me JOIN kn USING (label) WHERE hit OR matched = 0),
  sz AS (SELECT label, count(*) AS n FROM us GROUP BY 1), ce AS (SELECT label, term, sum(w) / any_value(n) AS w FROM ti JOIN us USING (doc_id) JOIN sz USING (label) GROUP BY 1, 2 UNION ALL SELECT substr(doc_id, 6), term, w FROM ti WHERE doc_id LIKE 'seed:%'),
  su AS (SELECT label, term, sum(w) AS w FROM ce GROUP BY 1, 2), no AS (SELECT label, term, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS w FROM su), rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(w, 9) DESC, term) AS r FROM no)
SELECT label, any_value(CASE WHEN matched > 0 THEN matched ELSE n END)::BIGINT AS documents, any_value(matched)::BIGINT AS matched, string_agg(term, ' | ' ORDER BY r) AS top_terms FROM rk JOIN kn USING (label) WHERE r <= 12 GROUP BY 1""")
def theme_profiles(spark, sf):
    d = docs_of(spark, sf)
    number = {"en": 0, "de": 1, "es": 2}
    at = F.element_at(F.create_map(*(F.lit(x) for pair in number.items() for x in pair)), F.col("lang"))
    accepted = spark.createDataFrame([(k, [v]) for k, v in number.items()], "label string, cluster_ids array<int>")
    return themes.theme_profiles(d.select("doc_id", "text", at.alias("cluster_id")), accepted, {"en": ["the and"], "de": ["und"], "es": []})[1]


@query(f"""WITH RECURSIVE {TFIDF}, cl AS (SELECT doc_id, (ascii(right(source, 1)) % 8)::INTEGER - 1 AS cluster FROM documents), re AS (SELECT * FROM cl WHERE cluster <> -1), sz AS (SELECT cluster, count(*) AS n FROM re GROUP BY 1),
ce AS (SELECT cluster, term, sum(w) / any_value(n) AS w FROM ti JOIN re USING (doc_id) JOIN sz USING (cluster) GROUP BY 1, 2), no AS (SELECT cluster, sqrt(sum(w * w)) AS n FROM ce GROUP BY 1),
pa AS (SELECT a.cluster AS a, b.cluster AS b, round(sum(a.w * b.w) / (any_value(x.n) * any_value(y.n)), 6) AS cosine FROM ce a JOIN ce b ON a.term = b.term AND a.cluster < b.cluster JOIN no x ON x.cluster = a.cluster JOIN no y ON y.cluster = b.cluster GROUP BY 1, 2),
ed AS (SELECT a, b FROM pa WHERE cosine >= 0.45 AND a % 2 = b % 2 AND a <> 6 AND b <> 6), bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), co AS (SELECT cluster AS node, cluster AS seen FROM sz UNION SELECT co.node, bo.b FROM co JOIN bo ON co.seen = bo.a),
gr AS (SELECT node, min(seen) AS g FROM co GROUP BY 1) SELECT cl.cluster AS raw_cluster_id, coalesce(g, cl.cluster) AS cluster_id, count(*) AS docs FROM cl LEFT JOIN gr ON node = cl.cluster GROUP BY 1, 2""")
def merge_clusters(spark, sf):
    """Clusters by the last letter of the source; those of one parity are of one family, one has none."""
    d = docs_of(spark, sf)
    members = d.select("doc_id", (F.ascii(F.expr("right(source, 1)")) % 8 - 1).alias("cluster"))
    family = members.select("cluster").distinct().withColumn("family", F.when(F.col("cluster") == 6, "indefinido").otherwise(F.concat(F.lit("f"), F.col("cluster") % 2)))
    return features.merge_clusters(members, _tfidf(spark, sf), family)[0].groupBy("raw_cluster_id", "cluster_id").agg(F.count("*").alias("docs"))


def _clustered(spark, sf) -> DataFrame:
    d = docs_of(spark, sf)
    cluster = (F.length("source") + F.col("doc_id")) % 6 - 1
    return d.select(F.col("doc_id").alias("pos"), cluster.cast("int").alias("cluster_id"), (cluster + 10).cast("int").alias("raw_cluster_id"), F.concat(F.lit("t"), "doc_id").alias("titulo"), F.concat_ws(" | ", "source", "lang", F.lit(" ")).alias("tags"), F.col("lang").alias("domain_terms"))


CLUSTERED = "cr AS (SELECT doc_id AS pos, ((length(source) + doc_id) % 6 - 1)::INTEGER AS cluster_id, 't' || doc_id AS titulo, source, lang FROM documents)"


@query(f"""WITH {CLUSTERED}, s AS (SELECT cluster_id, count(*) AS size FROM cr GROUP BY 1), t AS (SELECT cluster_id, string_agg(titulo, ' | ' ORDER BY pos) AS sample_titles FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pos) AS r FROM cr) WHERE r <= 8 GROUP BY 1),
g AS (SELECT cluster_id, tag, min((pos, i)) AS pl FROM (SELECT cluster_id, pos, 1 AS i, source AS tag FROM cr UNION ALL SELECT cluster_id, pos, 2, lang FROM cr) WHERE tag IS NOT NULL GROUP BY 1, 2), gt AS (SELECT cluster_id, string_agg(tag, ' | ' ORDER BY pl) AS sample_tags FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pl) AS r FROM g) WHERE r <= 20 GROUP BY 1),
l AS (SELECT cluster_id, string_agg(lang, ' | ' ORDER BY pl) AS domain_terms FROM (SELECT cluster_id, lang, min(pos) AS pl FROM cr WHERE lang IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT cluster_id, (cluster_id + 10)::VARCHAR AS raw_cluster_ids, size, 'a b | c' AS top_terms, sample_titles, coalesce(sample_tags, '') AS sample_tags, coalesce(domain_terms, '') AS domain_terms, cluster_id = -1 AS is_noise FROM s JOIN t USING (cluster_id) LEFT JOIN gt USING (cluster_id) LEFT JOIN l USING (cluster_id)""")
def cluster_summary(spark, sf):
    rows = _clustered(spark, sf)
    terms = rows.select("cluster_id").distinct().withColumn("x", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.lit("a_b").alias("term")), F.struct(F.lit(2).alias("rank"), F.lit("c").alias("term"))))).select("cluster_id", "x.*")
    return features.summarize_clusters(rows, terms)


@query(f"WITH {CLUSTERED} SELECT count(DISTINCT cluster_id) FILTER (cluster_id <> -1) AS clusters, count(DISTINCT cluster_id) AS raw_clusters, round(avg((cluster_id = -1)::INTEGER), 6) AS noise_ratio FROM cr")
def cluster_counts(spark, sf):
    return features.cluster_counts(_clustered(spark, sf))


@query(f"""WITH {CLUSTERED}, v AS (SELECT cluster_id, count(*) AS size, CASE WHEN count_if(lang = 'en') > 0 OR count_if(lang = 'de') > 0 THEN CASE WHEN count_if(lang = 'en') > 0 AND count_if(lang = 'de') > 0 THEN 'Germanic' WHEN count_if(lang = 'en') > 0 THEN 'english' ELSE 'Germanic' END ELSE 'indefinido' END AS theme FROM cr GROUP BY 1)
SELECT theme, count(*) AS leaves, sum(size)::BIGINT AS size, string_agg('cluster ' || cluster_id || ' (' || size || ')', ', ' ORDER BY cluster_id) AS labels FROM v GROUP BY 1""")
def theme_tree(spark, sf):
    """Clusters under the family of their terms (languages), ties to the later name, and the sizes of the themes."""
    rows = _clustered(spark, sf)
    summary = features.summarize_clusters(rows, rows.select("cluster_id", F.lit(1).alias("rank"), F.lit("").alias("term")).limit(0))
    tree = features.tree_rows(summary, {"english": ["en"], "german": ["de"]}, {"german": "Germanic"})
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster_id", "leaf_label"))), lambda x: x["leaf_label"]), ", ")
    return tree.groupBy("theme").agg(F.count("*").alias("leaves"), F.sum("size").alias("size"), shown.alias("labels"))


# The tree

ACTIVE, FAMILIES, ABSORBING = ["bolt_steel", "ring_small"], {"coloured": ["blue", "red", "green"], "sized": ["small", "large", "big"]}, {"bolt_steel": ["gear", "anchor"]}
LABELLED = "lb AS (SELECT replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '_bolt' ELSE '' END AS label, count(*) AS occurrences FROM part GROUP BY 1)"


def _share(words: list[str]) -> str:
    return f"len(list_filter(w, lambda x: list_contains({_list(words)}, x)))"


PLACED = f"""{LABELLED}, tk AS (SELECT *, list_distinct(string_split(label, '_')) AS w FROM lb), ov AS (SELECT *, {_share(['bolt', 'steel'])} AS o1, {_share(['ring', 'small'])} AS o2, {_share(['gear', 'anchor'])} AS a1, {_share(FAMILIES['coloured'])} AS f1, {_share(FAMILIES['sized'])} AS f2 FROM tk),
pl AS (SELECT label, occurrences, CASE WHEN a1 > greatest(o1, o2) THEN 'bolt_steel' WHEN greatest(o1, o2) = 0 THEN NULL WHEN o1 >= o2 THEN 'bolt_steel' ELSE 'ring_small' END AS parent, CASE WHEN greatest(f1, f2) = 0 THEN NULL WHEN f1 >= f2 THEN 'coloured' ELSE 'sized' END AS family FROM ov)"""


def _labelled(spark, sf) -> DataFrame:
    label = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_partkey") % 3 == 0, "_bolt").otherwise(""))
    return table(spark, sf, "part").groupBy(label.alias("label")).agg(F.count("*").alias("occurrences"))


@query(f"WITH {PLACED} SELECT * FROM pl")
def candidate_places(spark, sf):
    return taxonomy.placed(_labelled(spark, sf), ACTIVE, FAMILIES, ABSORBING)


@query(f"""WITH {PLACED}, ft AS (SELECT family, sum(occurrences) AS total FROM pl GROUP BY 1), de AS (SELECT label, CASE WHEN parent IS NOT NULL AND pl.family IS NULL THEN 'm' WHEN pl.family IS NOT NULL AND total >= 3 THEN 'p' WHEN parent IS NOT NULL THEN 'm' WHEN occurrences >= 3 THEN 'p' WHEN pl.family IS NOT NULL THEN 'l' ELSE 'm' END AS d,
CASE WHEN pl.family IS NOT NULL AND total >= 3 THEN pl.family WHEN parent IS NULL AND occurrences >= 3 THEN label END AS t FROM pl LEFT JOIN ft ON ft.family = pl.family)
SELECT count(*) AS decisions, count_if(d = 'm')::BIGINT AS merged, count_if(d = 'p')::BIGINT AS promoted, count_if(d = 'l')::BIGINT AS leaves, count(DISTINCT CASE WHEN d = 'p' THEN t END) AS promoted_themes, 0::BIGINT AS remapped_classifiers, 0::BIGINT AS removed_classifiers, 0::BIGINT AS merged_classifiers FROM de""")
def tree_run(spark, sf):
    return taxonomy.organise(_labelled(spark, sf), rules.bank(spark, RULES), ACTIVE, FAMILIES, ABSORBING)[2]


@query("""WITH e AS (SELECT event_type AS label, event_id AS pos, i, trim(x) AS term FROM (SELECT event_type, event_id, unnest(string_split_regex('alpha beta ' || (user_id % 7) || '; short, ' || props, '[.,;]')) AS x, generate_subscripts(string_split_regex('alpha beta ' || (user_id % 7) || '; short, ' || props, '[.,;]'), 1) AS i FROM events)),
f AS (SELECT label, term, min((pos, i)) AS pl FROM e WHERE length(term) BETWEEN 8 AND 90 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pl) AS r FROM f) SELECT label, string_agg(term, '|' ORDER BY r) AS terms FROM r WHERE r <= 12 GROUP BY 1""")
def candidate_evidence(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("label"), F.col("event_id").alias("pos"), F.concat(F.lit("alpha  beta "), F.col("user_id") % 7, F.lit("; short")).alias("a"), "props")
    return taxonomy.evidence_terms(e, "label", ["a", "props"], "pos").select("label", F.array_join("terms", "|").alias("terms"))


@query(f"SELECT DISTINCT event_type AS label, coalesce((SELECT string_agg(pattern, '|' ORDER BY pos) FROM {_values(RULES)} AS r WHERE r.label = CASE event_type WHEN 'click' THEN 'alpha' END), '') AS patterns FROM events")
def candidate_rules(spark, sf):
    bank = rules.bank(spark, RULES).withColumn("label", F.when(F.col("label") == "alpha", "click").otherwise(F.col("label")))
    return taxonomy.rules_of(table(spark, sf, "events"), bank, "event_type").select("label", F.array_join("patterns", "|").alias("patterns"))


@query(f"""WITH f AS (SELECT conv_id, turn, {FOLD.format('text')} AS t FROM conversations), s AS (SELECT conv_id, turn, CASE WHEN contains(t, 'tion ') THEN 'sinal_tion' WHEN contains(t, 'heit') THEN 'operacao_sem_contexto' ELSE 'rara_sem_assinatura' END AS signature FROM f)
SELECT signature, count(*) AS observations, count(*) >= 2 AND signature <> 'operacao_sem_contexto' AS promoted FROM s GROUP BY 1""")
def rare_summary(spark, sf):
    t = tx.fold(F.col("text"))
    seen = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(taxonomy.first_rule(t, [("sinal_tion", ["tion "]), ("operacao_sem_contexto", ["heit"])])["label"], F.lit("rara_sem_assinatura")).alias("signature"))
    return taxonomy.rare_summary(taxonomy.promote(seen, "signature", ["conv_id", "turn"]), "signature")


@query(f"""WITH f AS (SELECT conv_id, turn, role, {FOLD.format('text')} AS t FROM conversations), s AS (SELECT *, role = 'user' AS q, contains(t, 'heit') OR contains(t, 'keit') AS h FROM f)
SELECT conv_id, turn, CASE WHEN NOT q THEN role WHEN h THEN 'rescue_heit' ELSE 'noticias_raras' END AS label_after, CASE WHEN NOT q THEN 'kept' WHEN h THEN 'quarentena_reclassificada_pos_arvore' ELSE 'noticia_rara' END AS status_after,
CASE WHEN NOT q THEN '' WHEN h THEN concat_ws('; ', CASE WHEN contains(t, 'heit') THEN 'heit' END, CASE WHEN contains(t, 'keit') THEN 'keit' END) ELSE 'sem evidencia suficiente para macrotema; noticia rara' END AS reason, CASE WHEN q AND NOT h THEN CASE WHEN contains(t, 'tion') THEN 'sinal' ELSE 'rara' END END AS signature FROM s""")
def quarantine_review(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.when(F.col("role") == "user", "quarentena").otherwise(F.col("role")).alias("label"), F.lit("kept").alias("status"))
    out = taxonomy.review_quarantine(rows, "label", "status", tx.fold(F.col("text")), [("rescue_heit", ["heit", "keit"])], [("sinal", ["tion"])])
    return out.select("conv_id", "turn", "label_after", "status_after", "reason", F.substring_index("signature", "_", 1).alias("signature"))


# Reviews and records

@query(f"SELECT doc_id, CASE WHEN regexp_matches({FOLD.format('text')}, '\\b(und|der)\\w*\\b') THEN 'german' WHEN regexp_matches({FOLD.format('text')}, '\\bles\\w*\\b') THEN 'french' END AS new_theme FROM documents")
def new_themes(spark, sf):
    found = themes.new_themes(docs_of(spark, sf), F.col("text"), ["english"], [("english", r"\bthe\b"), ("german", r"\b(und|der)\w*\b"), ("french", r"\bles\w*\b")])
    return found.select("doc_id", "new_theme")


ANSWERS = [
    ('```json\n{"Resultado": {"Identidade": "Tráfico", "tipo": "crime", "Crimes": ["Moeda Falsa", "x"], "modus": "a; b", "resumo": " um  dois ", "setor": "Saúde", "precisa_reprocessamento": "sim"}}\n```', "crime_moeda_falsa", "Por crime", "moeda_falsa", "a,b", "um dois", "saude", True, None),
    ('x {"data": {"output": {"identity": "crime_moeda_falsa", "classificacao": "Por crime", "crimes": []}}} y', "crime_moeda_falsa", "Por crime", "moeda_falsa", "", "", "nao_identificado", False, None),
    ("", None, None, None, None, None, None, None, "empty"), ("no object  here", None, None, None, None, None, None, None, "no JSON: no object here"), ('{"identidade": "", "categoria": "outra"}', None, None, None, None, None, None, None, 'schema (identidade_canonica): {"identidade": "", "categoria": "outra"}'),
    ('{"identidade": "crime_nada", "categoria": "por crime", "crimes": "nada"}', "noticia_sem_crime_especifico", "Outras", "", "", "", "nao_identificado", False, None), ('{"identidade": "a", "categoria": "bad"}', None, None, None, None, None, None, None, 'schema (classificacao): {"identidade": "a", "categoria": "bad"}'),
    ('{"identidade_canonica": "operacao_x", "classification": "operacao nomeada", "crimes": "[\\"garimpo_ilegal\\", \\"garimpo ilegal\\"]", "modus_operandi": null, "evidence": "e", "atores": "um|dois"}', "crime_garimpo_ilegal", "Com operacao nomeada", "garimpo_ilegal", "", "", "nao_identificado", False, None),
]


@query("SELECT event_id, " + ", ".join(f"{told('event_id', [a[i] for a in ANSWERS])} AS {n}" for i, n in enumerate(("identity", "class", "crimes", "modus", "summary", "sector", "again", "error"), 1)) + " FROM events")
def answers_parsed(spark, sf):
    rows = table(spark, sf, "events").select("event_id", turns("event_id", [a[0] for a in ANSWERS]).alias("answer"))
    i = records.parsed(rows, "answer", ["moeda_falsa", "garimpo_ilegal"], ["saude"]).select("event_id", "error", "inference.*")
    return i.select("event_id", F.col("identidade_canonica").alias("identity"), F.col("classificacao").alias("class"), F.array_join("crimes_mais_presentes", ",").alias("crimes"), F.array_join("modus_operandi", ",").alias("modus"), F.col("resumo_curto").alias("summary"), F.col("setor_afetado").alias("sector"), F.col("precisa_reprocessamento").alias("again"), "error")


def _recorded(spark, sf) -> DataFrame:
    """Nested records: reviews of documents stand for inferences."""
    from lavra.sources import markup

    d = docs_of(spark, sf)
    made = F.concat(F.lit("# T "), F.col("doc_id"), F.lit("\nsub\nPublicado em 31/12/2023 10h30\nTags: "), F.col("source"), F.lit(", x, x\n**Rio** corpo"))
    rows = d.select(F.concat(F.col("doc_id"), F.lit(".md")).alias("arquivo"), markup.metadata(made).alias("metadata"), F.concat(F.lit("Tema "), F.col("lang")).alias("label"), F.lit("s").alias("summary"), F.lit("e").alias("evidence"), F.when(F.col("doc_id") % 2 == 0, "classificar").otherwise("quarentena").alias("decision"))
    none = F.lit(None)
    rows = records.from_review(rows).withColumns({"source": F.lit("regex_x"), "confidence": F.lit(0.86543), "regex_source": F.lit("regex"), "operation_name": F.lit(""), "matched_rules": F.array().cast("array<string>"), "learned": none.cast("array<struct<kind: string, label: string, pattern: string>>")})
    return records.nested(rows)


@query("SELECT doc_id || '.md' AS arquivo, 'T ' || doc_id AS titulo, 'sub' AS subtitulo, '31/12/2023' AS data_publicacao, source || ',x' AS tags, 'Rio' AS dateline, 'crime_tema_' || lang AS identidade_canonica, 'Por crime' AS classificacao, 'tema_' || lang AS crimes, doc_id % 2 = 1 AS precisa_reprocessamento, 'regex_x' AS fonte_classificacao, 0.865::DOUBLE AS confianca_regex, 20 AS n FROM documents")
def record_rows(spark, sf):
    flat = records.flattened(_recorded(spark, sf))
    return flat.select("arquivo", "titulo", "subtitulo", "data_publicacao", F.array_join("tags", ",").alias("tags"), "dateline", "identidade_canonica", "classificacao", F.array_join("crimes_mais_presentes", ",").alias("crimes"), "precisa_reprocessamento", "fonte_classificacao", "confianca_regex", F.lit(len(flat.columns)).alias("n"))


@query("SELECT doc_id || '.md' AS arquivo, concat_ws(chr(10), 'Titulo: T ' || doc_id, 'Data: 31/12/2023', 'Dateline: Rio', 'Tags diretas: [' || source || ', x]', 'Operacao direta: Sem nome de operacao explicito', 'Identidade canonica: crime_tema_' || lang, 'Classificacao: Por crime', 'Crimes mais presentes: tema_' || lang, 'Modus operandi: sem_modus_explicitado', 'Resumo curto: s') AS block FROM documents")
def readable_blocks(spark, sf):
    return _recorded(spark, sf).select("arquivo", records.readable(F.col("metadata_extraido"), F.col("inferencia_llm")).alias("block"))


@query(f"SELECT doc_id, CASE lang WHEN 'en' THEN NOT regexp_matches({FOLD.format('text')}, 'the') ELSE doc_id % 5 = 0 END AS rescue FROM documents")
def needs_rescue(spark, sf):
    """English cases need evidence; every fifth other one is of another class."""
    label = F.col("lang")
    inference = F.struct(F.concat(F.lit("crime_"), label).alias("identidade_canonica"), F.when((F.col("lang") != "en") & (F.col("doc_id") % 5 == 0), "Outras").otherwise("Por crime").alias("classificacao"), F.array(label).alias("crimes_mais_presentes"))
    return docs_of(spark, sf).select("doc_id", records.needs_rescue(inference, F.col("text"), {"en": ["the"]}).alias("rescue"))


@query(f"WITH {RECORD.replace('substr(text, 1, 300)', chr(39) + chr(39))} SELECT doc_id, 'crime_' || split_part(labels, ',', 1) AS identity, round(conf, 4) AS confidence FROM z WHERE conf >= 0.88")
def rescued_records(spark, sf):
    return records.rescued(docs_of(spark, sf), RULES, threshold=0.88).select("doc_id", "identity", "confidence")


# Reports

def _measured(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations")
    decision = F.when(F.col("turn") % 4 == 0, None).otherwise(turns("conv_id", ["classificar", "novo_tema_candidato", "quarentena", "error", "classificar"]))
    return c.select((F.col("conv_id") % 6 + 1).alias("batch_id"), F.when(F.col("turn") % 4 == 0, "classificado_regex").otherwise("regex_below_threshold").alias("status"), decision.alias("decision"), F.when(F.col("conv_id") % 5 == 0, "noticias_raras").otherwise("a").alias("label"), (F.col("conv_id") % 3).alias("learned"), F.length("text").alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), (F.length("text") + 1).alias("total_tokens"))


MEASURED = f"""ro AS (SELECT conv_id % 6 + 1 AS batch_id, turn % 4 = 0 AS taken, CASE WHEN turn % 4 <> 0 THEN {told('conv_id', ['classificar', 'novo_tema_candidato', 'quarentena', 'error', 'classificar'])} END AS d, conv_id % 5 = 0 AS rare, conv_id % 3 AS l, length(text) AS p FROM conversations),
me AS (SELECT batch_id, count(*) AS docs, count_if(taken)::BIGINT AS regex_accepted, count_if(NOT taken)::BIGINT AS regex_residual, count_if(d <> 'error')::BIGINT AS llm_processed, count(d) AS attempted, count_if(d = 'classificar')::BIGINT AS classified, count_if(d = 'quarentena')::BIGINT AS quarantined, count_if(d = 'novo_tema_candidato')::BIGINT AS new_theme_candidates, count_if(d = 'classificar' AND rare)::BIGINT AS rare_news, count_if(d = 'error')::BIGINT AS errors, sum(l)::BIGINT AS learned_rules, sum(p)::BIGINT AS prompt_tokens, count(*) AS completion_tokens, sum(p + 1)::BIGINT AS tokens FROM ro GROUP BY 1),
mr AS (SELECT *, CASE WHEN llm_processed > 0 THEN round(tokens / llm_processed, 4) ELSE 0 END AS avg_tokens, round(regex_accepted / docs, 6) AS rate FROM me)"""


@query(f"WITH {MEASURED} SELECT *, (100 + sum(docs) OVER w)::BIGINT AS cumulative_docs, (50 + sum(regex_accepted) OVER w)::BIGINT AS cumulative_regex_accepted, (sum(llm_processed) OVER w)::BIGINT AS cumulative_llm_processed, round((50 + sum(regex_accepted) OVER w) / (100 + sum(docs) OVER w), 6) AS cumulative_rate FROM mr WINDOW w AS (ORDER BY batch_id)")
def batch_report(spark, sf):
    """All measures of each batch, going on from an earlier run."""
    return reports.cumulative(reports.batch_measures(_measured(spark, sf)), {"docs": 100, "regex_accepted": 50})


@query(f"WITH {MEASURED} SELECT count(*) AS batches, sum(docs)::BIGINT AS docs, sum(regex_accepted)::BIGINT AS regex_accepted, sum(regex_residual)::BIGINT AS regex_residual, sum(llm_processed)::BIGINT AS llm_processed, sum(learned_rules)::BIGINT AS learned_rules, sum(new_theme_candidates)::BIGINT AS new_theme_candidates, sum(rare_news)::BIGINT AS rare_news, 0::BIGINT AS quarantined, sum(errors)::BIGINT AS errors, round(sum(regex_accepted) / sum(docs), 6) AS rate FROM me")
def report_totals(spark, sf):
    """Totals over the batches; one measure is missing."""
    return reports.totals(reports.batch_measures(_measured(spark, sf)).drop("quarantined"))


@query("SELECT (SELECT 'keyed:' || count(*) FROM documents WHERE doc_id % 7 = 0) AS sample, (SELECT 'rest:' || count(*) FROM documents WHERE doc_id % 7 <> 0) AS reserve, (SELECT sum(doc_id)::BIGINT FROM documents WHERE doc_id % 7 = 0) AS checksum")
def split_docs(spark, sf):
    d = docs_of(spark, sf)
    a, b = sampling.split(d, d.where("doc_id % 7 = 0").select("doc_id"), "doc_id")
    one = a.agg(F.count("*").alias("n"), F.sum("doc_id").alias("checksum")).join(b.agg(F.count("*").alias("m")))  # two tables of one row
    return one.select(F.concat(F.lit("keyed:"), "n").alias("sample"), F.concat(F.lit("rest:"), "m").alias("reserve"), "checksum")


@query(f"""WITH e AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT count(*) AS rows, true AS separated FROM e""")
def density_clusters(spark, sf):
    """Density clusters of all vectors, each drawn to one of four far places with a little of its own: every place is one cluster."""
    place = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(F.col("vec_id") % 4 == i - 1, 50.0).otherwise(0.0))
    own = F.transform(F.slice("embedding", 1, 4), lambda x: F.round(x, 4) * 0.01)
    v = table(spark, sf, "embeddings").select("vec_id", F.zip_with(place, own, lambda a, b: a + b).alias("embedding"))
    got = density.clusters(v, 8, 4)
    by = got.where("cluster >= 0").groupBy("cluster").agg(F.count_distinct(F.col("id") % 4).alias("places"))
    return got.agg(F.count("*").alias("rows")).join(by.agg((F.max("places") == 1).alias("separated")))


@query(f"WITH {CLUSTERED} SELECT cluster_id, count(*) AS size, (SELECT string_agg(titulo, ',' ORDER BY pos) FROM (SELECT * FROM cr WHERE cluster_id = 2 ORDER BY pos LIMIT 5)) AS samples FROM cr WHERE cluster_id = 2 GROUP BY 1")
def cluster_sample(spark, sf):
    rows = _clustered(spark, sf)
    return features.cluster_view(rows.groupBy("cluster_id").agg(F.count("*").alias("size")), rows, 2, 5).withColumn("samples", F.array_join("samples", ","))


@query("""SELECT event_type AS label, count(*) AS occurrences, count(DISTINCT event_id % 3) AS iterations FROM events GROUP BY 1""")
def candidates_over_batches(spark, sf):
    """Candidates of three batches, one of which is run twice."""
    import uuid

    root = f"{shared_dir(spark)}/lavra/candidates-{uuid.uuid4().hex}"
    e = table(spark, sf, "events")
    for n in (0, 1, 2, 1):
        incremental.append_candidates(e.where(f"event_id % 3 = {n}").select("event_type", "event_id", "props"), root, n)
    got = taxonomy.candidate_groups(spark.read.parquet(root).withColumnRenamed("event_type", "label"), "label", "batch_id", "props", "event_id")
    return got.select("label", "occurrences", "iterations")


# By turns: a sure rule; a label with evidence in the text; no label; an answer that can't be read; a case that rules rescue at 0.85; one below it.
CASES = [
    ("the one het and", "", "regex", "crime_alpha", "Por crime", ""),
    ("grupo beta vende metal raro", '{"identity": "beta", "tipo": "crime", "crimes": ["beta"]}', "llm", "crime_beta", "Por crime",
        r"crime beta \bgrupo\w*\b.{0,240}\bbeta\w*\b.{0,240}\bvende\w*\b.{0,240}\bmetal\w*\b"),
    ("nada", '{"identity": "x y", "tipo": "outras"}', "llm", "x_y", "Outras", ""),
    ("nada", "?", None, None, None, None),
    ("the one", '{"identity": "x y", "tipo": "outras"}', "regex_rescue", "crime_alpha", "Por crime", ""),
    ("las cio", '{"identity": "x y", "tipo": "outras"}', "llm", "x_y", "Outras", ""),
]


@query(f"""SELECT doc_id || '.md' AS arquivo, {told('doc_id', [c[2] for c in CASES])} AS source, {told('doc_id', [c[3] for c in CASES])} AS identity,
{told('doc_id', [c[4] for c in CASES])} AS class, {told('doc_id', [c[5] for c in CASES])} AS learned, 'T' AS titulo FROM documents WHERE doc_id % 6 <> 3 AND doc_id % 5 <> 0""")
def enriched_records(spark, sf):
    """One pass at 0.9: rules take one case, a provider answers the others, rules rescue one; some documents are done already."""
    d = docs_of(spark, sf)
    docs = d.select(F.concat("doc_id", F.lit(".md")).alias("arquivo"), F.concat(F.lit("# T\nsub\nTags: a\n**Rio** "), turns("doc_id", [c[0] for c in CASES])).alias("text"))

    def provider(rows):
        n = F.substring_index("arquivo", ".", 1).cast("long")
        return rows.withColumn("n", n).select("arquivo", turns("n", [c[1] for c in CASES]).alias("answer"))

    done = d.where("doc_id % 5 = 0").select(F.concat("doc_id", F.lit(".md")).alias("arquivo"))
    got = records.enriched(docs, RULES, provider, ["alpha", "beta"], [], {}, threshold=0.9, done=done)
    said = F.array_join(F.transform("regex_rules_aprendidas", lambda r: F.concat_ws(" ", r["kind"], r["label"], r["pattern"])), ";")
    return got.select("arquivo", F.col("fonte_classificacao").alias("source"), F.col("inferencia_llm.identidade_canonica").alias("identity"), F.col("inferencia_llm.classificacao").alias("class"), said.alias("learned"), "metadata_extraido.titulo")


@query(f"""WITH f AS (SELECT conv_id, turn, {FOLD.format('text')} AS t FROM conversations), s AS ({SHINGLES}),
k AS (SELECT *, list_filter(regexp_extract_all(p, '[a-z0-9]{{4,}}'), lambda x: NOT list_contains({_list(learning.RESIDUAL_STOP)}, x)) AS w FROM s), d AS (SELECT conv_id, turn, p, any_value(w) AS w, min((part, i)) AS pl FROM k WHERE len(w) >= 2 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pl) AS r FROM d) SELECT conv_id, turn, r::INTEGER AS n, p AS phrase, array_to_string(list_transform(w[1:5], lambda x: '\\b' || x || '\\w*\\b'), '.{{0,80}}') AS pattern FROM r WHERE r <= 3""")
def residual_rules_sql(spark, sf):
    """The table function in SQL."""
    table_functions.register(spark)
    table(spark, sf, "conversations").createOrReplaceTempView("lavra_conversations")
    return spark.sql("SELECT conv_id, turn, r.n, r.phrase, r.pattern FROM lavra_conversations, LATERAL residual_rules(text) AS r")
