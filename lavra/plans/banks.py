"""Queries of rule banks and of learning whose rules, reviews and themes are made from the words of the tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions import text as tx
from lavra.plans.queries import FOLD, STOP, TOKENS, _list, docs_of, query  # isort: skip  (first: it imports the others)
from lavra.operators import learning, rules, taxonomy, themes
from lavra.plans.loops import CHECKED, SETUP
from lavra.plans.more import NEEDLES
from lavra.runtime import materialise, shared_dir, table
from lavra.sources import files

# A rule of each document's first two words, as they come in: some have one word, some don't compile, kinds and weights vary.
RAW = f"""
  words AS (SELECT doc_id, lang, source, {TOKENS.format('text')} AS w FROM documents),
  raw AS (
    SELECT CASE WHEN doc_id % 7 = 0 THEN 'other' WHEN doc_id % 7 < 3 THEN 'modus' ELSE 'crime' END AS kind, 'tema_' || lang || '_' || doc_id % 4 AS label,
      CASE doc_id % 11 WHEN 3 THEN '\\b' || w[1] || '\\w*\\b' WHEN 5 THEN '\\b' || w[1] || '\\w*\\b\\s+(\\b' || w[2] || '\\w*\\b' ELSE '\\b' || w[1] || '\\w*\\b\\s+\\b' || w[2] || '\\w*\\b' END AS pattern,
      (CASE doc_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.2 ELSE 1.4 END)::DOUBLE AS weight, CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE source END AS source,
      (doc_id % 5)::INTEGER AS uses, [lang, ' ' || source || ' ', '', lang] AS examples, doc_id::INTEGER AS pos, doc_id
    FROM words WHERE len(w) >= 2)"""


def _anchored(*words: Column) -> list[Column]:
    return [F.concat(F.lit(r"\b"), w, F.lit(r"\w*\b")) for w in words]


def raw_bank(spark, sf) -> DataFrame:
    n = F.col("doc_id")
    words = F.filter(F.array(F.slice(tx.tokens(F.col("text")), 1, 2)), lambda w: F.size(w) >= 2)
    d = docs_of(spark, sf).select("doc_id", "lang", "source", F.explode(words).alias("w"))  # a filter on `w` would cut each text twice
    a, b = _anchored(F.get("w", F.lit(0)), F.get("w", F.lit(1)))
    bank = d.select(
        F.when(n % 7 == 0, "other").when(n % 7 < 3, "modus").otherwise("crime").alias("kind"), F.concat(F.lit("tema_"), "lang", F.lit("_"), n % 4).alias("label"),
        F.when(n % 11 == 3, a).when(n % 11 == 5, F.concat(a, F.lit(r"\s+("), b)).otherwise(F.concat(a, F.lit(r"\s+"), b)).alias("pattern"),
        F.when(n % 4 == 0, 0.0).when(n % 4 == 1, 1.0).when(n % 4 == 2, 1.2).otherwise(1.4).alias("weight"), F.when(n % 6 == 0, " ").otherwise(F.col("source")).alias("source"),
        (n % 5).cast("int").alias("uses"), F.array(F.col("lang"), F.concat(F.lit(" "), "source", F.lit(" ")), F.lit(""), F.col("lang")).alias("examples"), n.cast("int").alias("pos"),
    )
    return materialise(bank, "bank")  # queries take it more than once


COMPACT = f"""{RAW},
  b AS (SELECT kind, label, pattern, min_by(weight, pos) AS weight, min_by(source, pos) AS source, sum(uses)::INTEGER AS uses, min(pos) AS pos FROM raw GROUP BY 1, 2, 3)"""
ANCHORS = "regexp_extract_all(lower(pattern), '\\\\b([a-z0-9]{3,})', 1)"
GATED = f"""{RAW},
  g AS (
    SELECT * REPLACE (CASE WHEN weight = 0 THEN 1.4::DOUBLE ELSE weight END AS weight, CASE WHEN trim(source) = '' THEN 'llm_feedback' ELSE source END AS source, greatest(uses, 1) AS uses, [lang, origin] AS examples)
    FROM (SELECT raw.*, words.lang, words.source AS origin, {ANCHORS} AS t FROM raw JOIN words USING (doc_id))
    WHERE kind IN ('crime', 'modus') AND doc_id % 11 <> 5 AND len(list_filter(t, lambda x: regexp_matches(x, '^[0-9]+$') OR list_contains({_list(rules.BAD)}, x))) = 0
      AND len(list_filter(t, lambda x: NOT regexp_matches(x, '^[0-9]+$') AND NOT list_contains({_list(rules.STOP + rules.BAD)}, x))) >= 2)"""


@query(f"WITH {COMPACT} SELECT * FROM b")
def rule_compact(spark, sf):
    return rules.compact(raw_bank(spark, sf)).drop("examples")


@query(f"WITH {COMPACT} SELECT kind, label AS classifier, CASE WHEN count(DISTINCT source) > 1 THEN 'mixed' ELSE min(source) END AS source, sum(uses)::INTEGER AS uses, count(*) AS n FROM b GROUP BY 1, 2")
def rule_group(spark, sf):
    g = rules.group(rules.compact(raw_bank(spark, sf)))
    return g.select("kind", "classifier", "source", "uses", F.size("patterns").cast("long").alias("n"))


@query(f"WITH {COMPACT} SELECT kind, label, pattern, weight, source, uses, row_number() OVER (PARTITION BY kind ORDER BY label, pattern)::INTEGER AS pos FROM b")
def rule_flatten(spark, sf):
    return rules.flatten(rules.group(rules.compact(raw_bank(spark, sf)))).drop("examples")


@query(f"WITH {GATED} SELECT pos, kind, label, pattern, weight, source, uses, array_to_string(examples, ',') AS examples FROM g")
def rule_gate(spark, sf):
    """Labels come in as they are written by hand."""
    raw = raw_bank(spark, sf).withColumn("label", F.initcap(F.replace("label", F.lit("_"), F.lit(" "))))
    return rules.gate(raw).select("pos", "kind", "label", "pattern", "weight", "source", "uses", F.array_join("examples", ",").alias("examples"))


NAMES = [("tema_en_1", "tema_en_0"), ("tema_fr_2", "noticias_raras"), ("tema_de_3", ""), ("tema_es_0", "tema_en_0")]
NAMED = "names AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in NAMES) + ") AS n(label, new_label))"


@query(f"""WITH {COMPACT}, {NAMED}, t AS (SELECT b.* REPLACE (coalesce(new_label, label) AS label) FROM b LEFT JOIN names USING (label))
SELECT first_kind AS kind, label, pattern, sum(uses)::INTEGER AS uses FROM (SELECT *, first_value(kind) OVER (PARTITION BY label ORDER BY pos) AS first_kind FROM t WHERE label NOT IN ('', 'noticias_raras')) GROUP BY 1, 2, 3""")
def rule_remap(spark, sf):
    names = spark.createDataFrame(NAMES, "label string, new_label string")
    return rules.remap(rules.compact(raw_bank(spark, sf)), names).select("kind", "label", "pattern", "uses")


@query(f"""WITH {COMPACT}, {NAMED}, o AS (SELECT DISTINCT kind, label, coalesce(new_label, label) AS target FROM b LEFT JOIN names USING (label))
SELECT count_if(target NOT IN ('', 'noticias_raras') AND target <> label)::BIGINT AS remapped, count_if(target IN ('', 'noticias_raras'))::BIGINT AS removed,
  (count_if(target NOT IN ('', 'noticias_raras')) - count(DISTINCT CASE WHEN target NOT IN ('', 'noticias_raras') THEN target END))::BIGINT AS merged FROM o""")
def remap_counts(spark, sf):
    names = spark.createDataFrame(NAMES, "label string, new_label string")
    return rules.remap_counts(rules.compact(raw_bank(spark, sf)), names)


@query(f"""WITH {COMPACT}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pos) AS r FROM b), h AS (SELECT label, count(*) AS n_rules, string_agg(pattern, ' || ' ORDER BY r) FILTER (r <= 8) AS sample FROM r GROUP BY 1),
  a AS (SELECT DISTINCT 'tema_' || lang || '_' || doc_id % 6 AS label FROM documents WHERE doc_id % 6 <> 3 UNION SELECT 'noticias_raras')
SELECT label, coalesce(n_rules, 0)::BIGINT AS n_rules, coalesce(sample, '') AS sample FROM a LEFT JOIN h USING (label)""")
def active_themes(spark, sf):
    """Themes of the documents' languages, some without a rule; a third of the rules' labels is no accepted theme."""
    n = F.col("doc_id") % 6
    named = docs_of(spark, sf).select(F.concat(F.lit("tema_"), "lang", F.lit("_"), n).alias("label"), F.when(n == 3, "quarantine").otherwise("accept").alias("decision"))
    return learning.active_themes(named.distinct(), rules.compact(raw_bank(spark, sf)))


@query(f"""WITH {COMPACT.replace('FROM raw GROUP BY', 'FROM raw WHERE doc_id % 2 = 0 GROUP BY')}, f AS (SELECT kind, label, pattern, count(*) AS n FROM raw WHERE doc_id % 2 = 1 GROUP BY ALL)
SELECT kind, label, pattern, coalesce(b.weight, 1.4) AS weight, coalesce(b.source, 'agent') AS source, (coalesce(b.uses, 0) + coalesce(f.n, 0))::INTEGER AS uses FROM b FULL JOIN f USING (kind, label, pattern)""")
def rule_upsert(spark, sf):
    """A bank of half of the documents takes in what the other half brings."""
    raw = raw_bank(spark, sf)
    found = raw.where("pos % 2 = 1").select("kind", "label", "pattern", F.lit("agent").alias("source"), F.get("examples", F.lit(0)).alias("title"))
    return rules.upsert(rules.compact(raw.where("pos % 2 = 0")), found).drop("examples", "pos")


@query(f"""WITH {GATED}, s AS (SELECT (SELECT count(*) FROM raw) AS before_patterns, (SELECT count(DISTINCT (kind, label)) FROM raw) AS before,
  (SELECT count(DISTINCT (kind, label, pattern)) FROM g) AS after_patterns, (SELECT count(DISTINCT (kind, label)) FROM g) AS after)
SELECT *, before - after AS removed, before_patterns - after_patterns AS removed_patterns FROM s""")
def bank_clean_stats(spark, sf):
    return rules.cleaned(raw_bank(spark, sf))[1]


@query(f"WITH {COMPACT} SELECT k AS asked, b.kind, label, pattern FROM b, (SELECT unnest(['crime', 'modus']) AS k) WHERE label IN (SELECT label FROM b AS u WHERE u.kind = k)")
def rules_of_kind(spark, sf):
    """A label under both kinds brings all its rules to both."""
    bank = rules.compact(raw_bank(spark, sf))
    both = [rules.of_kind(bank, k).select(F.lit(k).alias("asked"), "kind", "label", "pattern") for k in ("crime", "modus")]
    return both[0].unionByName(both[1])


@query(f"WITH {RAW} SELECT kind, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM raw WHERE label <> 'tema_en_0' GROUP BY 1")
def known_labels(spark, sf):
    return rules.known_labels(raw_bank(spark, sf), ("tema_en_0",)).select("kind", F.array_join("labels", ",").alias("labels"))


@query(f"""WITH {RAW}, v AS (
    SELECT 0 AS v, kind, label, pattern, sum(uses)::INTEGER AS uses FROM raw WHERE doc_id % 2 = 0 GROUP BY ALL
    UNION ALL SELECT 1, kind, label, pattern, sum(uses)::INTEGER FROM raw GROUP BY ALL)
SELECT * FROM v""")
def bank_versions(spark, sf):
    """The bank that a run began with, and the next version, which takes in rules that it has and new ones."""
    root, raw = f"{shared_dir(spark)}/lavra/bank-{uuid.uuid4().hex}", raw_bank(spark, sf)
    files.publish_bank(rules.compact(raw.where("pos % 2 = 0")), root, 0)
    files.append_bank(raw.where("pos % 2 = 1"), root)
    both = [files.load_bank(spark, root, v).select(F.lit(v).alias("v"), "kind", "label", "pattern", "uses") for v in files.versions(spark, root)]
    return both[0].unionByName(both[1])


@query(f"""WITH {RAW}, e AS (
    SELECT kind, label, pattern, CASE doc_id % 4 WHEN 0 THEN 1.4::DOUBLE WHEN 1 THEN weight ELSE 1.1::DOUBLE END AS weight, CASE WHEN doc_id % 4 IN (0, 3) THEN 'llm_feedback' ELSE source END AS source,
      CASE doc_id % 4 WHEN 0 THEN uses WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 7 END AS uses, CASE WHEN doc_id % 4 = 1 THEN source ELSE '' END AS examples, doc_id FROM raw
    UNION ALL SELECT kind, label, 'p' || doc_id, 1.1, 'llm_feedback', 7, '', doc_id FROM raw WHERE doc_id % 4 = 3)
SELECT kind, label, pattern, weight, source, uses, examples FROM e""")
def stored_bank(spark, sf):
    """A bank's records in all their spellings: flat ones under either name, grouped ones, and bare patterns."""
    raw, n = raw_bank(spark, sf), F.col("pos") % 4
    said = lambda *c: F.to_json(F.struct(*c))
    kind, label, pattern, uses = (F.col(c) for c in ("kind", "label", "pattern", "uses"))
    nested = F.array(F.struct(pattern.alias("pattern_do_classificador")))
    lines = raw.select(
        F.when(n == 0, said(kind, label, pattern, uses)).when(n == 1, said(kind, label.alias("classificador"), pattern.alias("pattern_do_classificador"), "weight", "source", F.array("source").alias("examples")))
        .when(n == 2, said(kind, label.alias("classificador"), F.col("source"), F.lit(1.1).alias("weight"), nested.alias("patterns_do_classificador")))
        .otherwise(said(kind, label, F.lit(7).alias("uses"), F.lit(1.1).alias("weight"), F.array(pattern, F.concat(F.lit("p"), "pos")).alias("patterns"))).alias("s")
    )
    read = lines.select(F.from_json("s", rules.STORED).alias("r")).select("r.*")
    return rules.from_stored(read).withColumn("examples", F.array_join("examples", ",")).drop("pos")


@query(f"""WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents),
  e AS (SELECT doc_id, unnest([struct_pack(i := 0, s := (n % 7)::DOUBLE, p := 0, l := 'a'), struct_pack(i := 1, s := (n % 11)::DOUBLE, p := 0, l := 'crime_organizado'), struct_pack(i := 2, s := (n % 5)::DOUBLE, p := 2, l := 'c'), struct_pack(i := 3, s := (n % 3)::DOUBLE, p := 0, l := 'd')]) AS x FROM t)
SELECT doc_id, string_agg(x.l, ',' ORDER BY (x.l = 'crime_organizado')::INTEGER, -x.s, -x.p, x.i) AS labels FROM e GROUP BY 1""")
def prioritized_crimes(spark, sf):
    """By score, then priority; generic ones last. Scores are made from the texts' lengths."""
    n = F.length(F.coalesce("text", F.lit("")))
    scored = F.array(*(F.struct((n % by).cast("double").alias("score"), F.lit(label).alias("label")) for by, label in ((7, "a"), (11, "crime_organizado"), (5, "c"), (3, "d"))))
    return docs_of(spark, sf).withColumn("m", scored).select("doc_id", F.array_join(rules.prioritized(F.col("m"), priority={"c": 2}), ",").alias("labels"))


PLACES, NOISY, DOMAIN, STOPPED = ("the", "der", "les"), ("one", "una"), ("her", "ein", "des"), ("and", "und")


@query(f"""WITH {RAW}, a AS (SELECT doc_id, list_filter({ANCHORS}, lambda x: NOT list_contains({_list(STOPPED)}, x)) AS t, [words.w[1], words.w[3]] AS must FROM raw JOIN words USING (doc_id) WHERE len(words.w) >= 3),
  m AS (SELECT *, list_distinct(list_intersect(t, list_filter(must, lambda x: length(x) >= 4 AND x NOT IN ('crime', 'crimes')))) AS hit, len(list_filter(t, lambda x: NOT list_contains({_list(PLACES)}, x))) = 0 AS placed,
    len(list_distinct(list_intersect(t, {_list((*PLACES, *NOISY, *STOPPED))}))) AS noise FROM a),
  c AS (SELECT *, len(t) >= 2 AND NOT placed AND len(hit) > 0 AS candidate, len(list_distinct(list_concat(hit, list_intersect(t, {_list(DOMAIN)})))) AS field FROM m)
SELECT doc_id, candidate, candidate AND (len(hit) >= 2 OR field >= 2 AND noise < field) AS anchored FROM c""")
def rule_checks(spark, sf):
    """The rules of the documents' first words, under labels of their first and third word."""
    d = docs_of(spark, sf).select("doc_id", tx.tokens(F.col("text")).alias("w")).where("size(w) >= 3").join(raw_bank(spark, sf).select(F.col("pos").cast("long").alias("doc_id"), "pattern"), "doc_id")
    label = F.concat_ws("_", F.get("w", F.lit(0)), F.get("w", F.lit(2)))
    words = dict(required={}, places=PLACES, stop=STOPPED)
    return d.select("doc_id", learning.domain_candidate(label, F.col("pattern"), **words).alias("candidate"), learning.has_anchor(label, F.col("pattern"), domain=DOMAIN, noisy=NOISY, **words).alias("anchored"))


# Themes of four words of each document, and the patterns that they give.
LONG = f"""l AS (SELECT doc_id, regexp_extract_all({FOLD.format('text')}, '\\b[a-z]{{5,}}\\b') AS w FROM documents),
  th AS (SELECT w[1] || '_' || w[2] AS label, min_by(w, doc_id) AS w FROM l WHERE len(w) >= 4 AND w[1] <> w[2] GROUP BY 1)"""


def _p(a: str, b: str, gap: str) -> str:
    return f"'\\b' || {a} || '\\w*\\b{gap}\\b' || {b} || '\\w*\\b'"


PAIRS = [(0, 2), (2, 0), (1, 0), (0, 1), (1, 2), (2, 1), (0, 1), (1, 0), (0, 3), (3, 0), (1, 3), (3, 1)]
CANDIDATES = ", ".join(
    [f"struct_pack(i := {i}, p := CASE WHEN w[{a}] <> w[{b}] OR true THEN {_p(f'w[{a}]', f'w[{b}]', chr(92) + 's+')} END)" for i, (a, b) in enumerate([(1, 3), (2, 4)])]
    + [f"struct_pack(i := {i}, p := CASE WHEN w[{a + 1}] <> w[{b + 1}] THEN {_p(f'w[{a + 1}]', f'w[{b + 1}]', '.{0,90}')} END)" for i, (a, b) in enumerate(PAIRS, 2)]
)


def _themes(spark, sf) -> DataFrame:
    """(label, terms): a theme of the first two long words of each document, with two terms of two words."""
    w = F.regexp_extract_all(tx.fold(F.col("text")), F.lit(r"\b[a-z]{5,}\b"), F.lit(0))
    d = docs_of(spark, sf).select("doc_id", w.alias("w")).where("size(w) >= 4 and w[0] <> w[1]")
    named = d.groupBy(F.concat_ws("_", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("label")).agg(F.min_by("w", "doc_id").alias("w"))
    term = lambda a, b: F.concat_ws(" ", F.get("w", F.lit(a)), F.get("w", F.lit(b)))
    return named.select("label", F.array(term(0, 2), term(1, 3)).alias("terms"))


@query(f"""WITH {LONG}, e AS (SELECT label, unnest([{CANDIDATES}]) AS x FROM th), u AS (SELECT label, x.p AS pattern, min(x.i) AS i FROM e WHERE x.p IS NOT NULL GROUP BY 1, 2)
SELECT label, pattern, pos FROM (SELECT label, pattern, row_number() OVER (PARTITION BY label ORDER BY i)::INTEGER AS pos FROM u) WHERE pos <= 8""")
def rule_candidates(spark, sf):
    return learning.rule_candidates(_themes(spark, sf), {}, {}, target=2)


@query(f"WITH {LONG} SELECT label, unnest([{_p('w[1]', 'w[3]', chr(92) + 's+')}, {_p('w[2]', 'w[4]', chr(92) + 's+')}]) AS pattern FROM th WHERE w[1] || ' ' || w[3] <> w[2] || ' ' || w[4]")
def fallback_rules(spark, sf):
    return learning.fallback_rules(_themes(spark, sf).where("terms[0] <> terms[1]"), {}, {})


RUNS = " UNION ALL ".join(
    f"SELECT conv_id, turn, {n} AS size, unnest(range(len(r))) AS i, unnest(r) AS p FROM (SELECT conv_id, turn, regexp_extract_all(t, '\\b[a-z0-9]{{4,}}(?:\\s+[a-z0-9]{{2,}}){{{n - 1}}}\\b') AS r FROM f)" for n in (6, 5, 4, 3, 2)
)


@query(f"""WITH f AS (SELECT conv_id, turn, {FOLD.format('text')} AS t FROM conversations), s AS ({RUNS}),
  k AS (SELECT *, list_filter(regexp_extract_all(p, '[a-z0-9]{{4,}}'), lambda x: NOT list_contains({_list(learning.RESIDUAL_STOP)}, x)) AS w FROM s WHERE NOT starts_with(p, 'policia federal') AND NOT starts_with(p, 'operacao')),
  d AS (SELECT conv_id, turn, p, any_value(w) AS w, min((-size, i)) AS pl FROM k WHERE len(w) >= 2 GROUP BY 1, 2, 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pl) AS r FROM d),
  q AS (SELECT conv_id, turn, array_to_string(list_transform(w[1:5], lambda x: '\\b' || x || '\\w*\\b'), '.{{0,80}}') AS pattern, min(r) AS r FROM r WHERE r <= 10 GROUP BY 1, 2, 3)
SELECT conv_id, turn, pattern FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY r) AS n FROM q) WHERE n <= 3""")
def learning_suggestions(spark, sf):
    """What the turns of conversations bring as evidence, under a label that no text holds."""
    c = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), F.lit("qxzvtema").alias("label"), F.lit("").alias("title"), F.lit("nada").alias("text"), F.col("text").alias("evidence"), F.lit("").alias("summary"))
    return learning.suggestions(c).select("doc_id.conv_id", "doc_id.turn", "pattern")


@query(f"SELECT doc_id, label, pattern, accepted, reason FROM ({CHECKED.replace('d.b AS batch_id, d.doc_id, r.label, r.pattern, reason', 'd.b AS batch_id, d.doc_id, d.label, d.pattern, reason')}) WHERE batch_id = 0")
def learned_rules(spark, sf):
    """What reviews of a batch of documents bring, checked on their own texts and on the batch's first forty."""
    d = docs_of(spark, sf).where("doc_id % 3 = 0")
    reviews = d.select("doc_id", F.concat(F.lit("qxzvtema_"), "lang").alias("label"), F.lit("T").alias("title"), "text", F.lit("").alias("evidence"), F.lit("").alias("summary"))
    got = learning.learned_rules(reviews, d.orderBy("doc_id").limit(40).select("doc_id", "text"), SETUP["required"], fixed=SETUP["fixed"])
    return got.select("doc_id", "label", "pattern", "accepted", "reason")


# Themes and reviews

SAID = " ".join(
    f"CASE WHEN regexp_matches(s, '{'|'.join(chr(92) + 'b' + (chr(92) + 'w*' + chr(92) + 's+').join(n.split()) + chr(92) + 'w*' for n in needles)}') THEN '{name}' END," for name, needles in NEEDLES
).rstrip(",")


@query(f"""WITH t AS (SELECT doc_id, list_slice({TOKENS.format('text')}, 1, 6) AS w FROM documents), j AS (SELECT *, array_to_string(w, ' ') AS s FROM t),
  n AS (SELECT *, concat_ws(',', {SAID}) AS named, list_filter(w, lambda x: length(x) >= 5 AND x <> 'geral')[1] AS first FROM j)
SELECT doc_id, CASE WHEN named <> '' THEN named ELSE coalesce(first, 'tema_operacional') END AS themes FROM n""")
def theme_fallback_slug(spark, sf):
    """The themes that the first words of a document name; else its first long word."""
    terms = F.slice(tx.tokens(F.col("text")), 1, 6)
    return docs_of(spark, sf).select("doc_id", F.array_join(themes.canonical_themes(terms, NEEDLES, ("geral",)), ",").alias("themes"))


ALLOWED = f"""al AS (SELECT w AS allowed, row_number() OVER (ORDER BY n DESC, w) AS pos FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all({FOLD.format('text')}, '\\b[a-z]{{4,}}\\b')) AS w FROM conversations) GROUP BY 1) ORDER BY pos LIMIT 8)"""


@query(f"""WITH {ALLOWED}, c AS (SELECT conv_id, turn, regexp_extract_all({FOLD.format('text')}, '\\b[a-z]{{4,}}\\b') AS w, CASE (conv_id + turn) % 4 WHEN 0 THEN 'novo_tema_candidato' WHEN 1 THEN 'quarentena' ELSE 'classificar' END AS decision FROM conversations),
  l AS (SELECT *, CASE WHEN turn % 5 = 4 THEN '' ELSE array_to_string(w[1:3], '_') END AS said FROM c),
  m AS (SELECT conv_id, turn, arg_min(allowed, pos) AS fits FROM l JOIN al ON list_contains(string_split(said, '_'), allowed) GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN decision = 'novo_tema_candidato' AND said <> '' THEN decision ELSE 'classificar' END AS decision,
  CASE WHEN decision = 'novo_tema_candidato' AND said <> '' THEN said WHEN decision = 'classificar' AND fits IS NOT NULL THEN fits ELSE 'noticias_raras' END AS label,
  CASE WHEN decision = 'novo_tema_candidato' AND said <> '' OR decision = 'classificar' AND fits IS NOT NULL THEN 'r'
    ELSE 'Classificado como noticia rara: ' || CASE decision WHEN 'novo_tema_candidato' THEN 'Novo tema candidato sem label valida.' WHEN 'classificar' THEN 'Label retornada fora da lista canonica permitida.' ELSE 'r' END END AS rationale
FROM l LEFT JOIN m USING (conv_id, turn)""")
def reviewed_residuals(spark, sf):
    """Reviews whose labels are the first words of each turn; the commonest words of the table are allowed labels."""
    word = F.regexp_extract_all(tx.fold(F.col("text")), F.lit(r"\b[a-z]{4,}\b"), F.lit(0))
    c = table(spark, sf, "conversations").select("conv_id", "turn", word.alias("w"))
    top = c.select(F.explode("w").alias("t")).groupBy("t").count().orderBy(F.desc("count"), "t").limit(8)
    allowed = [r["t"] for r in top.collect()]  # eight words
    n = (F.col("conv_id") + F.col("turn")) % 4
    said = F.when(F.col("turn") % 5 == 4, "").otherwise(F.array_join(F.slice("w", 1, 3), "_"))
    rows = c.select("conv_id", "turn", F.when(n == 0, "novo_tema_candidato").when(n == 1, "quarentena").otherwise("classificar").alias("decision"), said.alias("label"), F.lit("r").alias("rationale"))
    return themes.reviewed(rows, allowed).select("conv_id", "turn", "decision", "label", "rationale")


@query(f"""WITH t AS (SELECT doc_id, lang, list_filter({TOKENS.format('text')}, lambda x: length(x) >= 5) AS w FROM documents),
  c AS (SELECT (doc_id % 60)::INTEGER - 1 AS cluster_id, min_by(lang, doc_id) AS lang, min_by(w, doc_id) AS w FROM t WHERE len(w) > 0 GROUP BY 1),
  n AS (SELECT *, CASE WHEN lang = 'de' THEN 'alemao' WHEN list_contains({_list(STOP)}, w[1]) AND w[2] IS NOT NULL THEN w[2] WHEN list_contains({_list(STOP)}, w[1]) THEN 'tema_operacional' ELSE w[1] END AS label FROM c WHERE cluster_id <> -1)
SELECT label, string_agg(cluster_id::VARCHAR, ',' ORDER BY cluster_id) AS cluster_ids, CASE WHEN label = 'alemao' THEN 'dexyzw' ELSE '' END AS evidence_terms, 0.62::DOUBLE AS confidence, 'accept' AS decision FROM n WHERE label <> 'tema_operacional' GROUP BY 1""")
def fallback_themes(spark, sf):
    """Themes of clusters whose provider fails: by the needle of one language, else by the first long word."""
    w = F.filter(tx.tokens(F.col("text")), lambda x: F.length(x) >= 5)
    d = docs_of(spark, sf).select("doc_id", "lang", w.alias("w")).where("size(w) > 0")
    c = d.groupBy(((F.col("doc_id") % 60).cast("int") - 1).alias("cluster_id")).agg(F.min_by("lang", "doc_id").alias("lang"), F.min_by("w", "doc_id").alias("w"))
    summary = c.select("cluster_id", F.array_join(F.slice("w", 1, 2), " | ").alias("top_terms"), F.concat("lang", F.lit("xyzw")).alias("sample_tags"), F.lit("t").alias("sample_titles"))
    t = themes.themes(summary, [("alemao", ["dexyzw"])], provider=lambda df: df.select(F.raise_error(F.lit("no provider")).alias("label")), generic=(*STOP, "enxyzw", "frxyzw", "esxyzw"))
    return t.select("label", F.array_join("cluster_ids", ",").alias("cluster_ids"), F.array_join("evidence_terms", "|").alias("evidence_terms"), "confidence", "decision")


@query(f"""WITH {RAW}, g AS (SELECT 'novo_' || lang || '_' || length(coalesce(text, '')) % 6 AS label, count(*) AS occurrences FROM documents GROUP BY 1),
  own AS (SELECT label, CASE WHEN label LIKE 'novo_en%' THEN 'tema_en' WHEN label LIKE 'novo_de%' THEN 'tema_de' END AS parent, CASE WHEN label LIKE '%_fr_%' THEN 'familia_fr' END AS family FROM g),
  p AS (SELECT *, sum(CASE WHEN family IS NOT NULL THEN occurrences END) OVER (PARTITION BY family) AS total FROM g JOIN own USING (label)),
  d AS (SELECT label, CASE WHEN parent IS NOT NULL THEN parent WHEN family IS NOT NULL AND total >= 3 THEN family WHEN occurrences >= 3 THEN label WHEN family IS NOT NULL THEN family ELSE 'noticias_raras' END AS target FROM p),
  b AS (SELECT DISTINCT kind, 'novo_' || lang || '_' || raw.doc_id % 6 AS label FROM raw JOIN documents USING (doc_id)),
  o AS (SELECT b.*, coalesce(d.target, b.label) AS target FROM b LEFT JOIN d USING (label))
SELECT count_if(target <> 'noticias_raras' AND target <> label)::BIGINT AS remapped, count_if(target = 'noticias_raras')::BIGINT AS removed, (count_if(target <> 'noticias_raras') - count(DISTINCT CASE WHEN target <> 'noticias_raras' THEN target END))::BIGINT AS merged FROM o""")
def tree_on_bank(spark, sf):
    """The tree run over a bank whose labels are candidates: what it does to the bank's classifiers."""
    d = docs_of(spark, sf)
    groups = d.groupBy(F.concat(F.lit("novo_"), "lang", F.lit("_"), F.length(F.coalesce("text", F.lit(""))) % 6).alias("label")).agg(F.count("*").alias("occurrences"))
    bank = raw_bank(spark, sf).withColumn("label", F.concat(F.lit("novo_"), F.substring("label", 6, 2), F.lit("_"), F.col("pos") % 6))
    counts = taxonomy.organise(groups, rules.compact(bank), ["tema_en", "tema_de"], {"familia_fr": ["fr"]}, weak=("novo", *"012345"))[2]
    return counts.select(F.col("remapped_classifiers").alias("remapped"), F.col("removed_classifiers").alias("removed"), F.col("merged_classifiers").alias("merged"))
