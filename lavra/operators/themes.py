"""Canonical themes from clusters, their profiles, and the review of residuals against them. The needles of each theme are parameters."""

from __future__ import annotations

import functools
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions.text import delimited_set, fold, let, phrase_of, plain_slug, slug
from lavra.operators.features import centroids, tfidf, top_terms
from lavra.operators.learning import canonical_labels
from lavra.runtime import materialise

RARE = "noticias_raras"
NOTHING = "tema_operacional"
Needles = list[tuple[str, list[str]]]


def holds(folded: Column, needles: list[str]) -> Column:
    """Whether the folded text has a phrase whose words begin like a needle's."""
    forms = [p for n in needles if (p := phrase_of(n, r"\s+"))]
    return functools.reduce(lambda a, b: a | b, (folded.rlike(p) for p in forms), F.lit(False))


def named_themes(terms: Column, rules: Needles) -> Column:
    """All labels with a needle in the terms, in the order of the rules; the terms are folded once."""
    return let(fold(F.array_join(terms, " ")), lambda said: F.array_compact(F.array(*(F.when(holds(said, needles), label) for label, needles in rules))))


def canonical_themes(terms: Column, rules: Needles, generic: tuple[str, ...] = ()) -> Column:
    """`named_themes`; else the slug of the first term of five characters or more that isn't generic, which may read like a label; else
    a fixed name."""
    def usable(ts: Column) -> Column:
        return F.filter(F.transform(F.filter(ts, lambda t: F.length(t) >= 5), plain_slug), lambda s: ~s.isin(*generic) if generic else F.lit(True))

    def chosen(ts: Column) -> Column:
        fallback = let(usable(ts), lambda u: F.when(F.size(u) > 0, F.slice(u, 1, 1)).otherwise(F.array(F.lit(NOTHING))))
        return let(named_themes(ts, rules), lambda labels: F.when(F.size(labels) > 0, labels).otherwise(fallback))

    return let(terms, chosen)


def evidence_of(label: Column, term: Column, rules: Needles, generic: tuple[str, ...] = ()) -> Column:
    """Whether a term has a needle of the label in it and isn't generic."""
    folded = fold(term)
    fits = functools.reduce(lambda a, b: a | b, ((label == name) & holds(folded, needles) for name, needles in rules), F.lit(False))
    return fits & ~plain_slug(term).isin("", *generic)


def fallback_themes(summary: DataFrame, rules: Needles, generic: tuple[str, ...] = (), noise: int = -1, shown: int = 12) -> tuple[DataFrame, DataFrame]:
    """(themes: label, cluster_ids, subthemes, evidence_terms, confidence, decision; quarantined cluster ids) of a cluster summary. Themes
    are those that a cluster's terms, tags and titles name; clusters without any join none."""
    preferred = [(label, needles[:4]) for label, needles in rules]
    parts = {n: delimited_set(F.col(c)) for n, c in (("terms", "top_terms"), ("tags", "sample_tags"), ("titles", "sample_titles"))}
    rows = summary.where(F.col("cluster_id") != noise).select("cluster_id", *(c.alias(n) for n, c in parts.items()))
    named = rows.withColumn("labels", canonical_themes(F.concat("terms", "tags", "titles"), rules, generic)).withColumn("label", F.explode("labels")).where(F.col("label") != NOTHING)
    table = F.create_map(*(x for k, v in (preferred or [("", [""])]) for x in (F.lit(k), F.array(*map(F.lit, v)))))
    own = F.coalesce(F.element_at(table, F.col("label")), F.array().cast("array<string>"))
    each = named.select("label", "cluster_id", own.alias("own"), F.posexplode(F.concat(own, "terms", F.slice("tags", 1, 8))).alias("i", "term"))
    each = each.where(F.array_contains("own", F.col("term")) | evidence_of(F.col("label"), F.col("term"), preferred, generic))
    first = each.groupBy("label", "term").agg(F.min(F.struct("cluster_id", "i")).alias("at")).withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("at"))).where(F.col("_r") <= shown)
    terms = first.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]).alias("evidence_terms"))
    leaf = F.when(F.size("labels") > 1, F.concat(F.lit("cluster_"), F.col("cluster_id"), F.lit("_folha")))
    groups = named.withColumn("leaf", leaf).groupBy("label").agg(F.array_sort(F.collect_set("cluster_id")).alias("cluster_ids"), F.array_sort(F.collect_set("leaf")).alias("subthemes"))  # ids of clusters, which are few
    out = groups.join(terms, "label", "left").select("label", "cluster_ids", "subthemes", F.coalesce("evidence_terms", F.array().cast("array<string>")).alias("evidence_terms"), F.lit(0.62).alias("confidence"), F.lit("accept").alias("decision"))
    return out, summary.where(F.col("cluster_id") == noise).select("cluster_id")


def themes(summary: DataFrame, rules: Needles, provider: Callable[[DataFrame], DataFrame] | None = None, **options) -> DataFrame:
    """The provider's themes (the columns of `fallback_themes`); the fallback's where there is no provider, it fails, or accepts none."""
    if provider is not None:
        try:
            got = materialise(provider(summary), "themes")
            if not got.where("decision = 'accept'").isEmpty():
                return got
        except Exception as error:  # a provider is an outside service: any fault of it means the fallback
            logging.getLogger(__name__).warning("fallback themes, %s: %s", type(error).__name__, error)
    return fallback_themes(summary, rules, **options)[0]


def theme_profiles(docs: DataFrame, accepted: DataFrame, preferred: dict[str, list[str]], shown: int = 12) -> tuple[DataFrame, DataFrame]:
    """(profiles: profile, term, w at length 1; metadata: label, documents, matched, top_terms) of docs (doc_id, cluster_id, text) for accepted
    themes (label, cluster_ids). A profile is the mean of its clusters' documents, of those that hold a preferred term if any do, and of a seed
    text of the label and its preferred terms twice."""
    spark = docs.sparkSession
    seeds = [(r["label"], " ".join([r["label"].replace("_", " "), *preferred.get(r["label"], []) * 2])) for r in accepted.select("label").collect()]  # a row a theme
    seeded = spark.createDataFrame([(f"seed:{n}", t) for n, t in seeds], "doc_id string, text string")
    every = docs.select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("doc_id"), "text").unionByName(seeded)
    w = tfidf(every, max_df=0.9, max_features=30_000)
    of = accepted.select("label", F.explode("cluster_ids").alias("cluster_id"))
    folded = fold(F.col("text"))
    hit = functools.reduce(lambda a, b: a | b, ((F.col("label") == name) & (holds(folded, terms) if terms else F.lit(True)) for name, terms in preferred.items()), ~F.col("label").isin("", *preferred))
    mine = materialise(docs.join(of, "cluster_id").select("label", F.concat(F.lit("doc:"), F.col("doc_id")).alias("doc_id"), hit.alias("hit")), "members")
    known = mine.groupBy("label").agg(F.count("*").alias("all"), F.count_if("hit").alias("matched"))
    used = mine.join(known, "label").where("hit or matched = 0").select("doc_id", F.col("label").alias("cluster"))
    seed = w.where("startswith(doc_id, 'seed:')").select(F.substr("doc_id", F.lit(6)).alias("cluster"), "term", "w")
    both = centroids(w, used).unionByName(seed).groupBy("cluster", "term").agg(F.sum("w").alias("raw"))
    norms = both.groupBy("cluster").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    profiles = materialise(both.join(norms, "cluster").select("cluster", "term", (F.col("raw") / F.col("norm")).alias("w")), "profiles")
    best = top_terms(profiles, shown, 1).groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " | ").alias("top_terms"))
    facts = accepted.select("label").join(known, "label", "left").join(best.withColumnRenamed("cluster", "label"), "label", "left")
    documents = F.when(F.col("matched") > 0, F.col("matched")).otherwise(F.coalesce("all", F.lit(0)))
    return profiles.withColumnRenamed("cluster", "profile"), facts.select("label", documents.alias("documents"), F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("top_terms", F.lit("")).alias("top_terms"))


def new_themes(docs: DataFrame, text: Column, allowed: list[str], rules: list[tuple[str, str]]) -> DataFrame:
    """`docs` with new_theme: the first theme that isn't allowed yet and whose pattern the folded text has."""
    folded, out = fold(text), F.lit(None).cast("string")
    for label, pattern in reversed(rules):
        if label not in allowed:
            out = F.when(folded.rlike(pattern), label).otherwise(out)
    return docs.withColumn("new_theme", out)


def reviewed(reviews: DataFrame, allowed: list[str]) -> DataFrame:
    """`reviews` (decision, label, rationale, ...) as they are taken: a candidate has the slug of its label, a classified one an allowed label
    of the same slug or words; any other review, or label, is a rare case."""
    canonical = canonical_labels(reviews.where("decision = 'classificar'").select("label"), allowed).withColumnRenamed("canonical", "_c")
    rows = reviews.join(canonical, "label", "left")
    made = slug(F.col("label"))
    new = (F.col("decision") == "novo_tema_candidato") & (made != "")
    fits = (F.col("decision") == "classificar") & F.col("_c").isNotNull()
    why = F.when(F.col("decision") == "novo_tema_candidato", "Novo tema candidato sem label valida.").when(F.col("decision") == "classificar", "Label retornada fora da lista canonica permitida.").otherwise(F.coalesce(F.nullif("rationale", F.lit("")), F.lit("Residual sem encaixe defensavel nos temas canonicos ou nos candidatos substantivos.")))
    return rows.withColumns({
        "label": F.when(new, made).when(fits, F.col("_c")).otherwise(RARE), "decision": F.when(new, "novo_tema_candidato").otherwise("classificar"),
        "rationale": F.when(new | fits, F.col("rationale")).otherwise(F.concat(F.lit("Classificado como noticia rara: "), why)),
    }).drop("_c")
