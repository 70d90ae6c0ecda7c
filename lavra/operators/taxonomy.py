"""Rare cases, candidate groups, families and parents, the tree policy and the final join of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions.text import let, squeeze
from lavra.operators.rules import remap, remap_counts
from lavra.operators.sampling import recurrence

RARE = "noticias_raras"
# Words that tell nothing about a rare case.
RARE_STOP = ("policia", "federal", "operacao", "deflagra", "investiga", "noticia", "crime", "crimes", "tema", "claro", "canonicas", "fornecidas")


def _held(text: Column, needles: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, needles)), lambda n: text.contains(n))


def first_rule(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """struct(label, reason) of the first rule with a needle in the folded text, up to four of its needles shown; null for none."""
    found = F.lit(None).cast("struct<label: string, reason: string>")
    for name, needles in reversed(rules):
        hit = F.lit(False)
        for n in needles:
            hit = hit | text.contains(n)
        found = F.when(hit, F.struct(F.lit(name).alias("label"), F.array_join(F.slice(_held(text, needles), 1, 4), "; ").alias("reason"))).otherwise(found)
    return found


def rare_case(text: Column, rules: list[tuple[str, list[str]]], stop: tuple[str, ...] | list[str] = RARE_STOP) -> Column:
    """struct(label, reason): the first rule with a needle in the folded text; else `rara_` and the first three telling tokens, repeats
    included; else a fixed name."""
    telling = F.slice(F.filter(F.regexp_extract_all(text, F.lit("[a-z0-9]{4,}"), F.lit(0)), lambda t: ~t.isin(*stop)), 1, 3)
    made = let(telling, lambda w: F.when(F.size(w) > 0, F.struct(F.concat(F.lit("rara_"), F.array_join(w, "_")).alias("label"), F.lit("assinatura lexical automatica").alias("reason"))).otherwise(F.struct(F.lit("rara_sem_assinatura").alias("label"), F.lit("sem termos suficientes").alias("reason"))))
    return F.coalesce(first_rule(text, rules), made)


def rare_signature(text: Column, rules: list[tuple[str, list[str]]], stop: tuple[str, ...] | list[str] = RARE_STOP) -> Column:
    return rare_case(text, rules, stop)["label"]


def suggested(text: Column, rules: list[tuple[str, list[str]]], rare: str = RARE) -> Column:
    """struct(label, reason) of the first rule with a needle in the folded text, else the rare label."""
    none = F.struct(F.lit(rare).alias("label"), F.lit("sem evidencia suficiente para macrotema; noticia rara").alias("reason"))
    return F.coalesce(first_rule(text, rules), none)


def review_quarantine(rows: DataFrame, label: str, status: str, text: Column, rescue: list[tuple[str, list[str]]], signs: list[tuple[str, list[str]]], held: str = "quarentena") -> DataFrame:
    """`rows` with label_after, status_after, reason and signature: rows in quarantine get the label of the first rescue rule or the rare
    one, and then a signature; others stay as they are."""
    inside, found = F.col(label) == held, suggested(text, rescue)
    rows = rows.withColumn("_s", F.when(inside, found))
    rare = F.col("_s.label") == RARE
    return rows.withColumns({
        "label_after": F.coalesce("_s.label", label), "reason": F.coalesce("_s.reason", F.lit("")),
        "status_after": F.when(rare, "noticia_rara").when(inside, "quarentena_reclassificada_pos_arvore").otherwise(F.col(status)),
        "signature": F.when(rare, rare_signature(text, signs)),
    }).drop("_s")


def promote(observed: DataFrame, signature: str, order: list[str], never: str = "operacao_sem_contexto", at: int = 2) -> DataFrame:
    """signature_count is the recurrence so far; promoted from the `at`-th on."""
    counted = recurrence(observed, signature, order, "signature_count")
    return counted.withColumn("promoted", (F.col("signature_count") >= at) & (F.col(signature) != never))


def rare_summary(observed: DataFrame, signature: str, promoted: str = "promoted") -> DataFrame:
    """(signature, observations, promoted): how often each signature was seen, and whether it was promoted."""
    return observed.groupBy(F.col(signature).alias("signature")).agg(F.count("*").alias("observations"), F.max(promoted).alias("promoted"))


def candidate_groups(candidates: DataFrame, label: str, iteration: str, title: str, pos: str, examples: int = 5) -> DataFrame:
    """By label: rows, distinct iterations and the first examples. The examples are cut before they are gathered."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(pos))
    shown = candidates.withColumn("_r", rank).where(F.col("_r") <= examples).groupBy(label).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", title))), lambda x: x[title]), " | ").alias("examples"))
    sums = candidates.groupBy(label).agg(F.count("*").alias("occurrences"), F.count_distinct(iteration).alias("iterations"))
    return sums.join(shown, label)


def evidence_terms(candidates: DataFrame, label: str, columns: list[str], pos: str, most: int = 12) -> DataFrame:
    """(label, terms): the first distinct parts of 8 to 90 characters, between . , and ;, of the columns of each label's rows."""
    parts = F.flatten(F.array(*(F.split(F.coalesce(c, F.lit("")), "[.,;]") for c in columns)))
    clean = F.filter(F.transform(parts, squeeze), lambda t: F.length(t).between(8, 90))
    each = candidates.select(F.col(label).alias("label"), pos, F.posexplode(clean).alias("i", "term")).groupBy("label", "term").agg(F.min(F.struct(pos, "i")).alias("at"))
    few = each.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("at"))).where(F.col("_r") <= most)
    return few.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]).alias("terms"))


def rules_of(candidates: DataFrame, bank: DataFrame, label: str, most: int = 12) -> DataFrame:
    """(label, patterns): the first rules of each candidate label, none where the bank has none."""
    first = bank.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("pos"))).where(F.col("_r") <= most)
    held = first.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "pattern"))), lambda x: x["pattern"]).alias("patterns"))
    return candidates.select(F.col(label).alias("label")).distinct().join(held, "label", "left").select("label", F.coalesce("patterns", F.array().cast("array<string>")).alias("patterns"))


def label_tokens(label: Column, weak: tuple[str, ...] = ()) -> Column:
    """The distinct words of a label but weak ones."""
    return F.array_distinct(F.filter(F.split(label, "_"), lambda t: (t != "") & ~t.isin(*weak))) if weak else F.array_distinct(F.filter(F.split(label, "_"), lambda t: t != ""))


def _most_shared(tokens: Column, table: list[tuple[str, list[str]]]) -> Column:
    """struct(n, name) of the entry that shares most words with `tokens`, the first of equals; n is 0 for none."""
    hits = [F.struct(F.size(F.array_intersect(tokens, F.array(*map(F.lit, words)))).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(table)]
    return F.array_max(F.array(*hits)) if hits else F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.lit(None).cast("string").alias("name"))


def placed(groups: DataFrame, active: list[str], families: dict[str, list[str]], absorbing: dict[str, list[str]] | None = None, weak: tuple[str, ...] = ()) -> DataFrame:
    """`groups` (label, ...) with parent and family: the active label, by its own or its absorbing words, and the family that share most
    words with the candidate. Equal labels go by name; a label's absorbing words must share more than the best own words. Null for none."""
    words = [(a, [t for t in dict.fromkeys(a.split("_")) if t and t not in weak]) for a in sorted(active)]
    rows = groups.withColumn("_t", label_tokens(F.col("label"), weak))
    rows = rows.withColumns({"_own": _most_shared(F.col("_t"), words), "_by": _most_shared(F.col("_t"), [(a, w) for a, w in (absorbing or {}).items() if a in active]), "_f": _most_shared(F.col("_t"), list(families.items()))})
    parent = F.when(F.col("_by.n") > F.col("_own.n"), F.col("_by.name")).when(F.col("_own.n") > 0, F.col("_own.name"))
    return rows.withColumns({"parent": parent, "family": F.when(F.col("_f.n") > 0, F.col("_f.name"))}).drop("_t", "_own", "_by", "_f")


def tree_policy(groups: DataFrame) -> DataFrame:
    """decision and target of (label, occurrences, parent, family): rules in their fixed order."""
    total = groups.where("family is not null").groupBy(F.col("family").alias("_family")).agg(F.sum("occurrences").alias("family_total"))
    rows = groups.join(total, F.col("family") == F.col("_family"), "left").drop("_family").withColumn("family_total", F.coalesce("family_total", F.lit(0)))
    has_parent, has_family = F.col("parent").isNotNull(), F.col("family").isNotNull()
    decision = (
        F.when(has_parent & ~has_family, "merge_into_existing").when(has_family & (F.col("family_total") >= 3), "promote_to_canonical").when(has_parent, "merge_into_existing")
        .when(F.col("occurrences") >= 3, "promote_to_canonical").when(has_family, "keep_as_leaf").otherwise("merge_into_existing")
    )
    target = (
        F.when(has_parent & ~has_family, F.col("parent")).when(has_family & (F.col("family_total") >= 3), F.col("family")).when(has_parent, F.col("parent"))
        .when(F.col("occurrences") >= 3, F.col("label")).when(has_family, F.col("family")).otherwise(F.lit(RARE))
    )
    return rows.withColumns({"decision": decision, "target": target})


def organise(groups: DataFrame, bank: DataFrame, active: list[str], families: dict[str, list[str]], absorbing: dict[str, list[str]] | None = None, weak: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole tree run over candidate groups (label, occurrences): (decisions, the bank under the new labels, one row of counts)."""
    decided = tree_policy(placed(groups, active, families, absorbing, weak))
    names = decided.select("label", F.col("target").alias("new_label"))
    by = decided.agg(F.count("*").alias("decisions"), *(F.count_if(F.col("decision") == d).alias(n) for d, n in (("merge_into_existing", "merged"), ("promote_to_canonical", "promoted"), ("keep_as_leaf", "leaves"))), F.count_distinct(F.when(F.col("decision") == "promote_to_canonical", F.col("target"))).alias("promoted_themes"))
    moved = remap_counts(bank, names).select(F.col("remapped").alias("remapped_classifiers"), F.col("removed").alias("removed_classifiers"), F.col("merged").alias("merged_classifiers"))
    return decided, remap(bank, names), by.join(moved)  # two tables of one row


def refined(classified: DataFrame, decisions: DataFrame) -> DataFrame:
    """label_final and status_final of (label, status): decisions by label, else as they are."""
    rows = classified.join(decisions.select("label", "decision", "target"), "label", "left")
    status = F.when(F.col("decision") == "promote_to_canonical", "candidato_promovido").when(F.col("decision") == "keep_as_leaf", "candidato_folha").when(F.col("decision").isNotNull(), "candidato_mesclado").otherwise(F.col("status"))
    return rows.withColumns({"label_final": F.coalesce("target", "label"), "status_final": status}).drop("decision", "target")
