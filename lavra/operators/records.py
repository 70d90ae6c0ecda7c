"""Records of a case: payloads of a reviewer read under any of their spellings, checked, nested, flattened and shown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.text import canonical, case_class, context, crime_identity, fold, identity_label, json_object, label_list, let, list_value, object_key, slug, squeeze, truncate_line, truthy
from lavra.operators import rules as R
from lavra.operators.learning import learned_pattern
from lavra.runtime import materialise
from lavra.sources import markup

# Wrapper keys, and the spellings of each field, best first.
WRAPPERS = ("resultado", "response", "output", "data", "json", "answer")
KEYS = {
    "identidade_canonica": ("identidade_canonica", "identidade", "identidade_canonica_do_caso", "identity"),
    "classificacao": ("classificacao", "classification", "categoria", "tipo"),
    "crimes_mais_presentes": ("crimes_mais_presentes", "crimes_presentes", "crimes", "crime"),
    "modus_operandi": ("modus_operandi", "modus", "modos_operandi", "modos_de_atuacao", "modos_de_operacao"),
    "resumo_curto": ("resumo_curto", "resumo", "sumario", "summary"),
    "resumo_estruturado": ("resumo_estruturado", "sumario_estruturado", "structured_summary"),
    "evidencia_textual": ("evidencia_textual", "evidencia", "trecho_evidencia", "evidence"),
    "atores_mencionados": ("atores_mencionados", "atores", "instituicoes", "atores_institucionais"),
    "setor_afetado": ("setor_afetado", "setor", "dominio_afetado"),
    "precisa_reprocessamento": ("precisa_reprocessamento",),
}
SUMMARY = ("fato_central", "alvo", "local", "acao_policial", "resultado")
CASES = ("Por crime", "Com operacao nomeada", "Outras")
META = ("titulo", "subtitulo", "data_publicacao", "data_atualizacao", "tags", "dateline", "nome_operacao_encontrado")
FLAT = ("arquivo", *META, *KEYS, "fonte_classificacao", "confianca_regex")


def _entries(json: Column) -> Column:
    """The keys of a JSON object, spelling aside, with their values as text (nested ones as JSON)."""
    return F.transform(F.map_entries(F.from_json(json, "map<string,string>")), lambda e: F.struct(object_key(e["key"]).alias("k"), e["value"].alias("v")))


def _last(entries: Column, key: str) -> Column:
    """The value of the last entry of this key; a null value is blank, no entry null."""
    return let(F.filter(entries, lambda e: e["k"] == key), lambda found: F.when(F.size(found) > 0, F.coalesce(F.element_at(found, -1)["v"], F.lit(""))))


def unwrapped(rows: DataFrame, payload: str, levels: int = 3) -> DataFrame:
    """`rows` with the payload out of up to `levels` wrapper objects, whatever way their keys are spelt."""
    for _ in range(levels):
        rows = rows.withColumn("_e", _entries(F.col(payload)))
        inner = F.coalesce(*(let(_last(F.col("_e"), w), lambda v: F.when(F.trim(v).startswith("{"), v)) for w in WRAPPERS))
        rows = rows.withColumn(payload, F.coalesce(inner, payload)).drop("_e")
    return rows


def _identity(said: Column, crimes: Column, allowed: list[str], aliases: dict[str, str] | None) -> Column:
    first = F.get(crimes, F.lit(0))
    own = let(canonical(F.regexp_replace(said, "^crime_", ""), aliases), lambda s: F.when(s == "", said).when(s.isin(*allowed), crime_identity(s)).otherwise(F.coalesce(F.when(first.startswith("crime_"), first).otherwise(F.concat(F.lit("crime_"), first)), F.lit("noticia_sem_crime_especifico"))))
    return F.when(said.startswith("crime_"), own).when((F.size(crimes) > 0) & ((said == "") | said.startswith("operacao_")), crime_identity(first)).otherwise(said)


def coerced(rows: DataFrame, payload: str, allowed: list[str], sectors: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """`rows` with a struct `inference` of the ten fields, each under the first of its spellings that is there; null where the payload isn't
    a JSON object. Crimes are only allowed ones; without any, an allowed identity is one, and else the case is of another class."""
    rows = unwrapped(rows, payload).withColumn("_e", _entries(F.col(payload)))
    # Each field's raw value is a column of its own, so that the plan doesn't repeat how it is found wherever it is used.
    rows = rows.withColumns({f"_g_{name}": F.coalesce(*(_last(F.col("_e"), k) for k in KEYS[name])) for name in KEYS})
    get = lambda name: F.col(f"_g_{name}")
    text = lambda name: F.coalesce(squeeze(get(name)), F.lit(""))
    nested = F.coalesce(*(let(_last(F.col("_e"), k), lambda v: F.when(F.trim(v).startswith("{"), v)) for k in KEYS["resumo_estruturado"]))
    rows = rows.withColumns({"_c": label_list(get("crimes_mais_presentes"), allowed or [""], aliases), "_k": case_class(get("classificacao")), "_s": object_key(F.coalesce(get("setor_afetado"), F.lit("")))})
    rows = rows.withColumn("_o", object_key(F.coalesce(get("identidade_canonica"), F.lit(""))))
    rows = rows.withColumn("_i", _identity(F.col("_o"), F.col("_c"), allowed or [""], aliases))
    rows = rows.withColumn("_n", identity_label(F.col("_i"), aliases))
    named = F.col("_n")
    rows = rows.withColumn("_c", F.when((F.size("_c") == 0) & named.isin("", *allowed) & (named != ""), F.array(named)).otherwise(F.col("_c")))
    other = (F.size("_c") == 0) & ((F.col("_i") == "noticia_sem_crime_especifico") | (F.col("_k") == "Por crime"))
    made = F.struct(
        F.col("_i").alias("identidade_canonica"), F.when(other, "Outras").otherwise(F.col("_k")).alias("classificacao"), F.col("_c").alias("crimes_mais_presentes"), label_list(get("modus_operandi"), None, aliases).alias("modus_operandi"),
        text("resumo_curto").alias("resumo_curto"), F.coalesce(F.from_json(nested, "map<string,string>"), F.create_map().cast("map<string,string>")).alias("resumo_estruturado"), text("evidencia_textual").alias("evidencia_textual"),
        list_value(get("atores_mencionados")).alias("atores_mencionados"), F.when(F.col("_s").isin("", *sectors) & (F.col("_s") != ""), F.col("_s")).otherwise("nao_identificado").alias("setor_afetado"), truthy(get("precisa_reprocessamento")).alias("precisa_reprocessamento"),
    )
    return rows.withColumn("inference", F.when(F.col("_e").isNotNull(), made)).drop("_e", "_c", "_k", "_s", "_i", "_o", "_n", *(f"_g_{name}" for name in KEYS))


def validated(inference: Column) -> Column:
    """struct(value, error): the inference with its lists distinct and capped and its identity in line with its first crime; `error` tells
    what it lacks, and value is null then."""
    labels = lambda c: F.slice(F.array_distinct(F.filter(F.transform(c, slug), lambda x: x != "")), 1, 10)

    def read(r: Column) -> Column:
        crimes = labels(r["crimes_mais_presentes"])
        said = slug(r["identidade_canonica"])
        off = (r["classificacao"] == "Por crime") & (F.size(crimes) > 0) & ~said.rlike("^crimes?_")
        identity = F.when(off, F.concat(F.lit("crime_"), F.get(crimes, F.lit(0)))).otherwise(said)
        summary = F.map_filter(F.transform_values(F.map_filter(r["resumo_estruturado"], lambda k, v: k.isin(*SUMMARY)), lambda k, v: squeeze(v)), lambda k, v: v != "")
        actors = F.slice(F.array_distinct(F.filter(F.transform(r["atores_mencionados"], squeeze), lambda x: x != "")), 1, 12)
        value = F.struct(
            identity.alias("identidade_canonica"), r["classificacao"].alias("classificacao"), crimes.alias("crimes_mais_presentes"), labels(r["modus_operandi"]).alias("modus_operandi"), F.trim(r["resumo_curto"]).alias("resumo_curto"),
            summary.alias("resumo_estruturado"), F.trim(r["evidencia_textual"]).alias("evidencia_textual"), actors.alias("atores_mencionados"), slug(r["setor_afetado"]).alias("setor_afetado"), r["precisa_reprocessamento"].alias("precisa_reprocessamento"),
        )
        fault = F.when(~F.coalesce(r["classificacao"].isin(*CASES), F.lit(False)), "classificacao").when(identity == "", "identidade_canonica").when((F.size(crimes) == 0) & (r["classificacao"] == "Por crime"), "crimes_mais_presentes")
        return F.struct(F.when(fault.isNull(), value).alias("value"), fault.alias("error"))

    return let(inference, read)


def valid_date(c: Column) -> Column:
    """Whether a date field is blank or dd/mm/yyyy."""
    return c.rlike(r"^$|^\d{2}/\d{2}/\d{4}$")


def parsed(rows: DataFrame, answer: str, allowed: list[str], sectors: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """`rows` with `inference` and `error` of a reviewer's answer: the outermost JSON object, coerced and validated. The error is `empty`,
    `no JSON: ...` or `schema (field): ...` with the head of the answer."""
    said = F.trim(F.coalesce(answer, F.lit("")))
    rows = coerced(rows.withColumn("_p", F.when(json_object(said) != "", json_object(said)).otherwise(said)), "_p", allowed, sectors, aliases)
    rows = rows.withColumn("_v", F.when(F.col("inference").isNotNull(), validated(F.col("inference"))))
    head = truncate_line(said)
    error = F.when(said == "", "empty").when(F.col("inference").isNull(), F.concat(F.lit("no JSON: "), head)).when(F.col("_v.error").isNotNull(), F.concat(F.lit("schema ("), F.col("_v.error"), F.lit("): "), head))
    return rows.withColumns({"error": error, "inference": F.when(error.isNull(), F.col("_v.value"))}).drop("_p", "_v")


def sensitive_evidence(label: Column, text: Column, patterns: dict[str, list[str]]) -> Column:
    """Whether the folded text has one of the label's patterns; labels without patterns need none."""
    folded, out = fold(text), F.lit(True)
    for name, forms in patterns.items():
        out = F.when(label == name, folded.rlike("|".join(f"(?:{f})" for f in forms))).otherwise(out)
    return out


def needs_rescue(inference: Column, text: Column, patterns: dict[str, list[str]], aliases: dict[str, str] | None = None) -> Column:
    """No crime, another class, an unknown identity, or a crime without the evidence that it needs."""
    unknown = identity_label(inference["identidade_canonica"], aliases).isin("crime_desconhecido", "desconhecido", "contato_institucional")
    bare = F.exists(inference["crimes_mais_presentes"], lambda c: ~sensitive_evidence(canonical(c, aliases), text, patterns))
    return (F.size(inference["crimes_mais_presentes"]) == 0) | (inference["classificacao"] == "Outras") | unknown | bare


def rescued(rows: DataFrame, rules: list, id_col: str = "doc_id", text_col: str = "text", tags_col: str | None = None, threshold: float = 0.85) -> DataFrame:
    """The records of the rows that rules classify at the threshold; the others have none."""
    return R.record(rows, rules, threshold, id_col, text_col, tags_col).where("accepted")


def from_review(reviews: DataFrame) -> DataFrame:
    """`reviews` (label, summary, evidence, decision) with the inference that they state."""
    none = F.array().cast("array<string>")
    return reviews.withColumn("inference", F.struct(
        F.when(slug(F.col("label")).rlike("^crimes?_"), slug(F.col("label"))).otherwise(F.concat(F.lit("crime_"), slug(F.col("label")))).alias("identidade_canonica"),
        F.lit("Por crime").alias("classificacao"), F.array(slug(F.col("label"))).alias("crimes_mais_presentes"), none.alias("modus_operandi"), F.col("summary").alias("resumo_curto"), F.create_map().cast("map<string,string>").alias("resumo_estruturado"),
        F.col("evidence").alias("evidencia_textual"), none.alias("atores_mencionados"), F.lit("").alias("setor_afetado"), (F.col("decision") != "classificar").alias("precisa_reprocessamento"),
    ))


def nested(rows: DataFrame) -> DataFrame:
    """(arquivo, metadata_extraido, inferencia_llm, fonte_classificacao, regex_classificacao, regex_rules_aprendidas) of rows with metadata and inference structs, source,
    a classification record's fields and learned rules."""
    record = F.struct(F.col("source").startswith("regex").alias("accepted"), F.round("confidence", 3).alias("confidence"), F.col("regex_source").alias("source"), "operation_name", "matched_rules")
    return rows.select("arquivo", F.col("metadata").alias("metadata_extraido"), F.col("inference").alias("inferencia_llm"), F.col("source").alias("fonte_classificacao"), record.alias("regex_classificacao"), F.coalesce("learned", F.array().cast("array<struct<kind: string, label: string, pattern: string>>")).alias("regex_rules_aprendidas"))


def flattened(records: DataFrame) -> DataFrame:
    """The 20 columns of nested records; what is missing has its default."""
    kinds = {"tags": "array<string>", "crimes_mais_presentes": "array<string>", "modus_operandi": "array<string>", "atores_mencionados": "array<string>"}

    def column(parent: str, name: str) -> Column:
        c = F.col(f"{parent}.{name}")
        if name in kinds:
            return F.coalesce(c, F.array().cast(kinds[name]))
        if name == "resumo_estruturado":
            return F.coalesce(c, F.create_map().cast("map<string,string>"))
        if name == "precisa_reprocessamento":
            return F.coalesce(c, F.lit(False))
        return F.coalesce(F.trim(c), F.lit(""))

    return records.select(
        F.coalesce(F.trim("arquivo"), F.lit("")).alias("arquivo"), *(column("metadata_extraido", n).alias(n) for n in META), *(column("inferencia_llm", n).alias(n) for n in KEYS),
        F.coalesce(F.nullif(F.trim("fonte_classificacao"), F.lit("")), F.lit("llm")).alias("fonte_classificacao"), F.coalesce("regex_classificacao.confidence", F.lit(0.0)).alias("confianca_regex"),
    )


def readable(meta: Column, inference: Column) -> Column:
    """A record as lines of text."""
    some = lambda c, none: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(none)
    said = lambda c, none: F.coalesce(F.nullif(c, F.lit("")), F.lit(none))
    lines = [
        ("Titulo", meta["titulo"]), ("Data", said(meta["data_publicacao"], "sem_data")), ("Dateline", said(meta["dateline"], "sem_dateline")), ("Tags diretas", F.concat(F.lit("["), some(meta["tags"], "sem_tags"), F.lit("]"))),
        ("Operacao direta", said(meta["nome_operacao_encontrado"], "Sem nome de operacao explicito")), ("Identidade canonica", inference["identidade_canonica"]), ("Classificacao", inference["classificacao"]),
        ("Crimes mais presentes", some(inference["crimes_mais_presentes"], "sem_crime_explicitado")), ("Modus operandi", some(inference["modus_operandi"], "sem_modus_explicitado")), ("Resumo curto", said(inference["resumo_curto"], "sem_resumo")),
    ]
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit(""))) for k, v in lines))


def enriched(docs: DataFrame, rules: list, provider: Callable[[DataFrame], DataFrame], allowed: list[str], sectors: list[str], patterns: dict[str, list[str]], threshold: float = 0.85, done: DataFrame | None = None, rescue: float = 0.85) -> DataFrame:
    """The records (`nested`) of docs (arquivo, text in Markdown), one pass: rules first, at `threshold`; documents that they don't
    classify go to the provider ((arquivo, context) -> (arquivo, answer)), whose answers are parsed; those that fall short are
    rescued by rules at `rescue`, whatever the threshold, and an answer that can't be read has no record. A record that rules
    didn't take holds the rules that its labels and text suggest; `learned` in `files` reads them back. Documents of `done` (arquivo)
    are left out."""
    if done is not None:
        docs = docs.join(done.select("arquivo").distinct(), "arquivo", "left_anti")
    parts = docs.select("arquivo", markup.news(F.col("text")).alias("p"), markup.metadata(F.col("text")).alias("metadata"))
    rows = materialise(parts.select("arquivo", "metadata", context(F.col("p.titulo"), F.col("p.subtitulo"), F.col("p.tags"), F.col("p.corpo")).alias("context"), F.col("p.tags").alias("tags")), "parsed")
    ruled = materialise(R.record(rows, rules, threshold, "arquivo", "context", "tags"), "ruled").withColumnRenamed("doc_id", "arquivo")
    none = F.array().cast("array<string>")
    by_rule = F.struct(
        F.col("identity").alias("identidade_canonica"), F.col("classification").alias("classificacao"), F.col("crimes").alias("crimes_mais_presentes"), F.col("modus").alias("modus_operandi"), F.lit("").alias("resumo_curto"),
        F.create_map().cast("map<string,string>").alias("resumo_estruturado"), F.lit("").alias("evidencia_textual"), none.alias("atores_mencionados"), F.lit("").alias("setor_afetado"), F.lit(False).alias("precisa_reprocessamento"),
    )
    facts = [F.col("source").alias("regex_source"), "confidence", "operation_name", "matched_rules"]
    first = ruled.where("accepted").select("arquivo", F.lit("regex").alias("source"), by_rule.alias("inference"), *facts)
    left = rows.join(ruled.where("not accepted").select("arquivo"), "arquivo", "left_semi")
    answers = materialise(provider(left.select("arquivo", "context")), "answers")
    read = materialise(parsed(answers, "answer", allowed, sectors), "read").where("error is null").join(left, "arquivo")
    short = needs_rescue(F.col("inference"), F.col("context"), patterns)
    again = R.record(left, rules, rescue, "arquivo", "context", "tags").where("accepted").select(F.col("doc_id").alias("arquivo"), by_rule.alias("by_rule"))
    read = read.withColumn("short", short).join(again, "arquivo", "left")
    second = read.select("arquivo", F.when(F.col("short") & F.col("by_rule").isNotNull(), "regex_rescue").otherwise("llm").alias("source"), F.when(F.col("short"), F.coalesce("by_rule", "inference")).otherwise(F.col("inference")).alias("inference"))
    second = materialise(second.join(ruled.select("arquivo", *facts), "arquivo"), "inferred")
    learned = suggested(second.join(rows.select("arquivo", "context"), "arquivo"))
    every = first.unionByName(second).join(rows.select("arquivo", "metadata"), "arquivo")
    return nested(every.join(learned, "arquivo", "left"))


def suggested(rows: DataFrame) -> DataFrame:
    """(arquivo, learned): the rules that the labels and the text of rows (arquivo, context, inference) suggest, crimes first; labels
    without enough evidence in the text suggest none. A document has up to twenty labels."""
    named = lambda kind, c: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), canonical(x).alias("label"), x.alias("said")))
    labels = F.concat(named("crime", F.col("inference.crimes_mais_presentes")), named("modus", F.col("inference.modus_operandi")))
    each = rows.select("arquivo", "context", F.posexplode(labels).alias("i", "l"))
    each = each.select("arquivo", "i", "l.kind", "l.label", learned_pattern(F.col("context"), F.col("l.said")).alias("pattern")).where("pattern is not null and label <> ''")
    rules = F.array_sort(F.collect_list(F.struct("i", F.struct("kind", "label", "pattern").alias("rule"))))
    return each.groupBy("arquivo").agg(F.transform(rules, lambda x: x["rule"]).alias("learned"))
