"""Reports: token cost, totals of batches, residual labels, and Markdown of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lavra.functions.text import canonical

SUMS = ("docs", "regex_accepted", "regex_residual", "llm_processed", "learned_rules", "new_theme_candidates", "rare_news", "quarantined", "errors")


def token_cost(metrics: DataFrame, events: DataFrame) -> DataFrame:
    """One row of calls and tokens of metrics (llm_processed, prompt_tokens, completion_tokens, tokens); where these have no tokens, of the
    events (status, prompt_tokens, completion_tokens, total_tokens) of residual reviews, of which errors are no calls."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    m = metrics.agg(zero("llm_processed").alias("mc"), zero("prompt_tokens").alias("mp"), zero("completion_tokens").alias("mo"), zero("tokens").alias("mt"))
    e = events.agg(F.count_if(F.coalesce("status", F.lit("")) != "error").alias("ec"), zero("prompt_tokens").alias("ep"), zero("completion_tokens").alias("eo"), zero("total_tokens").alias("et"), F.count("*").alias("n"))
    use = (F.col("mt") == 0) & (F.col("n") > 0)
    pick = lambda a, b, name: F.when(use, F.col(b)).otherwise(F.col(a)).alias(name)
    rows = m.join(e).select(pick("mc", "ec", "calls"), pick("mp", "ep", "prompt_tokens"), pick("mo", "eo", "completion_tokens"), pick("mt", "et", "tokens"))  # two tables of one row
    return rows.withColumn("mean", F.when(F.col("calls") > 0, F.round(F.col("tokens") / F.col("calls"), 4)).otherwise(0.0))


def cost_markdown(cost: dict) -> str:
    lines = [("Chamadas LLM residuais", "calls"), ("Prompt tokens", "prompt_tokens"), ("Completion tokens", "completion_tokens"), ("Tokens totais", "tokens"), ("Media de tokens por residual", "mean")]
    return "\n".join(["# Resumo de custo por tokens", "", "| Indicador | Valor |", "|---|---:|", *(f"| {said} | {cost[k]} |" for said, k in lines), ""])


def totals(metrics: DataFrame) -> DataFrame:
    """One row: batches, the sums of their measures (missing ones are 0) and the share that rules took."""
    have = set(metrics.columns)
    out = metrics.agg(F.count("*").alias("batches"), *((F.coalesce(F.sum(c), F.lit(0)) if c in have else F.lit(0)).cast("long").alias(c) for c in SUMS))
    return out.withColumn("rate", F.when(F.col("docs") > 0, F.round(F.col("regex_accepted") / F.col("docs"), 6)).otherwise(0.0))


def totals_markdown(total: dict, batches: list[dict]) -> str:
    """A report of a run; `batches` has a dict a batch."""
    lines = ["# Execucao da metodologia incremental", "", "## Lotes", "", f"- Iteracoes documentadas: {total['batches']}", *(f"- {k}: {total[k]}" for k in SUMS), f"- Taxa regex acumulada: {total['rate']:.2%}", "", "## Interacoes", ""]
    return "\n".join([*lines, *(f"- {b['batch_id']}: docs={b['docs']}, regex={b['regex_accepted']}, residual={b['regex_residual']}, taxa_regex={b['rate']:.2%}" for b in batches), ""])


def residual_labels(records: DataFrame, limit: int = 30, examples: int = 5) -> DataFrame:
    """(label, count, examples) of records (pos, accepted, labels, identity, title) that no rule accepted: how many name each label (the identity
    where they name none) and the first titles; the `limit` commonest. Titles are cut before they are gathered."""
    left = records.where("not coalesce(accepted, false)")
    named = F.when(F.size(F.coalesce("labels", F.array().cast("array<string>"))) > 0, F.col("labels")).otherwise(F.array("identity"))
    labels = F.array_distinct(F.filter(F.transform(named, lambda x: canonical(x)), lambda x: x != ""))
    each = left.select("pos", F.trim(F.coalesce("title", F.lit(""))).alias("title"), F.explode(labels).alias("label"))
    count = each.groupBy("label").agg(F.count("*").alias("count"), F.min("pos").alias("first")).orderBy(F.desc("count"), "first", "label").limit(limit)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("pos"))
    shown = each.where("title <> ''").join(F.broadcast(count.select("label")), "label", "left_semi").withColumn("_r", rank).where(F.col("_r") <= examples)
    said = shown.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "title"))), lambda x: x["title"]).alias("examples"))
    return count.join(said, "label", "left").select("label", "count", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def batch_measures(rows: DataFrame) -> DataFrame:
    """The measures of each batch of rows (batch_id, status, decision, label, learned, prompt_tokens, completion_tokens, total_tokens): decision is
    null for rows that no reviewer saw, `error` where it failed."""
    seen, ok = F.col("decision").isNotNull(), F.col("decision").isNotNull() & (F.col("decision") != "error")
    taken = F.col("status") != "regex_below_threshold"
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = rows.groupBy("batch_id").agg(
        F.count("*").alias("docs"), F.count_if(taken).alias("regex_accepted"), F.count_if(~taken).alias("regex_residual"), F.count_if(ok).alias("llm_processed"), F.count_if(seen).alias("attempted"),
        F.count_if(F.col("decision") == "classificar").alias("classified"), F.count_if(F.col("decision") == "quarentena").alias("quarantined"), F.count_if(F.col("decision") == "novo_tema_candidato").alias("new_theme_candidates"),
        F.count_if((F.col("decision") == "classificar") & (F.col("label") == "noticias_raras")).alias("rare_news"), F.count_if(F.col("decision") == "error").alias("errors"), zero("learned").alias("learned_rules"),
        zero("prompt_tokens").alias("prompt_tokens"), zero("completion_tokens").alias("completion_tokens"), zero("total_tokens").alias("tokens"),
    )
    return out.withColumns({"avg_tokens": F.when(F.col("llm_processed") > 0, F.round(F.col("tokens") / F.col("llm_processed"), 4)).otherwise(0.0), "rate": F.round(F.col("regex_accepted") / F.col("docs"), 6)})


def cumulative(measures: DataFrame, before: dict | None = None) -> DataFrame:
    """Running sums by batch_id (a row a batch) on top of those of an earlier run, and the running rate."""
    before = before or {}
    w = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = lambda c: (F.sum(c).over(w) + F.lit(before.get(c, 0))).cast("long")
    out = measures.withColumns({f"cumulative_{c}": run(c) for c in ("docs", "regex_accepted", "llm_processed")})
    return out.withColumn("cumulative_rate", F.round(F.col("cumulative_regex_accepted") / F.col("cumulative_docs"), 6))
