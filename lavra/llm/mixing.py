"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Cell weights are raked until the weighted token sums have the
target shares of each margin: those that the caller states, or else the data's own shares lifted by a power. Inclusion
probabilities start from the weights, in proportion, and are raked again under the bound of 1, so that the expected
tokens of each margin are the wanted fraction of its target where the bound allows it; a value whose own tokens don't
suffice stays at what it has, and the others share the rest. A document is kept if a hash of its id and text, as a number
in [0, 1), is below its probability: copies share their fate, and the choice doesn't hang on partitions.

A null in a margin's column is a value of its own, `(none)`; a value that a stated target doesn't name has target 0. Null
and empty texts have no tokens and go by their cell's probability like others; very long texts are counted whole. Ties
can't arise: cells are distinct. An empty table gives an empty result. Added columns have the prefix `mix_`; `calibrated`
replaces columns of these names, `sampled` gives them back as they were."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.runtime import materialise

CELLS = 200_000  # cells that the driver rakes and broadcasts; more are raked as a table and joined


def n_tokens(text: str = "text") -> Column:
    return F.coalesce(F.expr(f"regexp_count(`{text}`, '\\\\S+')").cast("long"), F.lit(0).cast("long"))


def topic(tokens: Column) -> Column:
    """A stand-in where documents carry no topic: their form by length."""
    return F.when(tokens < 50, "note").when(tokens < 300, "brief").when(tokens < 1500, "article").otherwise("long read")


def rake(tokens: np.ndarray, margins: Sequence[np.ndarray], goals: Sequence[np.ndarray], start: np.ndarray | None = None, bound: float = np.inf, rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Cell weights w, `bound` at most, from `start` (1) on, with bincount(margin, w * tokens) equal to each goal, as far as the bound
    and the cells that are there allow; rounds end where no weight changes by more than `tolerance` of itself."""
    w = np.ones(len(tokens)) if start is None else np.minimum(start, bound)
    for _ in range(rounds):
        was = w
        for m, g in zip(margins, goals):
            have = np.bincount(m, w * tokens, len(g))
            w = np.minimum(bound, w * np.divide(g, have, out=np.ones(len(g)), where=have > 0)[m])
        if np.abs(w - was).max(initial=0) <= tolerance * max(1.0, w.max(initial=0)):
            break
    return w


def _rake_table(cells: DataFrame, goals: Mapping[str, DataFrame], column: str, bound: float | None, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """`rake` of the weights in `column` for more cells than the driver should hold: a join with a margin's sums for each step."""
    now, limit = cells, "" if bound is None else f"{bound!r}d, "
    for _ in range(rounds):
        now = now.withColumn("was", F.col(column))
        for k, goal in goals.items():
            have = now.groupBy(k).agg(F.sum(F.expr(f"{column} * mix_tokens")).alias("have")).join(goal, k)
            now = now.join(materialise(have.selectExpr(f"`{k}`", "if(have > 0, goal / have, 1) as ratio"), "ratios"), k, "left")
            now = now.withColumn(column, F.expr(f"least({limit}{column} * coalesce(ratio, 1))" if limit else f"{column} * coalesce(ratio, 1)")).drop("ratio")
        now = materialise(now, "raked")
        change, most = now.agg(F.max(F.abs(F.col(column) - F.col("was"))), F.max(column)).first()
        now = now.drop("was")
        if (change or 0.0) <= tolerance * max(1.0, most or 0.0):
            break
    return now


def _goals(sums: DataFrame, key: str, total: float, power: float, target: Mapping[str, float] | None, fraction: float) -> DataFrame:
    """(key, goal, bounded): tokens wanted of each value; the stated shares among the values that are there, or the tempered ones. `bounded`
    adds up to the fraction of all tokens with no value beyond what it has."""
    if target is None:
        wanted = sums.withColumn("g", F.when(F.col("s") > 0, F.pow("s", F.lit(power))).otherwise(0.0))
    else:
        table = sums.sparkSession.createDataFrame([(str(k), float(v)) for k, v in target.items()], "k string, g double")
        wanted = sums.join(table, F.col(key) == F.col("k"), "left").withColumn("g", F.when(F.col("s") > 0, F.coalesce("g", F.lit(0.0))).otherwise(0.0)).drop("k")
    wanted = materialise(wanted, "wanted")
    lifted = wanted.agg(F.sum("g")).first()[0] or 1.0
    # The factor grows until no further value runs out of tokens; each step is exact for those that have by then.
    factor = 0.0
    while True:
        out = f"{factor!r}d * g >= s"
        full, open_ = wanted.agg(F.sum(F.expr(f"if({out}, s, 0)")), F.sum(F.expr(f"if({out}, 0, g)"))).first()
        if not open_ or (step := (fraction * total - full) / open_) <= factor * (1 + 1e-12):
            break
        factor = float(step)
    return wanted.select(key, (F.col("g") / lifted * total).alias("goal"), F.expr(f"least(double(s), {factor!r}d * g)").alias("bounded"))


def calibrated(
    docs: DataFrame, power: float = 0.7, fraction: float = 0.5, source: str = "source", lang: str = "lang", text: str = "text", cells_most: int = CELLS, seed: int = 11,
    targets: Mapping[str, Mapping[str, float]] | None = None, topic_of: Column | None = None, tolerance: float = 1e-9,
) -> DataFrame:
    """`docs` with mix_tokens, mix_topic, mix_weight, mix_probability and mix_kept. `targets` has the shares wanted by `source`, `lang` and
    `topic` (value: share; they needn't sum to 1); margins that it doesn't name have their own tempered token shares. `topic_of` is the
    topic, by default the form by length; raking ends where no weight changes by more than `tolerance` of the largest."""
    spark = docs.sparkSession
    keys = {"mix_source": "source", "mix_lang": "lang", "mix_topic": "topic"}
    none = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    marked = docs.withColumn("mix_tokens", n_tokens(text))
    marked = marked.withColumns({"mix_source": none(F.col(source)), "mix_lang": none(F.col(lang)), "mix_topic": topic(F.col("mix_tokens")) if topic_of is None else none(topic_of)})
    cells = materialise(marked.groupBy(*keys).agg(F.sum("mix_tokens").alias("mix_tokens")), "cells")
    total = float(cells.agg(F.sum("mix_tokens")).first()[0] or 0)
    goals = {k: materialise(_goals(cells.groupBy(k).agg(F.sum("mix_tokens").alias("s")), k, total, power, (targets or {}).get(name), fraction), "goals") for k, name in keys.items()}
    if cells.count() <= cells_most:
        got = cells.orderBy(*keys).toPandas()
        tokens = got["mix_tokens"].to_numpy(float)
        codes, wanted, bounded = [], [], []
        for k, goal in goals.items():
            code, names = got[k].factorize()
            share = {r[k]: (r["goal"], r["bounded"]) for r in goal.collect()}
            codes.append(code)
            wanted.append(np.array([share[n][0] for n in names]))
            bounded.append(np.array([share[n][1] for n in names]))
        w = rake(tokens, codes, wanted, tolerance=tolerance)
        p = rake(tokens, codes, bounded, fraction * w, 1.0, tolerance=tolerance) if fraction < 1 else np.ones(len(w))
        table = pa.table({**{k: pa.array(got[k], pa.string()) for k in keys}, "mix_weight": pa.array(w, pa.float64()), "mix_probability": pa.array(p, pa.float64())})
        known = F.broadcast(spark.createDataFrame(table))
    else:
        known = _rake_table(cells.withColumn("mix_weight", F.lit(1.0)), {k: g.select(k, "goal") for k, g in goals.items()}, "mix_weight", None, tolerance=tolerance)
        known = known.withColumn("mix_probability", F.expr(f"least(1d, {fraction!r}d * mix_weight)") if fraction < 1 else F.lit(1.0))
        if fraction < 1:
            known = _rake_table(known, {k: g.select(k, F.col("bounded").alias("goal")) for k, g in goals.items()}, "mix_probability", 1.0, tolerance=tolerance)
        known = known.drop("mix_tokens")
    uniform = F.expr(f"shiftrightunsigned(xxhash64({seed}, doc_id, `{text}`), 11) / {float(1 << 53)!r}d")
    return marked.join(known, list(keys)).withColumn("mix_kept", uniform < F.col("mix_probability"))


def sampled(docs: DataFrame, **options) -> DataFrame:
    """The kept rows of `docs`, with its own columns, those whose names begin with `mix_` included."""
    aside = {c: f"aside_{c}" for c in docs.columns if c.lower().startswith("mix_")}
    kept = calibrated(docs.withColumnsRenamed(aside), **options).where("mix_kept")
    return kept.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))
