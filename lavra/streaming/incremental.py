"""The incremental loop as a stream: each micro-batch is classified by the bank's current version, rows are written under
the batch's own id (a batch that is repeated after a failure overwrites itself), and residuals go to a reviewer whose
rules are published as the bank's next version. The version of a batch's number is the one that it is classified by, so
that a restart goes on with all that was learned. What must outlast a batch is in written tables: banks, rows, counts of
rare signatures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lavra.operators import rules as R
from lavra.runtime import materialise
from lavra.sources import files

#: (residual rows, batch id) -> learned (kind, label, pattern, source, title).
Reviewer = Callable[[DataFrame, int], DataFrame]


def _bank(spark: SparkSession, root: str, version: int) -> tuple[DataFrame, int]:
    """The bank's newest version up to `version`."""
    at = max(v for v in files.versions(spark, root) if v <= version)
    return files.load_bank(spark, root, at), at


def run_batch(batch: DataFrame, batch_id: int, root: str, review: Reviewer | None = None, threshold: float = 0.85, budget: int | None = None) -> None:
    """Classifies one batch into root/rows/batch_id=N; publishes what its reviewer learned as version batch_id + 1. `budget` residuals
    of a batch are reviewed; the rest stays `residual_pending`."""
    spark = batch.sparkSession
    bank, _ = _bank(spark, f"{root}/bank", batch_id)
    rules = [tuple(r[c] for c in ("kind", "label", "pattern", "weight", "source", "uses", "examples", "pos")) for r in bank.orderBy("pos").collect()]
    rows = materialise(R.classify(batch, rules, threshold), "batch")
    left = rows.where("status = 'regex_below_threshold'").select("doc_id")
    seen = left if budget is None else left.orderBy("doc_id").limit(budget)  # a budget of one batch
    if review is not None and budget is not None:
        rows = rows.join(seen.withColumn("_seen", F.lit(True)), "doc_id", "left")
        rows = rows.withColumn("status", F.when((F.col("status") == "regex_below_threshold") & F.col("_seen").isNull(), "residual_pending").otherwise(F.col("status"))).drop("_seen")
    rows.write.mode("overwrite").parquet(f"{root}/rows/batch_id={batch_id}")
    if review is None or batch_id + 1 in files.versions(spark, f"{root}/bank"):
        return
    learned = materialise(review(batch.join(seen, "doc_id", "left_semi"), batch_id), "learned")
    if not learned.isEmpty():
        files.publish_bank(R.upsert(bank, learned), f"{root}/bank", batch_id + 1)


def append_candidates(rows: DataFrame, root: str, batch_id: int) -> None:
    """A batch's theme candidates, added to those of the batches before; a repeated batch takes the place of its first run."""
    rows.write.mode("overwrite").parquet(f"{root}/batch_id={batch_id}")


def stream(source: DataFrame, rules: list, root: str, review: Reviewer | None = None, **options):
    """Runs all that is available and returns the query. Batch 0 begins with `rules`, unless an earlier run left a bank."""
    spark = source.sparkSession
    if not files.versions(spark, f"{root}/bank"):
        files.publish_bank(R.bank(spark, rules), f"{root}/bank", 0)
    query = source.writeStream.foreachBatch(lambda batch, n: run_batch(batch, n, root, review, **options)).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def unseen(batch: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key hasn't been processed."""
    return batch.join(done.select(key).distinct(), key, "left_anti")


def metrics(rows: DataFrame) -> DataFrame:
    """Documents, accepted ones and their rate by batch."""
    accepted = F.count_if(F.col("status") != "regex_below_threshold")
    return rows.groupBy("batch_id").agg(F.count("*").alias("docs"), accepted.alias("accepted"), F.round(accepted / F.count("*"), 6).alias("rate"))


def recurrences(observed: DataFrame, signature: str = "signature", order: str = "pos", never: str = "operacao_sem_contexto", at: int = 2) -> DataFrame:
    """(signature, pos, signature_count, promoted) of a stream of observations, their count of recurrences kept as state by signature."""
    kind = observed.schema[order].dataType.simpleString()

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        places = sorted(p for f in frames for p in f["pos"])
        state.update((seen + len(places),))
        n = [seen + i for i in range(1, len(places) + 1)]
        yield pd.DataFrame({"signature": key[0], "pos": places, "signature_count": n, "promoted": [i >= at and key[0] != never for i in n]})

    rows = observed.select(F.col(signature).alias("signature"), F.col(order).alias("pos"))
    return rows.groupBy("signature").applyInPandasWithState(count, f"signature string, pos {kind}, signature_count int, promoted boolean", "seen long", "append", GroupStateTimeout.NoTimeout)


def running_totals(rows: DataFrame) -> DataFrame:
    """Documents, accepted ones and their rate of all that a stream has brought, for output mode `complete`."""
    accepted = F.count_if(F.col("status") != "regex_below_threshold")
    return rows.groupBy().agg(F.count("*").alias("docs"), accepted.alias("accepted"), F.round(accepted / F.count("*"), 6).alias("rate"))


def first_seen(rows: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Rows of a stream whose key hasn't come within `late` of event time: the state of a key goes when the watermark has passed it,
    so that it holds the keys of that time and not all keys. A repeat that comes later counts as new."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


#: What is added up over a run: those of `reports.batch_measures` that are sums.
MEASURES = (
    "docs", "regex_accepted", "regex_residual", "llm_processed", "attempted", "classified", "quarantined", "new_theme_candidates", "rare_news",
    "errors", "learned_rules", "prompt_tokens", "completion_tokens", "tokens",
)
LANES = 16


def measured(rows: DataFrame) -> DataFrame:
    """(lane, *MEASURES) of rows as `reports.batch_measures` takes them: what each row adds, and the lane that it is added up in."""
    seen, ok = F.col("decision").isNotNull(), F.col("decision").isNotNull() & (F.col("decision") != "error")
    taken, said = F.col("status") != "regex_below_threshold", lambda x: F.coalesce(F.col("decision") == x, F.lit(False))
    one = {
        "docs": F.lit(True), "regex_accepted": taken, "regex_residual": ~taken, "llm_processed": ok, "attempted": seen, "classified": said("classificar"), "quarantined": said("quarentena"),
        "new_theme_candidates": said("novo_tema_candidato"), "rare_news": said("classificar") & F.coalesce(F.col("label") == "noticias_raras", F.lit(False)), "errors": said("error"),
    }
    many = {"learned_rules": "learned", "prompt_tokens": "prompt_tokens", "completion_tokens": "completion_tokens", "tokens": "total_tokens"}
    own = {**{k: v.cast("long") for k, v in one.items()}, **{k: F.coalesce(F.col(c), F.lit(0)).cast("long") for k, c in many.items()}}
    lane = F.pmod(F.xxhash64(*rows.columns), F.lit(LANES)).cast("int")
    return rows.select(lane.alias("lane"), *(own[m].alias(m) for m in MEASURES))


class _Totals(StatefulProcessor):
    """The sums of a lane, kept as state; an earlier run's sums are what it begins with."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sums", ", ".join(f"{m} long" for m in MEASURES))

    def _held(self) -> list[int]:
        return list(self.state.get()) if self.state.exists() else [0] * len(MEASURES)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.state.update(tuple(int(initialState[m].sum()) for m in MEASURES))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        for some in rows:
            held = [a + int(some[m].sum()) for a, m in zip(held, MEASURES)]
        self.state.update(tuple(held))
        yield pd.DataFrame([(key[0], *held)], columns=["lane", *MEASURES])

    def close(self) -> None:
        pass


def total_stream(rows: DataFrame, root: str, before: DataFrame | None = None):
    """Adds up the measures of a stream of rows below `root`, beginning with those of an earlier run (`before`, one row of `MEASURES`), and
    returns the query. Sums are kept by lane, so that no one task gets all rows; `totals` adds the lanes up."""
    form = "lane int, " + ", ".join(f"{m} long" for m in MEASURES)
    first = None if before is None else before.select(F.lit(0).alias("lane"), *(F.col(m).cast("long") for m in MEASURES))
    sums = measured(rows).groupBy("lane").transformWithStateInPandas(_Totals(), form, "Update", "None", None if first is None else first.groupBy("lane"))
    if first is not None:  # a lane's first sums, where no row comes to it
        first.withColumn("batch", F.lit(-1).cast("long")).write.mode("overwrite").parquet(f"{root}/lanes/batch_id=-1")

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{root}/lanes/batch_id={n}")

    conf, name = rows.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    old = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # keyed processors need it
    try:
        query = sums.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(name, old)
    return query


def totals(spark: SparkSession, root: str) -> DataFrame:
    """One row of all that `total_stream` has added up: the last sums of each lane, and the rates of the whole."""
    lanes = spark.read.parquet(f"{root}/lanes").groupBy("lane").agg(F.max_by(F.struct(*MEASURES), "batch").alias("s"))
    out = lanes.agg(*(F.coalesce(F.sum(f"s.{m}"), F.lit(0)).alias(m) for m in MEASURES))
    mean = F.when(F.col("llm_processed") > 0, F.round(F.col("tokens") / F.col("llm_processed"), 4)).otherwise(0.0)
    return out.withColumns({"avg_tokens": mean, "rate": F.when(F.col("docs") > 0, F.round(F.col("regex_accepted") / F.col("docs"), 6)).otherwise(0.0)})


def windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and type; on a stream the watermark bounds the state."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    return held.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
