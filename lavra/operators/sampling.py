"""Dense ranks over the whole of a table, stratified samples, batches and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.runtime import materialise

BUCKETS = 1 << 16


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Row numbers from 1 in the order of `order` without gathering the table in one task: the rows are dealt to ranges and
    written once (a second dealing could draw other bounds); each range begins where the counts of those before it end."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialise(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_part").count()  # a row a partition
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_n", within).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_n") + F.col("_before")).drop("_part", "_n", "_before")


def batches(df: DataFrame, order: list[str], size: int = 500, most: int | None = None) -> DataFrame:
    """batch_id from 1 by `size` rows in order; `most` keeps the first batches."""
    out = numbered(df, order, "_row").withColumn("batch_id", (F.floor((F.col("_row") - 1) / size) + 1).cast("long")).drop("_row")
    return out if most is None else out.where(F.col("batch_id") <= most)


def stratified(df: DataFrame, stratum: Column, key: str, fraction: float = 0.15, seed: int = 42) -> DataFrame:
    """(key, stratum, sampled): one row of each stratum first, quotas by share next, the rest by hash order, max(1, round(n * fraction)) in all.
    Orders are by a hash of the key, so the sample doesn't hang on partitions. The hashes are counted in buckets; only the rows
    of the bucket in which a stratum's quota ends are ranked."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    marked = df.select(F.col(key), stratum.alias("stratum"), hashed.alias("h")).withColumn("bucket", F.conv(F.substring("h", 1, 4), 16, 10).cast("int"))
    sizes = materialise(marked.groupBy("stratum", "bucket").agg(F.count("*").alias("n")), "buckets")
    # A row a stratum, in order; null is the first.
    known = sizes.groupBy("stratum").agg(F.sum("n").alias("of")).orderBy("stratum").collect()
    total = sum(r["of"] for r in known)
    target = max(1, round(total * fraction))
    firsts = [int(i < target) for i in range(len(known))]
    quotas, taken = [], 0
    for i, r in enumerate(known):
        # What the share asks for, but no more than is left when each stratum behind has its first.
        asked = max(firsts[i], round(r["of"] / max(1, total) * target))
        quotas.append(min(r["of"], max(firsts[i], min(asked, max(0, target - taken) - sum(firsts[i + 1 :])))))
        taken += asked
    kind = marked.schema["stratum"].dataType
    spark, form = df.sparkSession, T.StructType([T.StructField("stratum", kind), T.StructField("quota", T.LongType()), T.StructField("border", T.IntegerType()), T.StructField("room", T.LongType())])
    quota = F.broadcast(spark.createDataFrame([(r["stratum"], q, 0, 0) for r, q in zip(known, quotas)], form).select("stratum", "quota"))
    run = F.sum("n").over(Window.partitionBy("stratum").orderBy("bucket"))  # at most BUCKETS rows a stratum
    upto = sizes.withColumn("upto", run).withColumnRenamed("stratum", "_s").join(quota, F.col("_s").eqNullSafe(F.col("stratum"))).where("upto > quota")
    ends = upto.groupBy("stratum").agg(F.min_by(F.struct("bucket", (F.col("quota") - F.col("upto") + F.col("n")).alias("room")), "bucket").alias("b"))
    held = {r["stratum"]: r["b"] for r in ends.collect()}  # a row a stratum
    bounds = [(r["stratum"], q, *(held[r["stratum"]] if r["stratum"] in held else (BUCKETS, 0))) for r, q in zip(known, quotas)]
    cut = F.broadcast(spark.createDataFrame(bounds, form).withColumnRenamed("stratum", "_s"))
    rows = marked.join(cut, F.col("stratum").eqNullSafe(F.col("_s"))).drop("_s")
    ranked = rows.where("bucket = border").withColumn("r", F.row_number().over(Window.partitionBy("stratum").orderBy("h", key)))
    out = rows.where("bucket <> border").select(key, "stratum", "h", (F.col("bucket") < F.col("border")).alias("sampled"))
    out = out.unionByName(ranked.select(key, "stratum", "h", (F.col("r") <= F.col("room")).alias("sampled")))
    short = max(0, target - sum(quotas))
    if not short:
        return out.drop("h")
    fill = out.where("not sampled").orderBy("h", key).limit(short).select(key, F.lit(True).alias("filled"))  # less than a row a stratum
    return out.join(fill, key, "left").select(key, "stratum", (F.col("sampled") | F.coalesce("filled", F.lit(False))).alias("sampled"))


def split(docs: DataFrame, sampled: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is in the sample, the others)."""
    names = sampled.select(key).distinct()
    return docs.join(names, key, "left_semi"), docs.join(names, key, "left_anti")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def recurrence(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """How often each row's key has come up to and with it, in order; a key that fills many partitions is not gathered."""
    rows = numbered(df, [key, *order], "_at")
    first = rows.groupBy(key).agg(F.min("_at").alias("_first"))
    return rows.join(first.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).withColumn(name, (F.col("_at") - F.col("_first") + 1).cast("int")).drop("_key", "_at", "_first")


def new_rows(rows: DataFrame, known: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows whose key isn't known, one a key."""
    return first_by(rows.join(known.select(*keys).distinct(), keys, "left_anti"), keys, order)


def consume(rows: DataFrame, inventory: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`rows` with occurrence (of its key, in order, from 1), held (rows of the key in the inventory), matched (an item of the inventory is
    left for it: each is taken once) and known (the inventory has the key at all). Null keys match null keys. The inventory is
    counted, not gathered, and a key of any size is numbered over many tasks."""
    own = recurrence(rows, key, order, "occurrence")
    counts = inventory.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_held"))
    held = F.coalesce("_held", F.lit(0)).cast("long")
    out = own.join(counts, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("held", held).drop("_key", "_held")
    return out.withColumns({"matched": F.col("occurrence") <= F.col("held"), "known": F.col("held") > 0})


def balance(rows: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    """(key, matched, surplus, missing): how many items of each key both sides share, and how many only the inventory or only the rows
    have; counts of both sides are summed before they meet."""
    sides = rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("held", F.lit(0).cast("long"))
    sides = sides.unionByName(inventory.groupBy(key).agg(F.count("*").alias("held")).withColumn("n", F.lit(0).cast("long")))
    sums = sides.groupBy(key).agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    return sums.select(key, F.least("n", "held").alias("matched"), F.greatest(F.col("held") - F.col("n"), F.lit(0)).alias("surplus"), F.greatest(F.col("n") - F.col("held"), F.lit(0)).alias("missing"))
