"""File sources and sinks with stated schemas and stated handling of bad records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX = "offset int, page_number int, item_index int, categoria string, titulo string, subtitulo string, data_publicacao string, hora_publicacao string, publicado_em string, tipo_conteudo string, tags string, total_tags int, link string"
MANIFEST = "link string, markdown_path string, status string, titulo_extraido string, subtitulo_extraido string, publicado_em_extraido string, atualizado_em_extraido string, tags_extraidas string, erro string"

#: A quote is escaped by a quote, which needs no escape of its own (Spark would take the character 0 for one).
QUOTED = {"escape": '"', "charToEscapeQuoteEscaping": '"', "lineSep": "\n"}


def markdown(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(arquivo, text) of *.md below `path`; `most` keeps the first by name. A folder without any is an error."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("arquivo"), F.col("value").alias("text"))
    if files.isEmpty():
        raise FileNotFoundError(f"no *.md below {path}")
    return files if most is None else files.orderBy("arquivo").limit(most)


def one_object(line: Column) -> Column:
    """Whether a line is one JSON object and nothing else. A reader stops behind the first value, so the line is read within an array
    and within an object: what stands behind a value can't fit both."""
    plain = {"allowSingleQuotes": "false"}
    inside = F.from_json(F.concat(F.lit("["), line, F.lit("]")), "array<map<string,string>>", plain)
    under = F.from_json(F.concat(F.lit('{"w":'), line, F.lit("}")), "map<string,map<string,string>>", plain)
    return F.coalesce((F.size(inside) == 1) & F.get(inside, F.lit(0)).isNotNull() & F.element_at(under, F.lit("w")).isNotNull(), F.lit(False))


def jsonl(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    """The objects of a file of lines, blank lines left out. Strict reading fails at a line that isn't one object of this schema, text
    behind the object included; otherwise such lines are left out."""
    fields = T._parse_datatype_string(schema)
    form = T.StructType([*fields.fields, T.StructField("_line", T.StringType())])
    options = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_line"}
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("r", F.when(one_object(F.col("value")), F.from_json("value", form, options)))
    sound = F.col("r").isNotNull() & F.col("r._line").isNull()
    if strict:
        rows = rows.withColumn("r", F.when(sound, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 200))).cast(form)))
    else:
        rows = rows.where(sound)
    return rows.select(*(F.col("r").getField(f.name).alias(f.name) for f in fields.fields))


def latest(rows: DataFrame, key: str, line: str) -> DataFrame:
    """Of each key the last record, at the place of its first one; blank keys go. Records of a key are pre-aggregated, not gathered."""
    kept = [c for c in rows.columns if c != line]
    best = rows.where(F.trim(key) != "").groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*kept), line).alias("r"), F.min(line).alias("position"))
    return best.select("r.*", "position")


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What `write_csv` wrote. Spark reads an empty text in quotes as null, so it is read as a mark that no text is equal to, and put back."""
    mark = f"empty-{uuid.uuid4().hex}"
    rows = spark.read.schema(schema).option("header", "true").options(multiLine="true", emptyValue=mark, **QUOTED).csv(path)
    return rows.select(*(F.when(F.col(f.name) != mark, F.col(f.name)).when(F.col(f.name) == mark, "").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in rows.schema))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def with_columns(df: DataFrame, schema: str) -> DataFrame:
    """The columns of `schema` in its order; missing ones are null."""
    have = set(df.columns)
    fields = T._parse_datatype_string(schema).fields
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """Nested columns go as JSON text."""
    plain = df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) else F.col(f.name) for f in df.schema))
    writer = plain.write.mode("overwrite").options(header="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", emptyValue='""', **QUOTED)
    (writer.partitionBy(by) if by else writer).csv(path)


def _fs(spark: SparkSession, path: str):
    """(Hadoop file system, path): stores that only Spark reads are reached too."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions that are complete, in order."""
    system, at = _fs(spark, root)
    if not system.exists(at):
        return []
    names = [s.getPath() for s in system.listStatus(at) if s.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in names if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def publish_bank(rules: DataFrame, root: str, version: int) -> str:
    """A bank's version in a folder of its own, complete before anything refers to it; a version that was cut short is written anew."""
    path, spark = f"{root}/v={version}", rules.sparkSession
    if version in versions(spark, root):
        raise FileExistsError(path)
    rules.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(path)
    return path


def load_bank(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of a bank, the last one by default; version 0 is the snapshot that the run began with."""
    known = versions(spark, root)
    at = version if version is not None else known[-1] if known else None
    if at not in known:
        raise FileNotFoundError(f"no version {at} in {root}")
    return spark.read.parquet(f"{root}/v={at}").drop("version")


def append_bank(rules: DataFrame, root: str) -> int:
    """Rules taken into the last version as the next one; its number."""
    from lavra.operators.rules import compact

    spark = rules.sparkSession
    last = versions(spark, root)[-1]
    publish_bank(compact(load_bank(spark, root).unionByName(rules)), root, last + 1)
    return last + 1


def write_document(df: DataFrame, path: str) -> None:
    """One row as one indented JSON document (a result or a report, never a table)."""
    import json

    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a document is one row")
    text = json.dumps(json.loads(rows[0]["j"]), ensure_ascii=False, indent=2) + "\n"
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_profiles(profiles: DataFrame, metadata: DataFrame, root: str) -> None:
    """Theme profiles and what is known of them, as tables."""
    profiles.write.mode("overwrite").parquet(f"{root}/profiles")
    metadata.write.mode("overwrite").parquet(f"{root}/metadata")


def reset(spark: SparkSession, root: str, paths: list[str]) -> list[str]:
    """Deletes those of the paths that exist; a path that isn't below `root` is an error, and nothing is deleted then."""
    _, base = _fs(spark, root)
    inside = f"{base.toUri().getPath().rstrip('/')}/"
    found = [_fs(spark, p) for p in paths]
    for (_, at), p in zip(found, paths):
        parts = at.toUri().getPath()
        if ".." in parts.split("/") or not f"{parts.rstrip('/')}/".startswith(inside) or parts.rstrip("/") + "/" == inside:
            raise ValueError(f"{p} isn't below {root}")
    return [p for (system, at), p in zip(found, paths) if system.exists(at) and system.delete(at, True)]


def learned(lines: DataFrame, most: int | None = None) -> DataFrame:
    """(source_line, arquivo, titulo, fonte_classificacao, rule) of JSON lines (line, value): one row a learned rule (kind, label, pattern);
    bad lines are left out. `most` keeps the first by line."""
    form = "arquivo string, fonte_classificacao string, metadata_extraido struct<titulo: string>, regex_rules_aprendidas array<struct<kind: string, label: string, pattern: string>>"
    rows = lines.select(F.col("line").alias("source_line"), F.from_json("value", form).alias("r")).where("r is not null")
    rows = rows.select("source_line", F.coalesce("r.arquivo", F.lit("")).alias("arquivo"), F.trim(F.coalesce("r.metadata_extraido.titulo", F.lit(""))).alias("titulo"), F.coalesce("r.fonte_classificacao", F.lit("")).alias("fonte_classificacao"), F.posexplode("r.regex_rules_aprendidas").alias("i", "rule"))
    return rows.drop("i") if most is None else rows.orderBy("source_line", "i").limit(most).drop("i")
