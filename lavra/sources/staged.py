"""Text files that are published together: a sink of events by line and of CSV files by batch, as a Python data source.

Each task writes under names of its own below a folder of the run; what tasks have written gets its final names when all of them
succeeded, and a list of the run's files is published last, by a rename. A reader takes the files that lists name. Where a task
fails, the run's folder goes and readers see what they saw before; a task that runs twice counts once. A run appends to those
before it; `mode("overwrite")` publishes a list that begins anew.

Options: `path`, `format` (`jsonl`, or `csv` with a header and a byte order mark, as spreadsheets read it), `by` (a column whose
values have files of their own; its value is not written) and `name`, a file's name with `{}` for that value. Values are
written as they are: null is null in JSON and nothing in CSV, nested ones are JSON text in CSV. Folders are reached by
`pyarrow.fs`."""

from __future__ import annotations

import csv
import io
import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

LISTS = "_lists"


def folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    """(staged path, value of `by`, rows) of the files of a task."""

    files: list[tuple[str, str, int]]


class StagedWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.kind, self.by = options["path"], options.get("format", "jsonl"), options.get("by")
        self.name, self.overwrite, self.run = options.get("name", "part-{}"), overwrite, options.get("run") or uuid.uuid4().hex

    def _line(self, row: dict, head: bool = False) -> bytes:
        if self.kind == "jsonl":
            return (json.dumps(row, ensure_ascii=False, default=str) + "\n").encode()
        out = io.StringIO()
        plain = lambda v: "" if v is None else json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, list | dict) else v
        csv.writer(out, lineterminator="\n").writerow(row if head else [plain(v) for v in row.values()])
        return out.getvalue().encode()

    def write(self, iterator) -> Staged:
        system, root = folder(self.path)
        stage = f"{root}/_staging/{self.run}"
        system.create_dir(stage, recursive=True)
        sinks, counts = {}, {}
        try:
            for batch in iterator:
                for at in range(0, batch.num_rows, 1024):
                    for row in batch.slice(at, 1024).to_pylist():
                        key = str(row.pop(self.by)) if self.by else ""
                        if key not in sinks:
                            at_ = f"{stage}/{uuid.uuid4().hex}"
                            sinks[key] = (at_, system.open_output_stream(at_))
                            counts[key] = 0
                            if self.kind == "csv":
                                sinks[key][1].write(b"\xef\xbb\xbf" + self._line(row, head=True))
                        sinks[key][1].write(self._line(row))
                        counts[key] += 1
        finally:
            for _, sink in sinks.values():
                sink.close()
        return Staged([(at, key, counts[key]) for key, (at, _) in sinks.items()])

    def commit(self, messages) -> None:
        system, root = folder(self.path)
        listed, seen = [], {}
        for at, key, rows in sorted((f for m in messages if m for f in m.files), key=lambda f: (f[1], f[0])):
            n = seen[key] = seen.get(key, -1) + 1
            base, dot, ending = self.name.format(key or self.run[:12]).partition(".")
            name = f"{base}{f'-{n:05d}' if n or not self.by else ''}{dot}{ending}" if dot else f"{base}{f'-{n:05d}' if n or not self.by else ''}.{self.kind}"
            if system.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                name = f"{self.run[:12]}-{name}"  # an earlier run's file stays until its list goes
            system.move(at, f"{root}/{name}")
            listed.append({"file": name, "by": key, "rows": rows})
        before = [] if self.overwrite else runs(self.path)
        system.create_dir(f"{root}/{LISTS}", recursive=True)
        draft = f"{root}/{LISTS}/.{self.run}"
        with system.open_output_stream(draft) as out:
            out.write(json.dumps({"n": max((r["n"] for r in runs(self.path)), default=-1) + 1, "run": self.run, "begins": self.overwrite or not before, "files": listed}).encode())
        system.move(draft, f"{root}/{LISTS}/{self.run}.json")
        self._clear(system, root)

    def abort(self, messages) -> None:
        self._clear(*folder(self.path))

    def _clear(self, system, root: str) -> None:
        if system.get_file_info(f"{root}/_staging/{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_staging/{self.run}")


class StagedFiles(DataSource):
    @classmethod
    def name(cls):
        return "staged"

    def schema(self):
        return "value string"

    def writer(self, schema, overwrite):
        return StagedWriter(self.options, overwrite)


def runs(path: str) -> list[dict]:
    """The published lists, in order, from the last one that begins anew."""
    system, root = folder(path)
    if system.get_file_info(f"{root}/{LISTS}").type == fs.FileType.NotFound:
        return []
    found = []
    for at in system.get_file_info(fs.FileSelector(f"{root}/{LISTS}")):
        if at.base_name.endswith(".json") and not at.base_name.startswith("."):
            with system.open_input_stream(at.path) as source:
                found.append(json.loads(source.read()))
    found.sort(key=lambda r: r["n"])
    first = max((i for i, r in enumerate(found) if r["begins"]), default=0)
    return found[first:]


def files(path: str, by: str | None = None) -> list[str]:
    """The published files, or those of one value of `by`."""
    return [f"{path}/{f['file']}" for r in runs(path) for f in r["files"] if by is None or f["by"] == by]


def write(df: DataFrame, path: str, overwrite: bool = False, **options) -> None:
    """Publishes the rows as files below `path`; with `by`, rows of a value meet in one task first, so that it has one file a run
    where the value is a batch or as small."""
    df.sparkSession.dataSource.register(StagedFiles)
    rows = df.repartition(options["by"]) if options.get("by") else df
    rows.write.format("staged").mode("overwrite" if overwrite else "append").options(run=uuid.uuid4().hex, **options).save(path)


def append_events(events: DataFrame, path: str) -> None:
    """One line of JSON an event, added to those before; a failed run adds none."""
    write(events, path, format="jsonl", name="events-{}")


def write_batches(rows: DataFrame, path: str, by: str = "batch_id", name: str = "lote_{}_classificacoes.csv", overwrite: bool = False) -> None:
    """A CSV file a batch."""
    write(rows, path, overwrite, format="csv", by=by, name=name)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The events of all published runs."""
    from lavra.sources.files import empty, jsonl

    found = files(path)
    return jsonl(spark, found, schema) if found else empty(spark, schema)


def read_batches(spark: SparkSession, path: str, schema: str, by: str | None = None) -> DataFrame:
    """The rows of all published batches, or of one."""
    from lavra.sources.files import empty

    found = files(path, by)
    read = spark.read.schema(schema).option("header", "true").options(multiLine="true", escape='"', lineSep="\n", encoding="UTF-8")
    return read.csv(found) if found else empty(spark, schema)
