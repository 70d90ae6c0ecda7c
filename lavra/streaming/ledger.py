"""Several tables written under one batch id as one transaction.

A batch's tables go to folders of their own, a new one for each attempt; then a marker that names these folders is written beside
the batch and renamed to its place. Readers take the folders that markers name: a batch that was cut short between two tables
shows none of them, one that is run again after its marker writes nothing, and what lost attempts have left is deleted by
`vacuum`. A table that doesn't change in a batch is named again in the marker and not written again (`carry`). Markers are
small files, one a batch; folders are reached by Spark's own file systems."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

COMMITS = "_commits"


class Ledger:
    """The tables below `root`, committed by batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        system, at = self._at(path)
        return [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []

    def batches(self) -> list[int]:
        """The batches that are committed, in order."""
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.root}/{COMMITS}") if n.endswith(".json") and not n.startswith((".", "_")))

    def marker(self, batch: int) -> dict[str, str]:
        """The folder of each table of a batch."""
        system, at = self._at(f"{self.root}/{COMMITS}/{batch}.json")
        source = system.open(at)
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def commit(self, batch: int, tables: dict[str, DataFrame], carry: dict[str, str] | None = None) -> bool:
        """Writes the tables, then the marker; False, and nothing written, where the batch is committed already."""
        if batch in self.batches():
            return False
        attempt, folders = uuid.uuid4().hex, dict(carry or {})
        for name, rows in tables.items():
            folders[name] = f"{name}/batch={batch}/try={attempt}"
            rows.write.parquet(f"{self.root}/{folders[name]}")
        system, draft = self._at(f"{self.root}/{COMMITS}/.{batch}-{attempt}")
        out = system.create(draft, True)
        try:
            out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
        finally:
            out.close()
        _, place = self._at(f"{self.root}/{COMMITS}/{batch}.json")
        if not system.rename(draft, place):
            raise RuntimeError(f"batch {batch} was committed by another run")
        return True

    def read(self, table: str, before: int | None = None) -> DataFrame | None:
        """The rows of a table in all committed batches (those before `before`); None where no batch has it."""
        paths = list(dict.fromkeys(m[table] for b in self.batches() if (before is None or b < before) and table in (m := self.marker(b))))
        if not paths:
            return None
        return self.spark.read.parquet(*(f"{self.root}/{p}" for p in paths))

    def last(self, table: str, before: int | None = None) -> tuple[DataFrame, str] | None:
        """A table's rows in the last committed batch that has it (before `before`), and their folder."""
        for b in reversed(self.batches()):
            if (before is None or b < before) and table in (m := self.marker(b)):
                return self.spark.read.parquet(f"{self.root}/{m[table]}"), m[table]
        return None

    def vacuum(self) -> int:
        """Deletes the folders that no marker names; how many there were. Not while a batch is being written."""
        held, gone = {p for b in self.batches() for p in self.marker(b).values()}, 0
        for table in self._names(self.root):
            if table.startswith(("_", ".")):
                continue
            for batch in self._names(f"{self.root}/{table}"):
                for attempt in self._names(f"{self.root}/{table}/{batch}"):
                    if attempt.startswith("try=") and f"{table}/{batch}/{attempt}" not in held:
                        system, at = self._at(f"{self.root}/{table}/{batch}/{attempt}")
                        gone += bool(system.delete(at, True))
        return gone
