"""Arrays that grow with the input, as files that Spark copies to every executor once.

A process maps such a file in place of loading it, so the workers of an executor share one copy, and what isn't looked up
needn't be in memory. The driver writes a file in chunks, so it never holds one whole."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Shipped:
    """The name of a shipped array; empty arrays have none."""

    name: str
    dtype: str
    columns: int

    def array(self) -> np.ndarray:
        return _mapped(self.name, self.dtype, self.columns)


@lru_cache(64)
def _mapped(name: str, dtype: str, columns: int) -> np.ndarray:
    flat = np.asarray(np.memmap(os.path.abspath(SparkFiles.get(name)), dtype, "r")) if name else np.empty(0, dtype)
    return flat.reshape(-1, columns) if columns > 1 else flat


class Writer:
    """One array from chunks, in their order, each of shape (n,) or (n, columns)."""

    def __init__(self, dtype: str, columns: int = 1):
        self.dtype, self.columns = dtype, columns
        self.path = f"{tempfile.mkdtemp(prefix='lavra-')}/{uuid.uuid4().hex}.bin"
        self.file = open(self.path, "wb")

    def add(self, some: np.ndarray) -> None:
        np.ascontiguousarray(some, self.dtype).tofile(self.file)

    def ship(self, spark: SparkSession) -> Shipped:
        self.file.close()
        if not os.path.getsize(self.path):
            return Shipped("", self.dtype, self.columns)
        spark.sparkContext.addFile(self.path)
        return Shipped(os.path.basename(self.path), self.dtype, self.columns)


def ship_array(spark: SparkSession, chunks: Iterable[np.ndarray], dtype: str, columns: int = 1) -> Shipped:
    out = Writer(dtype, columns)
    for some in chunks:
        out.add(some)
    return out.ship(spark)
