"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Bytes of white space in every contract of this subpackage: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: A table whose rows are known to be few and narrow gets a file for each so many of them.
FILE_ROWS = 50_000

_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, one is set if all run on one machine; a cluster's
    machines don't see each other's folders, so that there it raises ValueError.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = context.getCheckpointDir()
        if not named:
            if not (context.master or "").startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
            context.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written to the shared folder, and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns it as read from there.

    ``rows``: a bound of its rows, if these are a few numbers each. They go to a file for
    each FILE_ROWS of the bound at most, instead of one for each partition; each file
    that is written to a local folder starts some processes (chmod) besides.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_at = path
    return made


def drop_tables(*tables: DataFrame) -> None:
    """Deletes tables that ``shared_table`` wrote, once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.__dict__["_written_at"])
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits (public-domain constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word (bytes), kept for the words met lately; it starts anew when large."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes (sorted) of all windows of ``width`` words, or of the whole sequence."""
    n = len(words)
    if not n:
        return words
    w = min(width, n)
    h = np.full(n - w + 1, w, dtype=np.uint64)
    for k in range(w):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : n - w + 1 + k]
    return np.unique(mix64(h))
