"""The mutation log beside an immutable index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecmill.operators.order import numbered
from vecmill.operators.search import knn, score

INSERT, DELETE = 1, 2
SCHEMA = "seq long, op byte, id long, vector array<float>"


def live_view(log: DataFrame) -> DataFrame:
    """(seq, id, vector) of the inserts that no later delete of their id undoes; repeated ids all stay."""
    gone = log.where(F.col("op") == DELETE).groupBy("id").agg(F.max("seq").alias("gone"))
    kept = log.where(F.col("op") == INSERT).join(gone, "id", "left")
    return kept.where(F.col("gone").isNull() | (F.col("gone") < F.col("seq"))).select("seq", "id", "vector")


def merge_results(base: DataFrame, delta: DataFrame, k: int, upsert: bool = False) -> DataFrame:
    """The ``k`` best of two results (query_id, id, distance); on the same id the base wins (with ``upsert`` the delta).

    Of a repeated id the best stays. Ties go to the preferred side, then the smaller id.
    """
    both = base.select("query_id", "id", "distance", F.lit(int(upsert)).alias("side")).unionByName(
        delta.select("query_id", "id", "distance", F.lit(int(not upsert)).alias("side"))
    )
    one = both.groupBy("query_id", "id").agg(F.min(F.struct("side", "distance")).alias("m")).select("query_id", "id", "m.side", "m.distance")
    order = Window.partitionBy("query_id").orderBy("distance", "side", "id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", score(F.col("distance")).alias("score"), "distance")


class DeltaBuffer:
    """An append-only log of inserts and deletes as a Parquet table; opening one replays what is there.

    Each append is a folder ``batch=...`` of its own, whoever makes it, and takes its
    numbers from what the log holds then. Several handles may share a log, if one
    appends at a time. An append is a Spark job: many rows go by ``insert_many``.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int, flush_threshold: int = 10_000):
        self.spark, self.path, self.dim, self.flush_threshold = spark, path, dim, flush_threshold

    def log(self) -> DataFrame:
        """(seq, op, id, vector, batch) of all that was appended."""
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(f"{SCHEMA}, batch string").parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{SCHEMA}, batch string")

    def _next(self, but: str | None = None) -> int:
        """The number after all in the log; ``but``: of a batch that is written again."""
        log = self.log() if but is None else self.log().where(F.col("batch") != but)
        last = log.agg(F.max("seq")).first()[0]
        return 0 if last is None else last + 1

    def _append(self, rows: list[tuple]) -> None:
        start = self._next()
        made = self.spark.createDataFrame([(start + n, *r) for n, r in enumerate(rows)], SCHEMA)
        made.coalesce(1).write.parquet(f"{self.path}/batch={uuid.uuid4().hex}")

    def insert_many(self, pairs) -> None:
        rows = [(INSERT, int(i), [float(x) for x in v]) for i, v in pairs]
        if any(len(r[2]) != self.dim for r in rows):
            raise ValueError(f"every vector needs {self.dim} components")
        if rows:
            self._append(rows)

    def insert(self, row_id: int, vector) -> None:
        self.insert_many([(row_id, vector)])

    def delete(self, row_id: int) -> bool:
        """Undoes all live inserts of the id; False, and nothing is logged, if there are none. The base is untouched."""
        if self.live().where(F.col("id") == int(row_id)).isEmpty():
            return False
        self._append([(DELETE, int(row_id), None)])
        return True

    def live(self) -> DataFrame:
        return live_view(self.log())

    def size(self) -> int:
        return self.live().count()

    def needs_flush(self) -> bool:
        return self.size() >= self.flush_threshold

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return knn(self.live(), queries, k).withColumn("score", score(F.col("distance")))

    def backup(self, path: str) -> None:
        """The live entries alone."""
        self.live().select("seq", F.lit(INSERT).cast("byte").alias("op"), "id", "vector").write.mode("overwrite").parquet(path)

    @classmethod
    def restore(cls, spark: SparkSession, backup: str, path: str, dim: int, **options) -> DeltaBuffer:
        made = cls(spark, path, dim, **options)
        made.clear()
        spark.read.schema(SCHEMA).parquet(backup).write.parquet(f"{path}/batch={uuid.uuid4().hex}")
        return made

    def clear(self) -> None:
        """Empties the log."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drain(self, index_path: str, **options):
        """Compiles the live entries to an index, then empties the log."""
        from vecmill.sources.index import compile_index

        made = compile_index(self.spark, index_path, self.live().select("id", "vector"), **options)
        self.clear()
        return made

    def ingest(self, stream: DataFrame, checkpoint: str, order: str | None = None):
        """Starts appending a stream of (op, id, vector); a batch that runs again is written once, as its own folder.

        Rows of a batch are numbered after all that the log holds, by the column
        ``order`` if one is named, else as they come in its partitions: an insert after
        a delete of its id stays live.
        """
        source = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex

        def write(batch: DataFrame, number: int) -> None:
            name = f"{source}-{number}"
            start = self._next(but=name)
            # ascending by partition and place within it; gaps don't matter
            place = F.monotonically_increasing_id()
            rows = numbered(batch, F.col(order), name="place") if order else batch.withColumn("place", place)
            rows = rows.select((F.col("place") + F.lit(start)).cast("long").alias("seq"), F.col("op").cast("byte").alias("op"), "id", "vector")
            rows.write.mode("overwrite").parquet(f"{self.path}/batch={name}")

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def search_merged(index, buffer: DeltaBuffer, queries: DataFrame, k: int, upsert: bool = False) -> DataFrame:
    """The index's and the log's results, merged on the squared distance."""
    base = index.search(queries, k)
    return merge_results(base, buffer.search(queries, k), k, upsert)
