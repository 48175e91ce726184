"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept. All but the last return the columns of ``documents``; other columns are left
out. No rows give no rows. Nulls: a null text is empty, a null id is no document's
(its rows are judged by their texts, and are duplicates of nothing); nulls elsewhere
pass through. Rows of one id are one document: they stay or go together as near
duplicates, and are judged one by one elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm.common import drop_tables, shared_table
from vecmill.llm.line_dedup import dedup_lines
from vecmill.llm.mixing import sample_mix
from vecmill.llm.near_dedup import near_duplicates
from vecmill.llm.packing import pack_documents
from vecmill.llm.quality import quality_verdicts

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: An executor runs all stages one after the other, and what their largest batches took of native memory isn't given back.
BATCH_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Python workers get rows in batches of some BATCH_BYTES (a larger row is a batch of its own), in place of up to 10,000 rows.

    Rows are computed when a stage's caller reads them, so the session keeps the setting (``run`` puts it back); a smaller one stays.
    """
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: none with an empty text, as it has too few words."""
    _small_batches(spark)
    return quality_verdicts(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document holds; n_chars is counted anew."""
    return dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates; empty texts are duplicates of nothing."""
    _small_batches(spark)
    groups = near_duplicates(docs)
    dropped = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(shared_table(dropped, "near-duplicates"), "doc_id", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of source, language and topic; those without words go."""
    return sample_mix(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    _small_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Suffix arrays, minhashes, raking and tokenizers are beyond SQL; tests/llm has brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written as Parquet and read again; a stage's table goes once the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    batch = spark.conf.get(_BATCH)
    try:
        for name, stage in STAGES:
            docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
            if before is not None:
                drop_tables(before)
            before = docs
    finally:
        spark.conf.set(_BATCH, batch)
    return docs
