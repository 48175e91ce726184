"""Line dedup: lines that several documents share stay in one of them.

Method: explode the normalised lines, hash them, count the distinct documents of
each hash, drop the lines over the threshold, and reassemble by position.
DataFrame functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm.common import ASCII_SPACE, cut, table

#: So many of the most frequent keys are broadcast, and their lines dealt by
#: document. Any key with more than 1 / N_HOT of all lines is among them.
N_HOT = 1000


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(ASCII_SPACE))
    # lower() is fast, and right where all characters are ASCII
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    )


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    max_docs: int = 1,
    n_hot: int = N_HOT,
) -> DataFrame:
    """``docs`` with ``text_col`` replaced by its kept lines, and ``n_lines``, ``n_dropped``.

    A key of at least ``min_chars`` code points found in more than ``max_docs``
    documents loses its lines everywhere but in the smallest id that holds it
    (``max_docs`` is 1; a larger one counts distinct documents per key).

    A null text counts as empty: one empty line. Rows of one id are one document.
    Rows whose id is null keep all lines and don't count as documents. Other
    columns, of whatever name, pass through. No rows give no rows.
    """
    extra = [c for c in docs.columns if c not in (id_col, text_col)]
    base = docs.select(
        F.col(f"`{id_col}`").alias("__id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"),
        *([F.struct(*[F.col(f"`{c}`") for c in extra]).alias("__rest")] if extra else []),
    ).withColumn("__th", F.xxhash64("__text"))
    lines = (
        base.where(F.col("__id").isNotNull())
        .select("__id", "__th", F.posexplode(F.split("__text", "\n")).alias("pos", "line"))
        .where(F.octet_length("line") >= min_chars)
        .select("__id", "__th", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("__id", "__th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    )
    if max_docs == 1:
        many = F.col("first") < F.col("last")
        counts = [F.min("__id").alias("first"), F.max("__id").alias("last"), F.count(F.lit(1)).alias("n")]
        keys = lines.groupBy("h1", "h2").agg(*counts).where(many)
    else:
        # distinct documents per key, by way of one row for each key and document
        each = lines.groupBy("h1", "h2", "__id").agg(F.count(F.lit(1)).alias("m"))
        keys = (
            each.groupBy("h1", "h2")
            .agg(F.min("__id").alias("first"), F.count(F.lit(1)).alias("n_docs"), F.sum("m").alias("n"))
            .where(F.col("n_docs") > max_docs)
        )
    keys = cut(keys.select("h1", "h2", "first", "n"))
    # at most N_HOT keys; the join below is the way for all others
    hot = (
        keys.orderBy(F.desc("n"), "h1", "h2")
        .limit(n_hot)
        .select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("first").alias("hot_first"))
    )
    marked = lines.join(F.broadcast(hot), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    # lines of hot keys know their first document by now: they are dealt by document
    is_hot = F.col("hot_first").isNotNull()
    marked = marked.select(
        "__id", "__th", "pos", "hot_first",
        F.when(is_hot, F.xxhash64("__id", "pos")).otherwise(F.col("h1")).alias("k1"),
        F.when(is_hot, F.lit(0)).otherwise(F.col("h2")).alias("k2"),
    )
    light = keys.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("first").alias("light_first"))
    dropped = (
        marked.join(light, ["k1", "k2"], "left")
        .where(F.coalesce("hot_first", "light_first") < F.col("__id"))
        .groupBy("__id", "__th")
        .agg(F.collect_list("pos").alias("drop"))  # at most the lines of one document
        .select(F.col("__id").alias("d_id"), F.col("__th").alias("d_th"), "drop")
    )
    joined = base.join(dropped, (F.col("__id") == F.col("d_id")) & (F.col("__th") == F.col("d_th")), "left")
    all_lines = F.split("__text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    return (
        joined.withColumn("lines", F.when(F.col("drop").isNotNull(), all_lines))
        .withColumn("kept", F.when(F.col("drop").isNotNull(), kept))
        .select(
            F.col("__id").alias(id_col),
            F.when(F.col("drop").isNull(), F.col("__text"))
            .otherwise(F.array_join(F.transform("kept", lambda p: F.element_at("lines", p + 1)), "\n"))
            .alias(text_col),
            *[F.col("__rest").getField(c).alias(c) for c in extra if c not in ("n_lines", "n_dropped")],
            F.when(F.col("drop").isNull(), F.size(all_lines)).otherwise(F.size("lines")).cast("long").alias("n_lines"),
            F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        )
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), d AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), j AS (
  SELECT k.doc_id, k.pos, k.line, d.first IS NOT NULL AND d.first < k.doc_id AS gone
  FROM k LEFT JOIN d ON k.key = d.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES = {"op1_line_dedup": ORACLE}
