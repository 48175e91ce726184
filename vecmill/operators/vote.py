"""Family voting: each row collects the families of the queries within their thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.operators.blocks import Bits, Cosine, nearest, votes
from vecmill.operators.search import MOST_BROADCAST, count_queries

RESONANT = 5


def voting_masks(rows: DataFrame, queries: DataFrame, width: int, n_queries: int | None = None) -> DataFrame:
    """(row_idx, id, mask, votes) of all rows: bit f is set where a query of family f is within its threshold.

    ``queries`` are encoded with family (0 to 7; others are refused as the query
    runs) and threshold. Deleted rows have mask 0. A row's mask follows from the row
    and the queries alone: blocks of rows meet blocks of queries, and up to
    ``MOST_BROADCAST`` queries are sent to the rows, so that no row is dealt out.
    """
    words = [f"s{k}" for k in range(-(-width // 64))]
    n = count_queries(queries) if n_queries is None else n_queries
    if n == 0:
        return rows.select("row_idx", "id", F.lit(0).alias("mask"), F.lit(0).alias("votes"))
    sound = F.when(F.col("family").between(0, 7), F.col("family")).otherwise(F.raise_error(F.lit("families are 0 to 7")).cast("int"))
    asked = queries.select(F.lit(0).alias("id"), sound.alias("family"), F.coalesce(F.floor("threshold"), F.lit(-1)).alias("threshold"), *words)
    dead = F.col("deleted").cast("int") if "deleted" in rows.columns else F.lit(0)
    found = votes(rows.select(F.col("row_idx").alias("id"), F.col("id").alias("row_id"), dead.alias("dead"), *words), asked, Bits(width), n <= MOST_BROADCAST, tuple(words), ("row_id", "dead"))
    found = found.select(F.col("a0").alias("row_idx"), F.col("a1").alias("id"), F.when(F.col("a2") == 1, 0).otherwise(F.col("mask")).cast("int").alias("mask"))
    if n > MOST_BROADCAST:
        found = found.groupBy("row_idx", "id").agg(F.bit_or("mask").alias("mask"))
    return found.withColumn("votes", F.bit_count("mask"))


def resonant_count(masks: DataFrame, least: int = RESONANT) -> DataFrame:
    return masks.agg(F.count(F.when(F.col("votes") >= least, 1)).alias("resonant_count"))


def grid_rerank(masks: DataFrame, rows: DataFrame, queries: DataFrame, min_votes: int = RESONANT, n_queries: int | None = None) -> DataFrame:
    """(row_idx, id, votes, mask, score): rows with the votes, in the order of their highest cosine to any query, then votes, then row."""
    chosen = masks.where(F.col("votes") >= min_votes).join(rows.select("row_idx", F.col("vec").alias("vector")), "row_idx")
    sought = chosen.select(F.col("row_idx").alias("id"), "vector", F.col("id").alias("row_id"), "votes", "mask")
    n = count_queries(queries) if n_queries is None else n_queries
    met = nearest(sought, queries.select(F.lit(0).alias("id"), "vector"), 1, Cosine(), n <= MOST_BROADCAST, per="row", keep=("row_id", "votes", "mask"))
    named = [F.col("a0").alias("row_idx"), F.col("a1").alias("id"), F.col("a2").cast("int").alias("votes"), F.col("a3").cast("int").alias("mask")]
    best = met.groupBy(*named).agg(F.max("value").alias("score"))
    return best.orderBy(F.desc("score"), F.desc("votes"), "row_idx")
