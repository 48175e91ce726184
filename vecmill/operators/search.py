"""Nearest neighbours: exact, by tiers of bits with reranking, and by buckets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecmill.operators.blocks import L2, Bits, Cosine, Routed, group_sizes, nearest

#: Queries up to this count are broadcast; more meet the rows in blocks (a cartesian product of partitions).
MOST_BROADCAST = 20_000
#: Candidates (queries x shortlist) up to this count are broadcast to the rows that they are fetched from.
MOST_FETCHED = 200_000


def count_queries(queries: DataFrame) -> int:
    """The number of queries, up to one over what is broadcast. To be asked before they are encoded."""
    return queries.limit(MOST_BROADCAST + 1).count()


def meet(rows: DataFrame, queries: DataFrame, n_queries: int | None = None) -> DataFrame:
    """Every row with every query: the stated query set is the small side. ``n_queries``: their count, where it is known."""
    n = count_queries(queries) if n_queries is None else n_queries
    return rows.crossJoin(F.broadcast(queries) if n <= MOST_BROADCAST else queries)


def _masked(x: Column, bits: int) -> Column:
    return x if bits >= 64 else x.bitwiseAND(F.lit((1 << bits) - 1))


def hamming(width: int) -> Column:
    """Differing bits among the first ``width`` of the words s0, .. and q_s0, ..."""
    parts = [F.bit_count(_masked(F.col(f"s{k}").bitwiseXOR(F.col(f"q_s{k}")), width - 64 * k)) for k in range(-(-width // 64))]
    return reduce(add, parts).cast("int")


def l2_squared(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> (cast(x as double) - y) * (cast(x as double) - y)), 0D, (s, v) -> s + v)")


def score(distance: Column, scale: float = 1e6) -> Column:
    """Scaled, truncated and saturated as a 32-bit integer."""
    return F.least(distance * scale, F.lit(2147483647.0)).cast("int")


def prefixed(queries: DataFrame) -> DataFrame:
    return queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])


def ranked(df: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` of each query; Spark limits each partition before the shuffle."""
    if k <= 0:
        raise ValueError("k must be positive")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(*order))).where(F.col("rank") <= k)


def knn(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2", n_queries: int | None = None) -> DataFrame:
    """(query_id, rank, id, distance) over (id, vector): squared L2 or cosine (highest first)."""
    if metric not in ("l2", "cosine"):
        raise ValueError("metric: l2 or cosine")
    n = count_queries(queries) if n_queries is None else n_queries
    found = nearest(rows.select("id", "vector"), queries.select("id", "vector"), k, L2() if metric == "l2" else Cosine(), n <= MOST_BROADCAST)
    found = found.select(F.col("a0").alias("q_id"), "id", F.col("value").alias("distance"))
    first = F.asc_nulls_last("distance") if metric == "l2" else F.desc_nulls_last("distance")
    return ranked(found, k, first, "id").select(F.col("q_id").alias("query_id"), "rank", "id", "distance")


def nearest_words(rows: DataFrame, queries: DataFrame, k: int, width: int, bits: int = 1, row: str = "id", n_queries: int | None = None, name: str = "hamming") -> DataFrame:
    """(q_id, ``row``, ``name``, rank): the ``k`` rows nearest to each query by the first ``width`` bits, ties to the lower ``row``."""
    n = count_queries(queries) if n_queries is None else n_queries
    names = [f"{p}{j}" for p in ("s", "m")[:bits] for j in range(-(-width // 64))]
    found = nearest(rows.select(F.col(row).alias("id"), *names), queries.select("id", *names), k, Bits(width, bits), n <= MOST_BROADCAST, tuple(names))
    return ranked(found.select(F.col("a0").alias("q_id"), F.col("id").alias(row), F.col("value").cast("int").alias(name)), k, name, row)


def shortlist(n: int | None, k: int, sidecar: str, routed: bool = False) -> int:
    """How many candidates the bits pass on; ``n`` is the number of rows, where it is known."""
    most = max(50, 3 * k) if sidecar == "none" else max(300, 30 * k) if routed else max(100, 20 * k)
    return most if n is None else min(n, most)


def asymmetric(dim: int, bits: int = 1) -> Column:
    """Squared distance of the query's rotated vector (q_z) to the signs (or kept signs) of a row."""
    bit = lambda n: f"(shiftrightunsigned({n}, pmod(i, 64)) & 1)"
    pick = lambda p: "CASE cast(i / 64 as int) " + " ".join(f"WHEN {k} THEN {bit(f'{p}{k}')}" for k in range(-(-dim // 64))) + " END"
    value = f"(2 * {pick('s')} - 1)" if bits == 1 else f"({pick('m')} * (2 * {pick('s')} - 1))"
    return F.expr(f"aggregate(transform(q_z, (z, i) -> (z - {value}) * (z - {value})), 0D, (s, v) -> s + v)")


def cascade(
    rows: DataFrame, queries: DataFrame, k: int, width: int, candidates: int, dim: int, bits: int = 1, sidecar: str = "fp8",
    routed: bool = False, fetch: Callable[[DataFrame], DataFrame] | None = None, n_queries: int | None = None,
) -> DataFrame:
    """(query_id, rank, id, hamming, distance): the ``candidates`` nearest by bits, reranked.

    ``rows`` are encoded (row_idx, words; id, and vec with a sidecar), ``queries`` (id,
    vector, words, z). Deleted rows (``deleted``) take no part. Ties go to the lower
    Hamming distance, then row. ``routed`` limits what meets to the buckets' rows.
    ``fetch`` encodes just the rows (row_idx) that it is given, where ``rows`` have
    the words alone; it gets the candidates, which are broadcast if they are few.
    """
    n = count_queries(queries) if n_queries is None else n_queries
    live = rows.where(~F.col("deleted")) if "deleted" in rows.columns else rows
    if routed:
        near = nearest_routed(live, queries, candidates, width, bits, n).drop("rank")
    else:
        near = nearest_words(live, queries, candidates, width, bits, "row_idx", n).drop("rank")
    if n * candidates <= MOST_FETCHED:
        near = F.broadcast(near)
    whole = ["vec"] if sidecar != "none" else [f"{p}{j}" for p in ("s", "m")[:bits] for j in range(-(-dim // 64))]
    if fetch is None:
        final = live.select("row_idx", "id", *whole).join(near, "row_idx")
    else:
        final = fetch(near).select("q_id", "row_idx", "hamming", "id", *whole)
    asked = prefixed(queries.select("id", "vector", "z"))
    value = l2_squared("q_vector", "vec") if sidecar != "none" else asymmetric(dim, bits)
    final = final.join(F.broadcast(asked) if n <= MOST_BROADCAST else asked, "q_id").select("q_id", "id", "row_idx", "hamming", value.alias("distance"))
    out = ranked(final.where(~F.isnan("distance")), k, "distance", "hamming", "row_idx")
    return out.select(F.col("q_id").alias("query_id"), "rank", "id", "hamming", "distance")


def probe_group() -> Column:
    """When bucket routing comes by a row: 0 by an equal key, 1 to 4 by a key of that chunk with one other bit, 5 by the first chunk's with two."""
    other = [F.bit_count(F.col(f"k{c}").cast("int").bitwiseXOR(F.col(f"q_k{c}").cast("int"))) for c in range(4)]
    group = F.when(reduce(lambda a, b: a | b, [x == 0 for x in other]), 0)
    for c, x in enumerate(other):
        group = group.when(x == 1, c + 1)
    return group.when(other[0] == 2, 5)


def _last_group(candidates: int) -> Column:
    """The last group that is gathered, by the groups' sizes (columns 0 to 5); -1 if there is nothing in any."""
    n = [F.coalesce(F.col(str(g)), F.lit(0)) for g in range(6)]
    before = [reduce(add, n[:g], F.lit(0)) for g in range(6)]
    last = reduce(lambda high, g: F.when(before[g] < 2 * candidates, g).otherwise(high), range(1, 5), F.lit(0))
    return F.when(before[5] + n[5] == 0, -1).when(before[5] < candidates, 5).otherwise(last)


def nearest_routed(rows: DataFrame, queries: DataFrame, candidates: int, width: int, bits: int, n_queries: int) -> DataFrame:
    """(q_id, row_idx, hamming, rank): as ``nearest_words``, of the rows that bucket routing gathers (see ``through_buckets``), by blocks."""
    words = [f"{p}{j}" for p in ("s", "m")[:bits] for j in range(-(-width // 64))]
    keys = reduce(add, [F.shiftleft(F.col(f"k{c}").cast("long").bitwiseAND(F.lit(255)), 8 * c) for c in range(4)]).alias("keys")
    payload, few = (*words, "keys"), n_queries <= MOST_BROADCAST
    measure = Routed(width, bits, candidates)
    met, asked = rows.select(F.col("row_idx").alias("id"), *words, keys), queries.select("id", *words, keys)
    sizes = group_sizes(met, asked, measure, few, payload).groupBy(F.col("a0").alias("id")).agg(*[F.sum(str(g)).alias(str(g)) for g in range(6)])
    asked = asked.join(sizes, "id", "left").select("id", *payload, _last_group(candidates).alias("last"))
    found = nearest(met, asked, candidates, measure, few, payload, keep=("last",))
    found = found.select(F.col("a0").alias("q_id"), F.col("id").alias("row_idx"), F.col("value").cast("int").alias("hamming"))
    return ranked(found, candidates, "hamming", "row_idx")


def through_buckets(met: DataFrame, queries: DataFrame, candidates: int) -> DataFrame:
    """The rows of ``met`` (row_idx, k0 to k3, and the queries' with q_) that bucket routing gathers.

    Exact buckets first. Where under 2 * ``candidates`` rows are gathered, one-bit
    neighbours by chunk until there are as many; where still under ``candidates``,
    two-bit neighbours of the first chunk. A query without any takes the first rows.

    A row's group follows from its keys and the query's, so that no postings are
    dealt out; the groups' sizes (6 for each query) are counted before. This is for
    pairs that are rows; ``nearest_routed`` gathers the same by blocks.
    """
    grouped = met.withColumn("g", probe_group())
    counts = grouped.where("g IS NOT NULL").groupBy("q_id").pivot("g", list(range(6))).agg(F.count(F.lit(1)))
    stops = queries.select(F.col("id").alias("q_id")).join(counts, "q_id", "left").select("q_id", _last_group(candidates).alias("last"))
    kept = grouped.join(stops, "q_id").where((F.col("g") <= F.col("last")) | ((F.col("last") == -1) & (F.col("row_idx") < candidates)))
    return kept.drop("g", "last")


def rerank(queries: DataFrame, rows: DataFrame, k: int, metric: str = "cosine", n_queries: int | None = None) -> DataFrame:
    """(query_id, rank, id, value): cosine, or L2 (not squared) for ``l2`` and ``euclidean``."""
    if metric not in ("cosine", "l2", "euclidean"):
        raise ValueError("metric: cosine, l2 or euclidean")
    found = knn(rows, queries, k, "cosine" if metric == "cosine" else "l2", n_queries)
    value = F.col("distance") if metric == "cosine" else F.sqrt("distance")
    return found.select("query_id", "rank", "id", value.alias("value"))
