"""Exact top-k search by inner product of integer vectors.

Method: multi-resolution segment statistics. A vector is cut into segments, of
which means and deviations are kept, at several resolutions. By Cauchy-Schwarz,
on a segment of length l, <q, x> is at most l * (mean_q * mean_x + dev_q * dev_x),
so the distance has a lower bound. Blocks of rows pass the bounds coarse to fine: a
block as a whole by the ranges of its statistics, then its rows; the survivors get
exact scores.

The queries meet all rows in blocks: rows are dealt to cells, each block of
queries is sent to every cell. There it meets one block of rows after the other,
and what it has found so far is the bound for the next.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecmill.llm.common import cut, table

K = 5
LEVELS = (4, 16)
ROW_BLOCK = 2048
QUERY_BLOCK = 256
ROWS_PER_CELL = 16_384
#: Blocks of rows whose statistics a task keeps (some 3 MB each, at 64 dimensions); a cell has ROWS_PER_CELL / ROW_BLOCK on average.
KEPT_BLOCKS = 12
#: Queries whose bounds with a block are held at once.
TOGETHER = 32
#: Where more than 1 of so many pairs are left, they are scored with all others by a product of matrices.
DENSE = 16

_BLOCK = "block long, dim int, ids binary, vectors binary"


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float = 256.0) -> DataFrame:
    """(id, v): floor(scale * x), x as double, of vectors without nulls and non-finite components.

    Null vectors and ids, and vectors with null, NaN or infinite components, have no row.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        df.select(F.col(f"`{id_col}`").alias("id"), v.alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
        .select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
    )


def _blocks(size: int):
    """Packs the rows of a partition into blocks of equal dimension."""

    def pack(rows: list[tuple[int, list[int]]]) -> pa.RecordBatch:
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        vectors = np.array([r[1] for r in rows], dtype=np.int64)
        # by content: blocks of one number are equal
        block = xxhash.xxh3_64_intdigest(ids.tobytes() + vectors.tobytes()) >> 1
        return pa.RecordBatch.from_pydict({
            "block": pa.array([block], pa.int64()), "dim": pa.array([vectors.shape[1] if vectors.ndim > 1 else 0], pa.int32()),
            "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([vectors.tobytes()], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
                rows = held.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) == size:
                    yield pack(held.pop(len(v)))
        for rows in held.values():
            yield pack(rows)

    return run


def _segments(v: np.ndarray, parts: int) -> np.ndarray:
    """sqrt(length) * mean and sqrt(length) * deviation of each segment: <f(q), f(x)> bounds <q, x>."""
    cuts = np.linspace(0, v.shape[1], min(parts, max(1, v.shape[1])) + 1).astype(int)
    out = []
    for a, b in zip(cuts, cuts[1:]):
        s = v[:, a:b]
        out += [s.mean(axis=1) * np.sqrt(b - a), s.std(axis=1) * np.sqrt(b - a)]
    return np.stack(out, axis=1) if out else np.zeros((len(v), 1))


class BlockIndex:
    """A block of rows with their segment statistics, and the ranges of the coarsest."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: tuple[int, ...] = LEVELS):
        self.ids, self.exact, self.wide = ids, vectors, vectors.astype(np.float64)
        self.stats = [_segments(self.wide, n) for n in levels]
        self.low, self.high = self.stats[0].min(axis=0), self.stats[0].max(axis=0)
        self.largest = int(np.abs(vectors).max(initial=0))


_NONE = np.iinfo(np.int64).min


class Asked:
    """A block of queries and the best rows found for each so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS):
        self.ids, self.exact, self.wide, self.k = ids, vectors, vectors.astype(np.float64), k
        self.stats = [_segments(self.wide, n) for n in levels]
        self.largest = int(np.abs(vectors).max(initial=0))
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), best first
        self.least = np.full(len(ids), _NONE)

    def _floor(self, which: np.ndarray) -> np.ndarray:
        """What a bound must reach, with room for rounding."""
        least = self.least[which].astype(np.float64)
        return np.where(self.least[which] == _NONE, -np.inf, least - 1e-6 * np.abs(least) - 1e-3)

    def _take(self, n: int, scores: np.ndarray, ids: np.ndarray) -> None:
        best = sorted([*self.found[n], *zip((-scores).tolist(), ids.tolist())])[: self.k]
        self.found[n] = best
        if len(best) == self.k:
            self.least[n] = -best[-1][0]

    def meet(self, block: BlockIndex) -> int:
        """Takes the block's rows into account; how many got exact scores."""
        if self.largest * block.largest * max(1, self.exact.shape[1]) >= 1 << 62:
            raise ValueError("scores are over 64 bits")
        scored, coarse = 0, self.stats[0]
        reach = np.maximum(coarse * block.high, coarse * block.low).sum(axis=1)
        live = np.flatnonzero(reach >= self._floor(np.arange(len(self.ids))))
        for at in range(0, len(live), TOGETHER):
            which = live[at : at + TOGETHER]
            bound = coarse[which] @ block.stats[0].T
            bound[self.ids[which][:, None] == block.ids[None, :]] = -np.inf
            for row, n in enumerate(which):
                if self.least[n] == _NONE:  # the likeliest rows come first; all others then have a bound to pass
                    most = min(len(block.ids), 4 * self.k)
                    probe = np.argpartition(-bound[row], most - 1)[:most]
                    probe = probe[bound[row][probe] > -np.inf]
                    self._take(n, block.exact[probe] @ self.exact[n], block.ids[probe])
                    bound[row][probe] = -np.inf
                    scored += len(probe)
            floor = self._floor(which)
            left = (bound >= floor[:, None]) & (bound > -np.inf)
            for fine_q, fine_x in zip(self.stats[1:], block.stats[1:]):
                if left.sum() * DENSE > left.size:  # one product of matrices is cheaper than picking pairs
                    left &= fine_q[which] @ fine_x.T >= floor[:, None]
                else:
                    q, x = np.nonzero(left)
                    left[q, x] = np.einsum("ij,ij->i", fine_q[which[q]], fine_x[x]) >= floor[q]
            q, x = np.nonzero(left)
            if len(q) * DENSE > left.size and self.largest * block.largest * max(1, self.exact.shape[1]) < 1 << 53:
                scores = (self.wide[which] @ block.wide.T)[q, x].astype(np.int64)  # integers under 2^53 are exact as doubles
            else:
                scores = np.einsum("ij,ij->i", self.exact[which[q]], block.exact[x])
            scored += len(scores)
            better = scores >= self.least[which[q]]
            q, x, scores = q[better], x[better], scores[better]
            starts = np.searchsorted(q, np.arange(len(which) + 1))
            for row, n in enumerate(which):
                a, b = starts[row], starts[row + 1]
                if a < b:
                    self._take(n, scores[a:b], block.ids[x[a:b]])
        return scored

    def rows(self) -> list[tuple[int, int, int]]:
        return [(int(i), x, -s) for i, best in zip(self.ids, self.found) for s, x in best]


def _search(k: int, levels: tuple[int, ...]):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, mark, blocks = None, None, OrderedDict()

        def done() -> Iterator[pa.RecordBatch]:
            if asked is not None and (rows := asked.rows()):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name: np.frombuffer(batch.column(name)[r].as_buffer(), dtype=np.int64)  # noqa: B023, E731
                dim, number = batch.column("dim")[r].as_py(), batch.column("q_block")[r].as_py()
                if (number, dim) != mark:
                    yield from done()
                    qids = get("q_ids").copy()
                    asked, mark = Asked(qids, get("q_vectors").reshape(len(qids), dim).copy(), k, levels), (number, dim)
                key = (batch.column("block")[r].as_py(), dim)
                if key not in blocks:
                    ids = get("ids").copy()
                    blocks[key] = BlockIndex(ids, get("vectors").reshape(len(ids), dim).copy(), levels)
                    if len(blocks) > KEPT_BLOCKS:
                        blocks.popitem(last=False)
                blocks.move_to_end(key)
                asked.meet(blocks[key])
        yield from done()

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` highest inner products, ties to the smaller id.

    ``rows`` and ``queries`` are (id, v) with integer vectors; a query's own row
    is no candidate. Vectors of another length than the query's are none either.
    Where there are fewer rows, all are returned. Repeated ids are rows like any
    other (those of the query's id are its own); of a repeated query the smallest
    vector asks. Scores that could be over 64 bits raise ValueError. No rows give no
    rows.
    """
    n = rows.count()
    cells = max(1, -(-n // ROWS_PER_CELL))
    dealt = rows.repartition(cells, F.xxhash64("id")).mapInArrow(_blocks(ROW_BLOCK), _BLOCK)
    row_blocks = cut(dealt.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells))))
    asked = queries.groupBy("id").agg(F.min("v").alias("v"))
    query_blocks = asked.repartition(max(1, cells // 16), F.xxhash64("id")).mapInArrow(_blocks(QUERY_BLOCK), _BLOCK)
    sent = query_blocks.select(
        "dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell")
    )
    met = row_blocks.hint("shuffle_hash").join(sent, ["cell", "dim"])
    found = met.mapInArrow(_search(k, levels), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return top_k(rows, rows.where(F.col("id") % 50 == 0), K)


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
QUERIES = {"op7_topk": op7_topk}
ORACLES = {"op7_topk": ORACLE}
