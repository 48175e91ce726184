"""Nearest rows of each query, exact, by blocks of rows and queries.

Rows and queries are packed into blocks (a few thousand rows each, as binary), and
each block of rows meets each block of queries. A task holds two blocks, and the
best found so far for the queries that it has met; no pair becomes a row. Pairs of
words are compared as matrices of integers. Pairs of vectors are first bounded by a
product of matrices; those that may be among the best get their distance by adding
up components in order, as SQL does, so that no result depends on blocks.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_BLOCK = 4096
QUERY_BLOCK = 1024
#: Queries that meet a block of rows at once, and pairs that get exact distances at once.
TOGETHER, EXACT = 128, 1 << 15
#: Queries of a partition, where they are too many to be broadcast; a task keeps the best rows of so many blocks of them.
PER_PARTITION = 20 * QUERY_BLOCK
KEPT_BLOCKS = 24


def _floats(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows of a matrix, and which are sound: neither null nor with nulls; the others are zeros."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    column = column.drop_null()
    lengths = set(column.value_lengths().unique().to_pylist())
    if len(lengths) > 1:
        raise ValueError("vectors differ in length")
    dim = lengths.pop() if lengths else 0
    flat = column.flatten()
    matrix = flat.to_numpy(zero_copy_only=False).reshape(len(column), dim)
    whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(len(column), dim).any(axis=1)
    ok = there.copy()
    ok[there] = whole
    out = np.zeros((len(ok), dim), dtype=matrix.dtype)
    out[ok] = matrix[whole]
    return out, ok


def _pack(size: int, payload: list[str], keep: list[str]):
    """Packs a partition's rows (id, ``payload``: a vector, or words, ``keep``: longs) into blocks of ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            whole = pa.Table.from_batches(held)
            at = 0
            while count - at >= size or (last and at < count):
                yield block(whole.slice(at, size))
                at += size
            at = min(at, count)
            held, count = whole.slice(at).to_batches(), count - at

        def block(rows: pa.Table) -> pa.RecordBatch:
            column = lambda n: rows.column(n).combine_chunks()
            longs = [column(n) for n in ("id", *keep)]
            if any(c.null_count for c in longs):
                raise ValueError("ids may not be null")
            longs = np.stack([c.to_numpy(zero_copy_only=False) for c in longs]).astype(np.int64)
            if payload == ["vector"]:
                values, ok = _floats(column("vector"))
            else:
                values, ok = np.stack([column(n).to_numpy() for n in payload], axis=1), np.ones(rows.num_rows, dtype=bool)
            kind, dim, parts = values.dtype.str, values.shape[1], [x.tobytes() for x in (longs, values, ok)]
            number = xxhash.xxh3_64_intdigest(b"".join(parts)) >> 1  # by content: blocks of one number are equal
            return pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()), "kind": pa.array([f"{kind} {dim}"]), "longs": pa.array([parts[0]], pa.binary()),
                "payload": pa.array([parts[1]], pa.binary()), "ok": pa.array([parts[2]], pa.binary()),
            })

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= size:
                yield from blocks(False)
        if count:
            yield from blocks(True)

    return run


_BLOCK = "block long, kind string, longs binary, payload binary, ok binary"


class Block:
    """A block as arrays."""

    def __init__(self, kind: str, longs: bytes, payload: bytes, ok: bytes):
        dtype, dim = kind.split()
        self.ok = np.frombuffer(ok, dtype=bool)
        self.longs = np.frombuffer(longs, dtype=np.int64).reshape(-1, len(self.ok))
        self.ids = self.longs[0]
        self.values = np.frombuffer(payload, dtype=dtype).reshape(len(self.ok), int(dim))
        self.sound = bool(self.ok.all())

    def fit(self, other: Block) -> bool:
        """Whether this block lacks sound vectors, and now has ``other``'s length."""
        if self.ok.any():
            return False
        self.values = np.zeros((len(self.ok), other.values.shape[1]), dtype=other.values.dtype)
        return True


def _slack(dim: int) -> float:
    """Share of the magnitudes by which a product of matrices may differ from the sum in order; each has half of that at most."""
    return 8 * (dim + 8) * float(np.finfo(np.float64).eps)


def _in_order(terms: np.ndarray) -> np.ndarray:
    """Sums of the rows' terms, from the first to the last."""
    total = np.zeros(len(terms))
    for column in terms.T:
        total += column
    return total


class L2:
    """Squared distance."""

    sign, excludes = 1, False

    def prepare(self, block: Block) -> None:
        block.wide = block.values.astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            block.squares = np.einsum("ij,ij->i", block.wide, block.wide)
            block.reach = np.sqrt(block.squares.max(initial=0))

    def matrix(self, q: Block, x: Block, rows: slice) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            out = q.wide[rows] @ x.wide.T
            out *= -2
            out += q.squares[rows, None]
            out += x.squares
        return out

    def slack(self, q: Block, x: Block, rows: slice) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return _slack(q.wide.shape[1]) * (np.sqrt(q.squares[rows]) + x.reach) ** 2

    def exact(self, q: Block, x: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            d = q.wide[i] - x.wide[j]
            return _in_order(d * d)


class Cosine:
    """Cosine, negative so that the highest comes first; a vector of zeros has norm 1. NaN comes before all."""

    sign, excludes = -1, False

    def prepare(self, block: Block) -> None:
        block.wide = block.values.astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt(_in_order(block.wide * block.wide))
            block.norms = np.where(norm == 0, 1.0, norm)
            block.unit = block.wide / block.norms[:, None]

    def matrix(self, q: Block, x: Block, rows: slice) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            out = q.unit[rows] @ x.unit.T
        return np.negative(out, out=out)

    def slack(self, q: Block, x: Block, rows: slice) -> np.ndarray:
        return np.full(len(q.unit[rows]), _slack(q.wide.shape[1]))

    def exact(self, q: Block, x: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            return -(_in_order(q.wide[i] * x.wide[j]) / (q.norms[i] * x.norms[j]))


class Bits:
    """Differing bits of the words among the first ``width``; with 2 bits, 4 where both keep a component with other signs, 1 where one keeps it."""

    def __init__(self, width: int, bits: int = 1):
        self.sign, self.bits, self.words, self.excludes = 1, bits, -(-width // 64), False
        over = 64 * self.words - width
        self.masks = np.full(self.words, -1, dtype=np.int64)
        if over:
            self.masks[-1] = (1 << (64 - over)) - 1

    def prepare(self, block: Block) -> None:
        parts = block.values.reshape(len(block.ok), self.bits, self.words)
        block.parts = np.ascontiguousarray((parts & self.masks).transpose(1, 2, 0)).view(np.uint64)

    def matrix(self, q: Block, x: Block, rows: slice) -> np.ndarray:
        out = None
        for k in range(self.words):
            s, m = (x.parts[b, k][None, :] if b < self.bits else None for b in (0, 1))
            qs, qm = (q.parts[b, k][rows, None] if b < self.bits else None for b in (0, 1))
            if self.bits == 1:
                part = np.bitwise_count(s ^ qs)
            else:
                both = s ^ qs
                both &= m
                both &= qm
                part = np.bitwise_count(both).astype(np.int16)
                part *= 4
                part += np.bitwise_count(m ^ qm)
            out = part if out is None else np.add(out, part, dtype=np.int32)
        return out

    def slack(self, q: Block, x: Block, rows: slice) -> np.ndarray:
        return np.zeros(1)


class Routed(Bits):
    """As ``Bits``, of the rows alone that bucket routing gathers; the last word of the payload has the keys, a byte for each chunk.

    A query's second long is the last group that it gathers; -1 stands for the rows
    with the first ``first`` ids. Others are as far as can be.
    """

    def __init__(self, width: int, bits: int, first: int):
        super().__init__(width, bits)
        self.excludes, self.first = True, first

    def prepare(self, block: Block) -> None:
        parts = block.values[:, :-1].reshape(len(block.ok), self.bits, self.words)
        block.parts = np.ascontiguousarray((parts & self.masks).transpose(1, 2, 0)).view(np.uint64)
        block.keys = np.stack([(block.values[:, -1] >> 8 * c).astype(np.uint8) for c in range(4)])

    def groups(self, q: Block, x: Block, rows: slice) -> np.ndarray:
        """When routing comes by each row: 0 by an equal key, 1 to 4 by a key with one other bit, 5 by the first with two, 6 never."""
        out = None
        for c in range(4):
            n = np.bitwise_count(q.keys[c, rows, None] ^ x.keys[c])
            # 0, then c + 1, then 6 (of the first chunk 5 at two bits); arithmetic is faster here than looking up
            group = (n != 0).view(np.uint8) * np.uint8(c + 1)
            group += (n > 1).view(np.uint8) * np.uint8(5 - c if c else 4)
            if c == 0:
                group += (n > 2).view(np.uint8)
            out = group if out is None else np.minimum(out, group, out=out)
        return out

    def matrix(self, q: Block, x: Block, rows: slice) -> np.ndarray:
        near, last = super().matrix(q, x, rows), q.longs[1][rows, None]
        gathered = (self.groups(q, x, rows) <= last) | ((last == -1) & (x.ids < self.first))
        return np.where(gathered, near, np.iinfo(near.dtype).max)


class Asked:
    """A block of queries, and for each the ``k`` best rows met so far: (key, null, id), the lowest first."""

    def __init__(self, block: Block, k: int, measure):
        self.block, self.k, self.measure = block, k, measure
        n = len(block.ok)
        self.bound = np.full(n, np.inf)  # the key of the k-th best
        self.full = np.zeros(n, dtype=bool)
        self.found = self._none()
        self.waiting: list[tuple] = []
        self.count = 0

    @staticmethod
    def _none() -> tuple:
        return np.empty(0, np.int32), np.empty(0), np.empty(0, bool), np.empty(0, np.int64)

    def meet(self, other: Block) -> None:
        """Takes the rows of ``other`` into account."""
        for at in range(0, len(self.block.ok), TOGETHER):
            rows = slice(at, min(at + TOGETHER, len(self.block.ok)))
            near = self.measure.matrix(self.block, other, rows)
            limit = self._limit(near, rows, other)
            left = ~(near > limit[:, None])
            if self.measure.excludes:
                left &= near < np.iinfo(near.dtype).max
            if not (self.block.sound and other.sound):
                left = np.where(self.block.ok[rows, None] & other.ok, left, ~self.full[rows, None])
            i, j = np.nonzero(left)
            for a in range(0, len(i), EXACT):
                self._take(at + i[a : a + EXACT], j[a : a + EXACT], near[i[a : a + EXACT], j[a : a + EXACT]], other)

    def _limit(self, near: np.ndarray, rows: slice, other: Block) -> np.ndarray:
        """What a row must reach; where ``k`` rows aren't known yet, those of this block tell."""
        limit = self.bound[rows].copy()
        if near.shape[1] > self.k and other.sound and not (full := self.full[rows]).all():
            limit[~full] = np.partition(near[~full], self.k - 1, axis=1)[:, self.k - 1]
        if near.dtype.kind != "f":
            return np.minimum(limit, np.iinfo(near.dtype).max).astype(near.dtype)
        # both the bound's matrix and this one may be off
        return limit + 2 * self.measure.slack(self.block, other, rows)

    def _take(self, i: np.ndarray, j: np.ndarray, near: np.ndarray, other: Block) -> None:
        null = ~(self.block.ok[i] & other.ok[j])
        if near.dtype.kind == "f":
            key = np.full(len(i), np.nan)
            fine = ~null
            key[fine] = self.measure.exact(self.block, other, i[fine], j[fine])
        else:
            key = near.astype(np.float64)
        if self.measure.sign < 0:
            key[np.isnan(key) & ~null] = -np.inf
        better = ~(key > self.bound[i])
        self.waiting.append((i[better].astype(np.int32), key[better], null[better], other.ids[j[better]]))
        self.count += len(self.waiting[-1][0])
        if self.count > max(EXACT, len(self.block.ok) * self.k):
            self.settle()

    def settle(self) -> None:
        """Sorts what waits among the best."""
        if not self.waiting:
            return
        q, key, null, ids = (np.concatenate(c) for c in zip(self.found, *self.waiting))
        self.waiting, self.count = [], 0
        order = np.lexsort((ids, key, null, q))
        q = q[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        kept = order[nth < self.k]
        self.found = q[nth < self.k], key[kept], null[kept], ids[kept]
        last = nth == self.k - 1
        worst = key[order[last]]
        # a bound only where it is a number
        sure = ~(null[order[last]] | np.isnan(worst))
        self.bound[q[last][sure]] = worst[sure]
        self.full[q[last][sure]] = True

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        q, key, null, ids = self.found
        value = np.where(np.isneginf(key), np.nan, -key) if self.measure.sign < 0 else key
        if len(q):
            columns = [pa.array(c[q], pa.int64()) for c in self.block.longs]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.int64()), pa.array(value, pa.float64(), mask=null)], names=[*[f"a{n}" for n in range(len(columns))], "id", "value"])


class Voted:
    """A block of rows, and for each the bits of the families (second long) with a query within its threshold (third long)."""

    def __init__(self, block: Block, measure: Bits):
        self.block, self.measure, self.mask = block, measure, np.zeros(len(block.ok), dtype=np.int64)

    def meet(self, other: Block) -> None:
        _, families, thresholds = other.longs
        for at in range(0, len(self.block.ok), TOGETHER):
            rows = slice(at, min(at + TOGETHER, len(self.block.ok)))
            hit = self.measure.matrix(self.block, other, rows) <= thresholds.clip(-1, np.iinfo(np.int16).max).astype(np.int16)
            for family in np.unique(families):
                self.mask[rows] |= hit[:, families == family].any(axis=1).astype(np.int64) << int(family)

    def rows(self) -> Iterator[pa.RecordBatch]:
        columns = [pa.array(c, pa.int64()) for c in (*self.block.longs, self.mask)]
        yield pa.RecordBatch.from_arrays(columns, names=[*[f"a{n}" for n in range(len(columns) - 1)], "mask"])


class Counted:
    """A block of queries, and how many rows are in each group of their buckets."""

    def __init__(self, block: Block, measure: Routed):
        self.block, self.measure, self.counts = block, measure, np.zeros((6, len(block.ok)), dtype=np.int64)

    def meet(self, other: Block) -> None:
        for at in range(0, len(self.block.ok), TOGETHER):
            rows = slice(at, min(at + TOGETHER, len(self.block.ok)))
            groups = self.measure.groups(self.block, other, rows)
            for g in range(6):
                self.counts[g, rows] += np.count_nonzero(groups == g, axis=1)

    def rows(self) -> Iterator[pa.RecordBatch]:
        columns = [pa.array(c, pa.int64()) for c in (self.block.ids, *self.counts)]
        yield pa.RecordBatch.from_arrays(columns, names=["a0", *[str(g) for g in range(6)]])


def _meet(make, measure, per: str, kept: int):
    """Pairs of blocks as (r_..., q_...): what ``make`` of each block of the asking side (``per``) found among the others."""
    asked_side, other_side = ("q_", "r_") if per == "query" else ("r_", "q_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: OrderedDict = OrderedDict()
        other, number = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name: batch.column(name)[r]  # noqa: B023, E731

                def block(side: str) -> Block:
                    made = Block(get(f"{side}kind").as_py(), *[get(f"{side}{n}").as_buffer().to_pybytes() for n in ("longs", "payload", "ok")])  # noqa: B023
                    measure.prepare(made)
                    return made

                if number != (number := get(f"{other_side}block").as_py()):
                    other = block(other_side)
                at = get(f"{asked_side}block").as_py()
                if at not in asked:
                    asked[at] = make(block(asked_side))
                    if len(asked) > kept:
                        yield from asked.popitem(last=False)[1].rows()
                asked.move_to_end(at)
                one = asked[at].block
                if one.values.shape[1] != other.values.shape[1]:
                    changed = next((a for a, b in ((one, other), (other, one)) if a.fit(b)), None)
                    if changed is None:
                        raise ValueError("vectors differ in length")
                    measure.prepare(changed)
                asked[at].meet(other)
        for one in asked.values():
            yield from one.rows()

    return run


def _pairs(rows: DataFrame, queries: DataFrame, broadcast: bool, payload: tuple[str, ...], row_keep: tuple[str, ...], query_keep: tuple[str, ...]) -> DataFrame:
    """Every block of rows with every block of queries."""
    longs = lambda names: [F.col(c).cast("long").alias(c) for c in names]
    blocks = lambda df, size, keep: df.select(*longs(["id", *keep]), *payload).mapInArrow(_pack(size, list(payload), list(keep)), _BLOCK)
    r, q = blocks(rows, ROW_BLOCK, row_keep), blocks(queries, QUERY_BLOCK, query_keep)
    r, q = (df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns]) for df, p in ((r, "r_"), (q, "q_")))
    if not broadcast:
        q = q.repartition(-(-queries.count() // PER_PARTITION), "q_block")
    return r.crossJoin(F.broadcast(q) if broadcast else q)


def nearest(
    rows: DataFrame, queries: DataFrame, k: int, measure, broadcast: bool, payload: tuple[str, ...] = ("vector",), per: str = "query", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(a0, id, value): the id of a query, and of its ``k`` nearest of ``rows``, by partitions: no more than ``k`` for each query and task.

    Both are (id, ``payload``), with ids that are not null. ``per="row"`` asks for the
    nearest queries of each row instead; then a0 is a row's id and id a query's.
    ``keep``: further long columns of the asking side, which follow as a1, a2, ....
    Ties go to the smaller id. ``broadcast``: whether all tasks get all queries; else
    partitions meet as a product. Vectors that are null or hold a null have a null
    value, after all others; those of another length raise ValueError.
    """
    row_keep, query_keep = ((), keep) if per == "query" else (keep, ())
    met = _pairs(rows, queries, broadcast, payload, row_keep, query_keep)
    schema = ", ".join([*[f"a{n} long" for n in range(1 + len(keep))], "id long", "value double"])
    return met.mapInArrow(_meet(lambda block: Asked(block, k, measure), measure, per, KEPT_BLOCKS if per == "query" else 1), schema)


def votes(rows: DataFrame, queries: DataFrame, measure: Bits, broadcast: bool, payload: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """(a0, a1, ..., mask): a row's id and ``keep``; bit f is set where a query (id, family, threshold, words) of family f is within its threshold.

    Without ``broadcast`` a row has several, of parts of the queries. Without queries there are no rows.
    """
    met = _pairs(rows, queries, broadcast, payload, keep, ("family", "threshold"))
    schema = ", ".join([*[f"a{n} long" for n in range(1 + len(keep))], "mask long"])
    return met.mapInArrow(_meet(lambda block: Voted(block, measure), measure, "row", 1), schema)


def group_sizes(rows: DataFrame, queries: DataFrame, measure: Routed, broadcast: bool, payload: tuple[str, ...]) -> DataFrame:
    """(a0, 0, ..., 5): the rows in each group of a query's buckets, by tasks."""
    met = _pairs(rows, queries, broadcast, payload, (), ())
    return met.mapInArrow(_meet(lambda block: Counted(block, measure), measure, "query", KEPT_BLOCKS), "a0 long, " + ", ".join(f"`{g}` long" for g in range(6)))
