"""Sharding: indivisible groups of rows go to shards of near equal size.

Method: best-fit decreasing. Groups sorted by size enter the bin with the
tightest remaining capacity that holds them, found in a balanced search tree; the
capacity is the smallest with which the bins suffice.

Groups of one size are placed together: best fit fills the tightest bin with them,
then the next, just as if they came one by one. So the driver holds the sizes and
their counts, whatever the number of groups: under sqrt(2 * all bytes) sizes can
differ (250,000 for 30 GB, 14 million for 100 TB, if every size occurred). Each
group's place among those of its size, counted in Spark, then gives its bin.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecmill.llm.common import cut, table

#: Slots are counted in so many slices of each shard.
N_SLICES = 1024


class BinTree:
    """Open bins in a balanced search tree (a treap) by remaining capacity, then number.

    A node is [key, priority, left, right]; priorities come from a fixed seed.
    """

    def __init__(self):
        self._root = None
        self._random = random.Random(7)

    @classmethod
    def _split(cls, node, key):
        """The trees of the keys below ``key``, and of the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], rest = cls._split(node[3], key)
            return node, rest
        rest, node[2] = cls._split(node[2], key)
        return rest, node

    @classmethod
    def _join(cls, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = cls._join(a[3], b)
            return a
        b[2] = cls._join(a, b[2])
        return b

    def put(self, capacity: int, number: int) -> None:
        key = (capacity, number)
        below, others = self._split(self._root, key)
        self._root = self._join(self._join(below, [key, self._random.random(), None, None]), others)

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least capacity of at least ``need``."""
        below, fit = self._split(self._root, (need, -1))
        if fit is None:
            self._root = below
            return None
        least = fit
        while least[2] is not None:
            least = least[2]
        _, fit = self._split(fit, (least[0][0], least[0][1] + 1))
        self._root = self._join(below, fit)
        return least[0]


def best_fit_classes(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """(size, count, bin) in order of placement, for ``classes`` (size, count) in decreasing order of size.

    Items over the capacity get a bin of their own. With ``most``, None where more
    bins would be needed.
    """
    tree, opened, out = BinTree(), 0, []
    for size, count in classes:
        while count:
            found = tree.take_tightest(size)
            if found is None:
                if most is not None and opened == most:
                    return None
                found = (max(capacity, size), opened)
                opened += 1
            room, number = found
            # with less room, it stays the tightest until no other of this size fits
            n = min(count, room // size)
            tree.put(room - n * size, number)
            out.append((size, n, number))
            count -= n
    return out


def near_equal(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """Best-fit decreasing with the smallest capacity (found by bisection) that needs ``bins`` bins at most.

    An item over a fair share of what is left gets a bin alone first, so that the
    other bins' capacity doesn't follow from it. ``classes`` (size, count) are in
    decreasing order of size.
    """
    alone, rest = [], list(classes)
    total, left = sum(s * c for s, c in rest), bins
    while rest and left > 1 and rest[0][0] * left > total:
        size, count = rest[0]
        alone.append((size, 1, len(alone)))
        rest[:1] = [(size, count - 1)] if count > 1 else []
        total, left = total - size, left - 1
    if not rest:
        return alone
    low = high = max(rest[0][0], -(-total // left))
    best, step = best_fit_classes(rest, high, left), max(1, high // 1024)
    while best is None:
        low, high, step = high + 1, high + step, 2 * step
        best = best_fit_classes(rest, high, left)
    while low < high:
        mid = (low + high) // 2
        got = best_fit_classes(rest, mid, left)
        if got is None:
            low = mid + 1
        else:
            best, high = got, mid
    return alone + [(size, n, len(alone) + number) for size, n, number in best]


def _plan(spark: SparkSession, placed: list[tuple[int, int, int]]) -> DataFrame:
    """(bytes, ends, shards): of the groups of a size, those below the first end (by their place) are in the first shard, and so on."""
    rows: dict[int, tuple[list[int], list[int]]] = {}
    for size, n, number in placed:
        ends, shards = rows.setdefault(size, ([], []))
        ends.append((ends[-1] if ends else 0) + n)
        shards.append(number)
    found = pd.DataFrame({"bytes": list(rows), "ends": [e for e, _ in rows.values()], "shards": [b for _, b in rows.values()]})
    return spark.createDataFrame(found, "bytes long, ends array<long>, shards array<int>")


def shard_groups(rows: DataFrame, shards: int | None = None, capacity: int | None = None, slices: int = 64) -> DataFrame:
    """``rows`` (with long columns g1, g2: the group's identity; size: at least 1) with int ``shard``.

    With ``shards``, that many of near equal size: a group that is larger than a
    fair share fills a shard alone, and the others share the rest. With ``capacity``,
    as few shards of at most so many bytes as best-fit decreasing finds: a group that
    is larger fills a shard alone. A group never spans shards.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("either shards or a capacity is needed")
    if capacity is not None and capacity < 1:
        raise ValueError("a capacity is positive")
    groups = cut(rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes")))
    counted = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toPandas()  # one row for each size that occurs
    classes = sorted(zip(counted["bytes"].tolist(), counted["n"].tolist()), reverse=True)
    placed = near_equal(classes, shards) if capacity is None else best_fit_classes(classes, capacity)
    planned = groups.join(_plan(rows.sparkSession, placed), "bytes")
    # most sizes are in one shard as a whole; of the others, places are counted within slices
    whole = planned.where(F.size("shards") == 1).select("g1", "g2", F.col("shards")[0].alias("shard"))
    split = planned.where(F.size("shards") > 1).withColumn("slice", F.pmod(F.xxhash64("g2", "g1"), F.lit(slices)))
    counts = split.groupBy("bytes", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bytes").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("bytes", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    nth = F.row_number().over(Window.partitionBy("bytes", "slice").orderBy("g1", "g2")) - 1
    numbered = split.withColumn("nth", nth).join(shifts, ["bytes", "slice"]).withColumn("place", F.col("nth") + F.col("shift"))
    at = F.size(F.filter("ends", lambda end: end <= F.col("place")))
    dealt = cut(whole.unionByName(numbered.select("g1", "g2", F.get("shards", at).alias("shard"))))
    # plain scans on both sides: a group that a third of all rows form is split as the join runs
    return rows.join(dealt, ["g1", "g2"])


def number_slots(rows: DataFrame, order: list[str], slices: int = N_SLICES) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, ... without gaps in each ``shard``.

    Numbers run within hash slices of a shard; the slices' counts (``slices``
    for each shard at most) shift them. No task sees a whole shard.
    """
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    counts = sliced.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("shard", "slice").orderBy(*order)
    return (
        sliced.withColumn("nth", F.row_number().over(within) - 1)
        .join(F.broadcast(shifts), ["shard", "slice"])
        .withColumn("slot", (F.col("nth") + F.col("shift")).cast("long"))
        .drop("nth", "shift", "slice")
    )


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: rows of equal texts share a shard, shards are near equal in bytes.

    A null text counts as empty (and belongs with empty texts); its size is 1.
    Null and repeated ids are rows like any other; rows equal in all that is
    returned are told apart only by their slots. Other columns are not read. No
    rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit(1), text).alias("g2"),
    )
    return number_slots(shard_groups(cut(rows), shards), ["doc_id", "g1", "g2"]).drop("g1", "g2")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op3_sharding": op3_sharding}
ORACLES: dict[str, str] = {}
