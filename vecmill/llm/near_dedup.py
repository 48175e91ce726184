"""MinHash near-dedup with tensored banding.

Method: two collections of ``m`` short keys (``r`` minhashes each) are drawn for a
document; the key of table (i, j) joins key i of the first with key j of the
second, so m * m tables of 2r hashes need 2mr hash functions in place of 2rm^2.
Candidates are verified on full shingle sets.

A table key is formed only where both its halves are shared with a document of
another component: no pair is lost by that, as a pair that meets in table (i, j)
shares both halves. Links are found in rounds. Each joins components, and pairs
within a component need no test. First each node meets one other: of those that
share most keys with most nodes, which is the text that edited copies come from.
These rounds go on while they join many nodes. Then, of all tables that span
components, every pair is met that spans components, once: where it shares the first
half of a key first.

Before sets are read, two exact bounds rule pairs out. A node whose shingles other
components hold are too few for a link is left out; an intersection can't have
more. And each node has a bitmap of its shingles' hashes: of the bits that one node
has and the other lacks, each stands for a shingle that the other lacks.

With r = 3 and m = 20, documents of similarity s meet with probability
(1 - (1 - s^3)^20)^2: 0.99996 at 0.75, 0.9999999 at 0.85.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm.common import WordHashes, drop_tables, mix64, shared_table, shingle_hashes, table
from vecmill.llm.components import connected_components

WIDTH = 5
PERCENT = 75
M = 20
R = 3
#: A pair of similarity 0.75 shares 17 of 40 keys on average, and under MIN_SHARED
#: with probability 2e-5; pairs below it are not looked up.
MIN_SHARED = 4
#: Bits of a node's bitmap.
BITS = 1024
#: Rounds in which each node meets one other go on while they find links for 1 of so many nodes.
FEW = 100


def words_of(text: str | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` with A-Z in lower case: what these functions of bytes do."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Signer:
    def __init__(self, m: int = M, r: int = R, seed: int = 20_240):
        rng = np.random.default_rng(seed)
        self.m, self.r = m, r
        self.xor = rng.integers(0, 1 << 32, 2 * m * r, dtype=np.uint32)
        self.mul = rng.integers(0, 1 << 31, 2 * m * r, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.salt = mix64(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
        best = np.full(len(self.xor), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(x), 512):
            v = (x[at : at + 512] ^ self.xor) * self.mul
            v ^= v >> np.uint32(15)
            np.minimum(best, v.min(axis=0), out=best)
        return best

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """2m keys, distinct between slots."""
        low = self.minima(shingles).astype(np.uint64).reshape(2 * self.m, self.r)
        h = self.salt.copy()
        for k in range(self.r):
            h = mix64(h + low[:, k] * np.uint64(0xD6E8FEB86659FD93))
        return h.view(np.int64)


_SIGNED = "doc_id long, s1 long, s2 long, n long, keys array<long>"


def _sign(width: int, m: int, r: int):
    schema = pa.schema([("doc_id", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        signer, hashes = Signer(m, r), WordHashes()
        for batch in batches:
            s1, s2, n, keys = [], [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                shingles = shingle_hashes(hashes.of(words), width)
                whole = xxhash.xxh3_128_digest(b" ".join(words))
                s1.append(int.from_bytes(whole[:8], "little", signed=True))
                s2.append(int.from_bytes(whole[8:], "little", signed=True))
                n.append(len(shingles))
                keys.append(signer.keys(shingles) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (s1, s2, n)], pa.array(keys, pa.list_(pa.int64()))], schema=schema
            )

    return run


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    marks = np.zeros(BITS, dtype=bool)
    marks[(shingles & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").view("<i8")


_SETS = "node long, shingles binary, marks array<long>"


def _sets(width: int):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary()), ("marks", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(hashes.of(words_of(t.as_py())), width) for t in batch.column("text")]
            marks = pa.array([_bitmap(x) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in sets], pa.binary()), marks], schema=schema)

    return run


_LISTED = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of ``_sets`` as lists."""
    for batch in batches:
        lists = pa.array([np.frombuffer(s.as_buffer(), dtype=np.int64) for s in batch.column("shingles")], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), lists], schema=_LISTED)


def _confirm(percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("set_u"), batch.column("set_v")):
                a, b = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], schema=schema)

    return run


def _all(parts) -> Column:
    return reduce(lambda x, y: x & y, parts)


class _Linker:
    def __init__(self, docs: DataFrame, nodes: DataFrame, m: int, width: int, percent: int):
        self.docs, self.nodes, self.m, self.width, self.percent = docs, nodes, m, width, percent
        self.known: DataFrame | None = None
        # bounds of the nodes that share keys, and of the rows of ``known``
        self.n_nodes = self.n_known = 0

    def shared_keys(self, rows: DataFrame) -> DataFrame:
        """(node, comp, size, n, live, weight, a, b): the keys that each node shares with another component; some in both halves.

        ``weight`` counts the nodes of each of these keys.

        ``rows``: node, comp, size, n, keys with their slots as array<struct<slot, key>>.
        """
        each = rows.select("node", "comp", F.explode("keys").alias("k")).select("node", "comp", "k.slot", "k.key")
        spans = each.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("c")).where("x < y")
        live = shared_table(spans.select("key", "c"), "live-keys")
        half = lambda first: F.expr(f"filter(keys, k -> k.slot {'<' if first else '>='} {self.m})")
        found = (
            each.join(live, "key")
            .groupBy("node")
            .agg(F.collect_list(F.struct("slot", "key")).alias("keys"), F.sum("c").alias("weight"))  # 2m keys at most
            .withColumns({"a": half(True), "b": half(False)})
            .where((F.size("a") > 0) & (F.size("b") > 0) & (F.size("keys") >= MIN_SHARED))
            .select("node", F.col("keys").alias("live"), "weight", "a", "b")
        )
        out = shared_table(rows.select("node", "comp", "size", "n").join(found, "node"), "shared-keys")
        drop_tables(live)
        # only these nodes and keys can still meet one of another component
        self.nodes = out.select("node", "n", F.col("live").alias("keys"))
        return out

    def build_sets(self, shared: DataFrame) -> None:
        self.n_nodes = shared.count()
        wanted = shared_table(shared.select(F.col("node").alias("doc_id")).distinct(), "sharing-nodes", self.n_nodes)
        chosen = self.docs.join(wanted, "doc_id", "left_semi")
        self.sets = shared_table(chosen.mapInArrow(_sets(self.width), _SETS), "shingle-sets")
        drop_tables(wanted)
        bits = reduce(add, [F.bit_count(F.col("marks")[k]) for k in range(BITS // 64)])
        spare = (F.octet_length("shingles") / 8).cast("long") - bits
        self.sketches = self.sets.select("node", (F.octet_length("shingles") / 8).cast("long").alias("n"), spare.alias("spare"), "marks")

    def may_link(self, p: str, q: str) -> Column:
        """Whether the bitmaps of nodes (n, spare, marks, with these prefixes) leave a link possible.

        ``spare`` is a node's shingles less its bits, so that the intersection is at most the common bits and the smaller spare.
        """
        both = reduce(add, [F.bit_count(F.col(f"{p}marks")[k].bitwiseAND(F.col(f"{q}marks")[k])) for k in range(BITS // 64)])
        most = both + F.least(f"{p}spare", f"{q}spare")
        return (100 + self.percent) * most >= self.percent * (F.col(f"{p}n") + F.col(f"{q}n"))

    def similar(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs`` (u, v) that sizes and bitmaps leave possible."""
        side = lambda x: self.sketches.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "spare", "marks")])
        met = pairs.join(side("u"), "u").join(side("v"), "v")
        return met.where((100 * F.least("u_n", "v_n") >= self.percent * F.greatest("u_n", "v_n")) & self.may_link("u_", "v_")).select("u", "v")

    def verify(self, pairs: DataFrame) -> int:
        """Joins the components of linked ``pairs`` (u < v, distinct); how many are linked."""
        pairs = shared_table(pairs, "pairs")
        # the sets of these nodes alone are dealt out
        wanted = shared_table(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "paired", self.n_nodes)
        few = self.sets.select("node", "shingles").join(wanted, "node", "left_semi")
        full = lambda x: few.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"))
        found = pairs.join(full("u"), "u").join(full("v"), "v").mapInArrow(_confirm(self.percent), "u long, v long")
        links = shared_table(found, "links")
        drop_tables(pairs, wanted)
        n_links = links.count()
        if not n_links:
            return 0
        self.n_known += 2 * n_links
        if self.known is None:
            self.known = connected_components(links, n_links).withColumnRenamed("root", "comp")
            return n_links
        of = lambda x: self.known.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}"))
        edges = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("comp_u", "u").alias("u"), F.coalesce("comp_v", "v").alias("v"))
        roots = connected_components(edges, n_links)
        moved = self.known.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
        new = roots.join(self.known.select("node"), "node", "left_anti").select("node", F.col("root").alias("comp"))
        self.known = shared_table(moved.unionByName(new), "components", self.n_known)
        return n_links

    def labelled(self) -> DataFrame:
        """The nodes with their components so far, and the components' sizes."""
        if self.known is None:
            return self.nodes.select("node", F.col("node").alias("comp"), F.lit(1).cast("long").alias("size"), "n", "keys")
        sizes = self.known.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
        known = shared_table(self.known.join(sizes, "comp").select("node", "comp", "size"), "sized", self.n_known)
        rows = self.nodes.join(known, "node", "left")
        return rows.select("node", F.coalesce("comp", "node").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"), "n", "keys")

    def stars(self, shared: DataFrame, turn: int) -> DataFrame:
        """A pair for each node: with the one of another component that, as the first of a key, shares most keys.

        The first of a key is the one of largest weight; after the first turn, one by
        a hash that differs between turns of those of about the largest.
        """
        rank = F.col("weight") if turn == 0 else F.floor(2 * F.log2("weight"))
        each = shared.select("node", "comp", rank.cast("long").alias("w"), F.explode("live").alias("k")).select("node", "comp", "w", "k.key")
        mark = F.struct("w", F.xxhash64(F.lit(turn), F.col("node")).alias("h"), F.col("node").alias("p"), F.col("comp").alias("pc"))
        first = shared_table(each.groupBy("key").agg(F.max(mark).alias("m")).select("key", "m.p", "m.pc"), "pivots")
        chosen = (
            each.join(first, "key")
            .where("pc <> comp")
            .groupBy("node", "p")
            .agg(F.count(F.lit(1)).alias("c"))
            .groupBy("node")
            .agg(F.max(F.struct("c", (-F.col("p")).alias("m"))).alias("best"))
            .select("node", (-F.col("best.m")).alias("p"))
        )
        return chosen.select(F.least("node", "p").alias("u"), F.greatest("node", "p").alias("v")).distinct()

    def reaching(self, shared: DataFrame) -> DataFrame:
        """``shared`` with ``most``, the size of the largest set that each node can be linked with; without nodes of none.

        Of ``c`` shingles that other components hold, a set of ``k`` has at most
        min(c, k), so that percent * (n + k - c) <= 100 * c.
        """
        comps = shared.select("node", "comp")
        each = self.sets.select("node", "shingles").join(comps.select("node"), "node", "left_semi").mapInArrow(_listed, "node long, shingles array<long>")
        listed = shared_table(each.join(comps, "node"), "listed-sets")
        each = listed.select("node", "comp", F.explode("shingles").alias("s"))
        spans = each.groupBy("s").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
        spanning = shared_table(spans.select("s"), "spanning")
        counts = each.join(spanning, "s").groupBy("node").agg(F.count(F.lit(1)).alias("c"))
        most = F.floor(((100 + self.percent) * F.col("c") - self.percent * F.col("n")) / self.percent)
        rows = shared.join(counts, "node").withColumn("most", most).drop("c")
        out = shared_table(rows.where(100 * F.col("most") >= self.percent * F.col("n")), "reaching")
        drop_tables(listed, spanning)
        return out

    def meetings(self, shared: DataFrame) -> DataFrame:
        """Each pair (u < v) of nodes that share a table and whose components differ, if bounds leave a link possible.

        The key of table (i, j) is compared by halves, as copies would share up to m * m
        tables if these were written out: nodes are dealt by the first half (i), and the
        join asks for a second (j). Of the first halves that a pair shares, it meets in
        one alone. There all but the bucket's largest component meet all others.
        """
        places = shared.select("node", "comp", F.explode("a").alias("a")).select("node", "comp", "a.slot", F.col("a.key").alias("half"))
        by_comp = places.groupBy("half", "comp").agg(F.count(F.lit(1)).alias("c"))
        mains = by_comp.groupBy("half").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"))
        # by slot: 32 bits of the first half's key, and of the second's; a key that isn't shared is replaced by another
        key = lambda k: F.coalesce(F.get(F.filter("live", lambda x: x["slot"] == k), F.lit(0))["key"], F.xxhash64("node", F.lit(k)))
        high = F.lit(-1 << 32)
        packed = F.array(*[key(k).bitwiseAND(high).bitwiseOR(F.shiftrightunsigned(key(self.m + k), 32)) for k in range(self.m)])
        # an id with several texts may have several keys in a slot, of which ``packed`` has one
        several = F.size("live") > F.size(F.array_distinct(F.transform("live", lambda x: x["slot"])))
        packs = shared.select("node", "most", several.alias("several"), packed.alias("packed"))
        sketched = shared_table(packs.join(self.sketches, "node"), "sketches")
        rows = places.join(mains, "half").withColumn("head", F.col("comp") != F.col("main")).drop("main")
        members = shared_table(rows.join(sketched, "node"), "members")
        heads = members.where("head").select(*[F.col(c).alias(f"p_{c}") for c in members.columns])
        differ = [F.col("packed")[k].bitwiseXOR(F.col("p_packed")[k]) for k in range(self.m)]
        same_a = [F.shiftrightunsigned(x, 32) == 0 for x in differ]
        same_b = [x.bitwiseAND(F.lit((1 << 32) - 1)) == 0 for x in differ]
        count = lambda each: reduce(add, [F.when(x, 1).otherwise(0) for x in each])
        on = _all([
            F.col("half") == F.col("p_half"),
            F.col("comp") != F.col("p_comp"),
            ~F.col("head") | (F.col("node") < F.col("p_node")),
            (F.col("n") <= F.col("p_most")) & (F.col("p_n") <= F.col("most")),
            100 * F.least("n", "p_n") >= self.percent * F.greatest("n", "p_n"),
            self.may_link("", "p_"),
            ~reduce(lambda x, y: x | y, [(F.col("slot") > k) & same_a[k] for k in range(self.m)]),
            F.col("several") | F.col("p_several") | ((count(same_b) > 0) & (count([*same_a, *same_b]) >= MIN_SHARED)),
        ])
        return members.join(heads, on).select(F.least("node", "p_node").alias("u"), F.greatest("node", "p_node").alias("v"))

    def run(self) -> DataFrame | None:
        """(node, comp) of all nodes with links; None if there are none."""
        shared = self.shared_keys(self.labelled())
        self.build_sets(shared)
        turn = 0
        while self.verify(self.similar(self.stars(shared, turn))) * FEW > self.n_nodes:
            shared, turn = self.shared_keys(self.labelled()), turn + 1
        if turn or self.known is not None:
            shared = self.shared_keys(self.labelled())
        self.verify(self.meetings(self.reaching(shared)))
        return self.known


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, m: int = M, r: int = R
) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text).

    Documents are linked where 100 * intersection >= ``percent`` * union of their
    sets of ``width``-word shingles (the whole sequence where there are fewer
    words); a component is what links reach, named by its smallest id.

    A null, empty or blank text has no shingles and is linked with nothing. Rows
    of one id are one document, linked by any of their texts. A row without id
    has a null component and is linked with nothing. Other columns are not read.
    No rows give no rows.
    """
    docs = docs.select("doc_id", "text")
    signed = shared_table(docs.mapInArrow(_sign(width, m, r), _SIGNED), "signatures")
    own = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    texts = signed.select("doc_id", "s1", "s2", "n")
    # one node for each distinct word sequence
    first = shared_table(texts.where(own).groupBy("s1", "s2").agg(F.min("doc_id").alias("node")), "sequences")
    keyed = signed.where(own).select(F.col("doc_id").alias("node"), "s1", "s2", "n", "keys")
    nodes = shared_table(
        keyed.join(first, ["node", "s1", "s2"], "left_semi")
        .dropDuplicates(["node", "s1", "s2"])
        .select("node", "n", F.transform("keys", lambda k, i: F.struct(i.alias("slot"), k.alias("key"))).alias("keys")),
        "nodes",
    )
    roots = _Linker(docs.where("doc_id IS NOT NULL"), nodes, m, width, percent).run()
    named = first.select("s1", "s2", F.col("node").alias("component"))
    if roots is not None:
        named = first.join(roots, "node", "left").select("s1", "s2", F.coalesce("comp", "node").alias("component"))
    # plain scans on both sides: a text that a third of all rows share is split as the join runs
    placed = texts.join(shared_table(named, "named"), ["s1", "s2"], "left")
    return placed.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(own, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
n AS (SELECT doc_id, ws, least(5, len(ws)) AS k FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + k - 1], ' ') AS part FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM n WHERE k > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS m FROM s a JOIN s b ON a.part = b.part AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT u, v FROM p JOIN c x ON x.doc_id = u JOIN c y ON y.doc_id = v WHERE 100 * m >= 75 * (x.n + y.n - m)),
r AS (SELECT doc_id, doc_id AS root FROM c UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.doc_id WHERE r.root < e.v)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(f.root, w.doc_id) AS component_id, coalesce(f.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) f ON f.doc_id = w.doc_id
"""
QUERIES = {"op5_minhash": op5_minhash}
ORACLES = {"op5_minhash": ORACLE}
