import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmill.functions.transform import Rotation, quantise, unpack_bits
from vecmill.operators import blocks
from vecmill.operators import search as S
from vecmill.operators import vote as V
from vecmill.operators.encode import encode
from vecmill.plans.registry import QUERIES

VECTORS = "id long, vector array<double>"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """A folder with 2,000 vectors, of which 20 ask: 40,000 pairs."""
    x = np.random.default_rng(6).normal(size=(2000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    at = str(tmp_path_factory.mktemp("table"))
    rows = [(n, [float(v) for v in r], n % 10) for n, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return at


def most_rows(df) -> int:
    """The most rows that an operator of the executed plan made."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        found = node.metrics().get("numOutputRows")
        yield found.get().value() if found.isDefined() else 0
        inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
        below = [inner] if inner is not None else [node.children().apply(n) for n in range(node.children().size())]
        for one in below:
            yield from walk(one)

    df.collect()
    return max(walk(df._jdf.queryExecution().executedPlan()))


@pytest.mark.parametrize("name", [
    "rerank_cosine", "vote_rerank", "knn_float_mode", "knn_cosine", "delta_search_merged", "knn_l2", "recall_at_k", "cascade_fp16", "cascade_fp4", "cascade_fp8",
    "cascade_none", "cascade_two_bit", "cascade_three_tiers", "cascade_two_tiers", "hamming_topk", "search_scores", "ternary_topk", "tombstone_filter", "mih_search",
])
def test_pairs_become_no_rows(spark, table, name):
    assert most_rows(QUERIES[name](spark, table)) < 20 * 2000 / 4


def drawn(rng, n, dim=6):
    """Small whole components: many equal distances, some of which sum to other digits by other orders."""
    return rng.integers(-2, 3, (n, dim)) / 10


def best(key, ids, k):
    return sorted(zip(key, ids))[:k]


@pytest.mark.parametrize("broadcast", [True, False])
def test_nearest_equals_sums_in_order(spark, monkeypatch, broadcast):
    for name, value in {"ROW_BLOCK": 70, "QUERY_BLOCK": 8, "TOGETHER": 5, "EXACT": 16, "PER_PARTITION": 16}.items():
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(S, "MOST_BROADCAST", 100 if broadcast else 3)
    rng = np.random.default_rng(1)
    x, q = drawn(rng, 400), drawn(rng, 30)
    x[5], q[4] = 0, 0
    ids = rng.permutation(400).tolist()
    frame = lambda i, v: spark.createDataFrame([(int(n), [float(c) for c in r]) for n, r in zip(i, v)], VECTORS).repartition(3)
    rows, asked = frame(ids, x), frame(range(30), q)

    def total(terms):
        out = 0.0
        for t in terms:
            out += t
        return out

    def cosine(a, b):
        norm = lambda v: math.sqrt(total(v * v)) or 1.0
        return total(a * b) / (norm(a) * norm(b))

    for metric, key in (("l2", lambda a, b: total((a - b) * (a - b))), ("cosine", lambda a, b: -cosine(a, b))):
        got = {}
        for r in S.knn(rows, asked, 7, metric).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.distance if metric == "l2" else -r.distance, r.id))
        assert got == {n: best([key(a, b) for b in x], ids, 7) for n, a in enumerate(q)}


def test_nearest_words(spark, monkeypatch):
    for name, value in {"ROW_BLOCK": 64, "QUERY_BLOCK": 4, "TOGETHER": 3, "EXACT": 16}.items():
        monkeypatch.setattr(blocks, name, value)
    rng = np.random.default_rng(2)
    for dim, width, bits in ((128, 100, 1), (128, 128, 2), (64, 48, 1), (64, 32, 2)):
        x = rng.normal(size=(300, dim))
        x[100:140] = x[:40]  # the same words: ties
        frame = spark.createDataFrame([(n, n, [float(v) for v in r]) for n, r in enumerate(x)], "id long, row_idx long, vector array<double>")
        coded = encode(frame, "vector", Rotation(dim, [dim]), bits)
        got = {}
        for r in S.nearest_words(coded, coded.where("id % 20 = 0"), 12, width, bits).orderBy("q_id", "rank").collect():
            got.setdefault(r.q_id, []).append((r.hamming, r.id))
        signs, masks = quantise(Rotation(dim, [dim]).apply(x), bits)
        signs = unpack_bits(signs, dim)[:, :width]
        masks = np.ones_like(signs) if masks is None else unpack_bits(masks, dim)[:, :width]
        for n in range(0, 300, 20):
            other = masks & masks[n] & (signs ^ signs[n])
            distance = other.sum(axis=1) if bits == 1 else 4 * other.sum(axis=1) + (masks ^ masks[n]).sum(axis=1)
            assert got[n] == best(distance.tolist(), range(300), 12)


def test_routed_by_blocks_as_by_rows(spark, monkeypatch):
    for name, value in {"ROW_BLOCK": 64, "QUERY_BLOCK": 5, "TOGETHER": 3}.items():
        monkeypatch.setattr(blocks, name, value)
    rng = np.random.default_rng(7)
    rows = [(n, n, int(rng.integers(-(2**62), 2**62)), *[int(v) for v in rng.choice([0, 1, 3, 7, 255], 4)]) for n in range(300)]
    schema = "id long, row_idx long, s0 long, k0 short, k1 short, k2 short, k3 short"
    frame, asked = spark.createDataFrame(rows, schema), spark.createDataFrame([*rows[:8], (900, 900, 5, 90, 90, 90, 90)], schema)  # of the last nothing is near
    for candidates in (1, 20, 60):
        pairs = S.through_buckets(S.meet(frame.drop("id"), S.prefixed(asked.drop("row_idx"))), asked, candidates)
        want = S.ranked(pairs.select("q_id", "row_idx", S.hamming(50).alias("hamming")), candidates, "hamming", "row_idx")
        got = S.nearest_routed(frame, asked, candidates, 50, 1, 9).select(*want.columns)
        assert sorted(got.collect()) == sorted(want.collect()) and got.where("q_id = 900").count() == candidates


def test_nearest_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [nan, 0.0]), (2, None), (3, [0.0, None]), (4, [inf, 0.0]), (5, [0.0, 0.0]), (6, [1e200, 0.0]), (7, [1.0, 0.0])]
    asked = spark.createDataFrame([(100, [1.0, 0.0]), (200, None)], VECTORS)
    ids = lambda metric, k: {q: [r.id for r in got if r.query_id == q] for got in [S.knn(spark.createDataFrame(rows, VECTORS), asked, k, metric).orderBy("rank").collect()] for q in (100, 200)}
    for k in (3, 8):  # infinite and NaN after numbers, null last, by SQL's order
        assert ids("l2", k) == {100: [0, 7, 5, 4, 6, 1, 2, 3][:k], 200: list(range(8))[:k]}
        assert ids("cosine", k) == {100: [1, 4, 0, 7, 5, 6, 2, 3][:k], 200: list(range(8))[:k]}  # of row 6 the norm is infinite
    with pytest.raises(Exception, match="differ in length"):
        S.knn(spark.createDataFrame([*rows, (9, [1.0])], VECTORS), asked, 3).collect()
    assert S.knn(spark.createDataFrame([], VECTORS), asked, 3).count() == 0 and S.knn(asked, asked.limit(0), 3).count() == 0


@pytest.mark.parametrize("most", [100, 2])
def test_votes_and_their_ranks(spark, monkeypatch, most):
    for name, value in {"ROW_BLOCK": 50, "QUERY_BLOCK": 4, "TOGETHER": 7, "PER_PARTITION": 8}.items():
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(V, "MOST_BROADCAST", most)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 64))
    rotation = Rotation(64, [64])
    frame = spark.createDataFrame([(1000 + n, n, [float(v) for v in r], n % 9 == 4) for n, r in enumerate(x)], "id long, row_idx long, vector array<double>, deleted boolean").repartition(3)
    rows = encode(frame, "vector", rotation, 1, "fp16")
    asked = frame.where("row_idx < 20").withColumns({"family": (F.col("row_idx") % 8).cast("int"), "threshold": F.when(F.col("row_idx") != 7, 28 + F.col("row_idx") % 3)})
    queries = encode(asked, "vector", rotation).drop("deleted")
    z = rotation.apply(x) >= 0
    want = {}
    for n in range(200):
        hits = {q % 8 for q in range(20) if q != 7 and (z[q] != z[n]).sum() <= 28 + q % 3}
        want[n] = 0 if n % 9 == 4 else sum(1 << f for f in hits)
    masks = V.voting_masks(rows, queries, 64)
    assert {r.row_idx: (r.id, r.mask, r.votes) for r in masks.collect()} == {n: (1000 + n, m, bin(m).count("1")) for n, m in want.items()}
    none = V.voting_masks(rows, queries.where("id < 0"), 64).agg(F.count(F.lit(1)), F.max("mask"), F.max("votes")).first()
    assert tuple(none) == (200, 0, 0)
    half = x.astype(np.float32).astype(np.float16).astype(np.float64)
    cosine = (x[:20] @ half.T / np.linalg.norm(x[:20], axis=1)[:, None] / np.linalg.norm(half, axis=1)).max(axis=0)
    got = V.grid_rerank(masks, rows, asked, 2).collect()
    assert [r.row_idx for r in got] == sorted((n for n in want if bin(want[n]).count("1") >= 2), key=lambda n: -cosine[n])
    assert got and all(abs(r.score - cosine[r.row_idx]) < 1e-12 and r.mask == want[r.row_idx] for r in got)


def test_equal_words_rank_by_row(spark, tmp_path):
    """Rows with the same kept signs are equally far by two bits, whatever their vectors: the lower row comes first."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 64))
    x[200:] = x[199::-1] * 2  # the same signs and masks, in the opposite order
    rows = [(n, [float(v) for v in r], 0) for n, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in QUERIES["cascade_two_bit"](spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert set(got) == {0, 100, 200, 300}
    for found in got.values():  # the shortlist may end between two such rows
        twins = [(n, found.index(399 - a)) for n, a in enumerate(found) if a < 200 and 399 - a in found]
        assert len(found) == 10 and len(twins) > 2 and all(b == a + 1 for a, b in twins)
