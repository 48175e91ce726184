import glob
import json
import os
from dataclasses import asdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vecmill.database import VectorDb
from vecmill.operators.order import numbered
from vecmill.operators.search import meet, prefixed, through_buckets
from vecmill.plans import registry
from vecmill.plans.registry import ORACLES, QUERIES
from vecmill.sources.index import attached_table, compile_index, compile_stream, load_index
from vecmill.streaming.delta import DeltaBuffer

DATA = "/root/testdata/sf0.001"


def records(spark, n=120, dim=64, start=1000, seed=5):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    return x, spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert len(got) or name == "vote_rerank"  # five anchors of five families: few rows reach the votes
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = lambda d: sorted(map(str, d[columns].astype(object).values.tolist()))
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("sidecar,quantisation", [("fp8", "one_bit"), ("fp4", "one_bit"), ("fp16", "two_bit"), ("none", "one_bit"), ("none", "float32")])
def test_index_round_trip(spark, tmp_path, sidecar, quantisation):
    x, df = records(spark)
    index = compile_index(spark, f"{tmp_path}/i", df, [32, 64], sidecar=sidecar, quantisation=quantisation, user_metadata={"a": 1}, attached=df)
    assert len(index) == 120 and index.info()["user_metadata"] == {"a": 1} and attached_table(index).count() == 120
    assert [r.row_idx for r in index.rows.orderBy("id").collect()] == list(range(120))
    best = {r.query_id: r.id for r in index.search(df.limit(10), 3).where("rank = 1").collect()}
    assert len(best) == 10 and all(q == i for q, i in best.items())
    vectors = np.array([r.vector for r in index.get_vectors([3, 7]).orderBy("row_idx").collect()])
    assert vectors.shape == (2, 64)
    if sidecar != "none":
        assert np.abs(vectors - x[[3, 7]]).max() < (0.12 if sidecar == "fp4" else 0.06)
    with pytest.raises(ValueError):
        index.search(df, 0)


def test_routed_search_and_votes(spark, tmp_path):
    _, df = records(spark)
    index = compile_index(spark, f"{tmp_path}/i", df)
    best = index.search(df.limit(5), 1, strategy="mih").collect()
    assert all(r.query_id == r.id for r in best) and len(best) == 5
    families = df.limit(8).withColumns({"family": (F.col("id") - 1000).cast("int"), "threshold": F.lit(30)})
    grid = index.query_planetary_grid(families, min_votes=1)
    best = [(-r.score, -r.votes, r.row_idx) for r in grid["reranked"].collect()]
    assert grid["masks"].count() == 120 and best and best == sorted(best)
    with pytest.raises(ValueError):
        index.query_planetary_grid(families.withColumn("family", F.lit(8)))


def test_stream_compact_and_damage(spark, tmp_path):
    x, df = records(spark)
    a = compile_stream(spark, f"{tmp_path}/a", ((range(n, n + 40), x[n : n + 40]) for n in (0, 40, 80)), 64)
    b = compile_index(spark, f"{tmp_path}/b", df)
    both = VectorDb(spark).compact_indices([a.path, b.path], f"{tmp_path}/c")
    assert len(both) == 240
    assert [r.row_idx for r in both.rows.select("row_idx").orderBy("row_idx").collect()] == list(range(240))
    other = compile_index(spark, f"{tmp_path}/d", df, sidecar="fp4")
    with pytest.raises(ValueError):
        VectorDb(spark).compact_indices([a.path, other.path], f"{tmp_path}/e")
    with pytest.raises(ValueError):
        load_index(spark, "a\0b")
    spark.createDataFrame([("{",)], "value string").write.mode("overwrite").text(f"{tmp_path}/d/manifest")
    with pytest.raises(ValueError):
        load_index(spark, f"{tmp_path}/d")


def test_delta(spark, tmp_path):
    x, df = records(spark)
    db = VectorDb(spark)
    db.compile_index(f"{tmp_path}/i", df)
    db.load_index("i", f"{tmp_path}/i")
    buffer = db.create_delta_buffer("i", flush_threshold=2)
    far = np.ones(64) / 8
    buffer.insert(99_999, far)
    buffer.insert(100, far * 0.5)
    assert buffer.needs_flush() and buffer.size() == 2
    asked = spark.createDataFrame([(1, [float(v) for v in far])], "id long, vector array<float>")
    assert db.search_merged("i", asked, 3).where("rank = 1").first().id == 99_999
    buffer.backup(f"{tmp_path}/backup")
    assert buffer.delete(99_999) and not buffer.delete(99_999) and not buffer.delete(1000)
    again = DeltaBuffer(spark, buffer.path, 64)
    assert again.size() == 1 and db.search_merged("i", asked, 3).where("id = 99999").isEmpty()
    assert DeltaBuffer.restore(spark, f"{tmp_path}/backup", f"{tmp_path}/other", 64).size() == 2
    with pytest.raises(ValueError):
        buffer.insert(1, [1.0])
    assert len(again.drain(f"{tmp_path}/flushed")) == 1 and again.size() == 0


def test_ingest_beside_inserts_and_deletes(spark, tmp_path):
    x, df = records(spark, 10)
    buffer = DeltaBuffer(spark, f"{tmp_path}/log", 64)
    buffer.insert_many([(n, x[0]) for n in range(5)])

    def ingest(frame):
        frame.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id long, vector array<float>, op int, at long").parquet(f"{tmp_path}/in")
        buffer.ingest(stream, f"{tmp_path}/at", order="at").awaitTermination()

    ingest(df.withColumns({"op": F.lit(1), "at": F.col("id")}))
    assert buffer.size() == 15
    assert buffer.delete(1000) and buffer.delete(3) and not buffer.delete(3)  # of either kind
    assert buffer.size() == 13
    other = DeltaBuffer(spark, buffer.path, 64)
    other.insert(3, x[1])  # again, by another handle
    buffer.insert(4, x[2])
    assert buffer.size() == 15 and other.size() == 15
    # a batch keeps its order: id 77 is deleted and comes again, 78 comes and is deleted
    v = [0.5] * 64
    ingest(spark.createDataFrame([(77, v, 1, 0), (77, None, 2, 1), (77, v, 1, 2), (78, v, 1, 3), (78, None, 2, 4)], "id long, vector array<float>, op int, at long"))
    again = DeltaBuffer(spark, buffer.path, 64)
    assert sorted(r.id for r in again.live().collect()) == [0, 1, 2, 3, 4, 4, 77, *range(1001, 1010)]
    seqs = [r.seq for r in again.log().collect()]
    assert len(seqs) == len(set(seqs))
    again.clear()
    assert again.size() == 0 and buffer.size() == 0


def test_numbers_follow_order_and_ties(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), int(t)) for i, t in zip(rng.integers(0, 20, 500), rng.permutation(500))]
    got = numbered(spark.createDataFrame(rows, "a int, b int").repartition(3), F.col("a"), F.desc("b"), name="n").orderBy("n").collect()
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (r[0], -r[1])) and [r.n for r in got] == list(range(500))
    assert numbered(spark.createDataFrame([], "a int, b int"), F.col("a")).count() == 0


def test_stream_of_records_and_its_total(spark, tmp_path):
    x, _ = records(spark)
    given = [(int(90 - n), x[n]) for n in range(30)] + [(range(200, 260), x[30:90])]
    made = compile_stream(spark, f"{tmp_path}/a", iter(given), 64, total_records=90, chunk=25)
    ids = [r.id for r in made.rows.orderBy("row_idx").collect()]
    assert ids == [90 - n for n in range(30)] + list(range(200, 260))  # in order of arrival, over the chunks' bounds
    for wrong in ({"total_records": 7}, {"dim": 32}):
        with pytest.raises(ValueError):
            compile_stream(spark, f"{tmp_path}/b", iter(given), **({"dim": 64} | wrong))


def test_vectors_by_row_partitions_and_descriptor(spark, tmp_path):
    x, df = records(spark)
    parts = [{"partition_id": "a", "start_idx": 0, "count": 100, "domain_tag": "t"}, {"partition_id": "b", "start_idx": 100, "count": 20}]
    index = compile_index(spark, f"{tmp_path}/i", df, [16, 48, 64], sidecar="fp16", partitions=parts, user_metadata='{"a": 1}\n{"b": 2}\n')
    got = index.get_vectors([7, 3, 7]).collect()
    assert [(r.position, r.row_idx, r.id) for r in got] == [(0, 7, 1007), (1, 3, 1003), (2, 7, 1007)]
    assert np.allclose(index.get_vectors(5).first().vector, x[5], atol=1e-3) and index.get_vectors().count() == 120
    assert [r.id for r in index.partition_rows("b").orderBy("id").collect()] == list(range(1100, 1120)) and index.partitions().count() == 2
    assert index.manifest.metadata_lines() == [{"a": 1}, {"b": 2}]
    told = index.descriptor()
    assert (told["words"], told["sidecar_bytes"], told["search_width"]) == (1, 128, 64)
    for wrong in ([-1], [120]):
        with pytest.raises(ValueError):
            index.get_vectors(wrong)
    with pytest.raises(ValueError):
        compile_index(spark, f"{tmp_path}/j", df, partitions=[{"partition_id": "a", "start_idx": 100, "count": 21}])
    bare = compile_index(spark, f"{tmp_path}/k", df, sidecar="none")
    turned = np.array([r.vector for r in bare.get_vectors(range(120), rotated=True).collect()])
    assert (np.sign(turned) == np.where(bare.rotation.apply(x) >= 0, 1, -1)).all() and np.allclose(np.abs(turned), 1 / 8)


@pytest.mark.parametrize("tiers,budget,width", [([32, 64], 0.4, 32), ([16, 48, 64], 0.7, 48), ([64], 0.9, 64)])
def test_search_by_a_tier(spark, tmp_path, tiers, budget, width):
    x, df = records(spark)
    index = compile_index(spark, f"{tmp_path}/i", df, tiers, sidecar="fp16")
    index.set_energy_budget(budget)
    assert index.width == width
    got = index.search(df.limit(6), 5).collect()
    z = index.rotation.apply(x)[:, :width] >= 0
    for r in got:
        assert r.score == int(min(r.distance * 1e6, 2147483647))
    for q in range(6):
        mine = sorted((r.rank, r.id) for r in got if r.query_id == 1000 + q)
        near = sorted(range(120), key=lambda i: ((z[q] != z[i]).sum(), i))[:100]
        half = x.astype(np.float16).astype(np.float32)
        want = sorted(near, key=lambda i: (((x[q].astype(float) - half[i]) ** 2).sum(), (z[q] != z[i]).sum(), i))[:5]
        assert [i for _, i in mine] == [1000 + i for i in want]


def test_routing_gathers_as_its_passes_say(spark):
    rng = np.random.default_rng(4)
    rows = [(n, n, *[int(v) for v in rng.choice([0, 1, 3, 7, 255], 4)]) for n in range(400)]
    rows[0] = (0, 0, 90, 90, 90, 90)  # nothing equals it, nothing is one bit off
    frame = spark.createDataFrame(rows, "id long, row_idx long, k0 short, k1 short, k2 short, k3 short").withColumn("s0", F.lit(0).cast("long"))
    asked = frame.where("id < 12")
    for candidates in (1, 20, 60, 1000):
        met = meet(frame.drop("id"), prefixed(asked.drop("row_idx")))
        got = {}
        for r in through_buckets(met, asked, candidates).collect():
            got.setdefault(r.q_id, set()).add(r.row_idx)
        for q, _, *qk in rows[:12]:
            def group(k):
                bits = [bin(a ^ b).count("1") for a, b in zip(qk, k)]
                return 0 if 0 in bits else 1 + bits.index(1) if 1 in bits else 5 if bits[0] == 2 else None

            by = {n: group(k) for n, _, *k in rows}
            want = {n for n, g in by.items() if g == 0}
            for g in range(1, 5):
                if len(want) < 2 * candidates:
                    want |= {n for n, h in by.items() if h == g}
            if len(want) < candidates:
                want |= {n for n, h in by.items() if h == 5}
            assert got.get(q, set()) == want  # a row's keys equal its own, so no query is without any


@pytest.mark.parametrize("wrong", [{"version": 9}, {"kind": "other"}, {"dim": 128, "tiers": [128]}, {"dim": 0}, {"size": -1}, {"sidecar": "fp4x"}, {"tiers": [70]}, {"quantisation": "float32"}, {"x": 1}])
def test_damaged_manifests(spark, tmp_path, wrong):
    _, df = records(spark, 10)
    index = compile_index(spark, f"{tmp_path}/i", df, sidecar="fp8")
    told = json.dumps({**asdict(index.manifest), **wrong})
    spark.createDataFrame([(told,)], "value string").write.mode("overwrite").text(f"{tmp_path}/i/manifest")
    with pytest.raises(ValueError):
        load_index(spark, f"{tmp_path}/i")


def test_refusals_before_a_job(spark, tmp_path):
    _, df = records(spark)
    index = compile_index(spark, f"{tmp_path}/i", df)
    for wrong in (df.select("id"), df.withColumn("vector", F.lit("x"))):
        with pytest.raises(ValueError):
            index.search(wrong, 3)
    with pytest.raises(ValueError):
        index.search(df, 3, strategy="other")
    with pytest.raises(ValueError):
        index.query_planetary_grid(df)
    with pytest.raises(Exception, match="components"):
        index.search(df.limit(1).withColumn("vector", F.slice("vector", 1, 3)), 3).collect()


def test_energy_of_second_moments(spark):
    rows = [list(map(float, r.embedding)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    spectrum = lambda x: np.cumsum(v := np.linalg.svd(np.array(x), compute_uv=False) ** 2) / v.sum()
    got = [r.phi for r in QUERIES["energy_phi"](spark, DATA).orderBy("k").collect()]
    assert np.allclose(got, spectrum(rows), atol=1e-9)
    base = np.random.default_rng(3).normal(size=(200, 2)) @ np.random.default_rng(4).normal(size=(2, 8))  # of rank 2
    frame = spark.createDataFrame([([float(v) for v in r],) for r in base] + [(None,)], "vector array<double>")
    got = registry.moment_energy(registry.second_moments(frame, 8), 8)
    assert np.allclose(got, spectrum(base), atol=1e-9) and got[1] > 1 - 1e-9
