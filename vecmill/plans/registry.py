"""All queries over the vector engine, and their SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecmill.functions.spatial import morton
from vecmill.functions.transform import Rotation, rademacher_signs, spectral_energy
from vecmill.operators import search as S
from vecmill.operators import vote as V
from vecmill.operators.encode import bucket_keys, encode
from vecmill.sources.index import Index, Manifest, build, concatenated
from vecmill.streaming.delta import live_view, merge_results

DIM, TIERS, K = 64, [64], 10
#: The query set of all searches: every row whose id is divisible by this, against all rows.
QUERY_STEP = 100
#: Rows that the bits pass on to a sidecar, to the signs, and through the buckets.
CANDIDATES, FEW_CANDIDATES, ROUTED = S.shortlist(None, K, "fp8"), S.shortlist(None, K, "none"), S.shortlist(None, K, "fp8", routed=True)
FAMILIES, THRESHOLD, MIN_VOTES = 8, 30, 3


def _rotation(tiers: list[int] | None = None) -> Rotation:
    return Rotation(DIM, tiers or TIERS)


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("row_idx"), F.col("embedding").alias("vector"), "label")


def _coded(rows: DataFrame, bits=1, sidecar="none", with_z=False, tiers=None) -> DataFrame:
    return bucket_keys(encode(rows, "vector", _rotation(tiers), bits, sidecar, with_z))


def _words(spark, sf_dir, bits=1) -> DataFrame:
    """All rows' words and keys; no vector goes along."""
    return _coded(_base(spark, sf_dir), bits).drop("vector")


def _asked(rows: DataFrame) -> tuple[DataFrame, int]:
    """The query set, and its count; no other row is encoded with it."""
    queries = rows.where(F.col("id") % QUERY_STEP == 0)
    return queries, S.count_queries(queries)


def encode_1bit(spark, sf_dir):
    return _words(spark, sf_dir).select("id", F.col("s0").alias("word"))


def encode_2bit(spark, sf_dir):
    return _words(spark, sf_dir, 2).select("id", F.col("s0").alias("word"), F.col("m0").alias("mask"))


def rotate_norm(spark, sf_dir):
    z = _coded(_base(spark, sf_dir), with_z=True)
    return z.select("id", F.round(F.expr("aggregate(z, 0D, (s, v) -> s + v * v)"), 6).alias("norm"))


def p20_threshold(spark, sf_dir):
    z = _coded(_base(spark, sf_dir), with_z=True)
    return z.select("id", F.round(F.expr(f"element_at(array_sort(transform(z, v -> abs(v))), {int(DIM * 0.2) + 1})"), 6).alias("threshold"))


def mih_keys(spark, sf_dir):
    return _words(spark, sf_dir).select("id", *[F.col(f"k{c}").cast("int").alias(f"k{c}") for c in range(4)])


def _postings(rows: DataFrame) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(c).alias("chunk"), F.col(f"k{c}").cast("int").alias("key")) for c in range(4)])
    return rows.select("row_idx", F.explode(keys).alias("k")).select("row_idx", "k.chunk", "k.key")


def mih_histogram(spark, sf_dir):
    return _postings(_words(spark, sf_dir)).groupBy("chunk", "key").agg(F.count(F.lit(1)).alias("n"))


def mih_postings(spark, sf_dir):
    """Rows of a bucket in order, each with its place: gathered lists would grow with the table.

    Ranges of 2^20 rows are numbered apart, and shifted by what the ranges before hold
    of the bucket, so that no task sees a whole bucket.
    """
    posted = _postings(_words(spark, sf_dir)).withColumn("part", F.col("row_idx").bitwiseAND(F.lit(-(1 << 20))))
    counts = posted.groupBy("chunk", "key", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("chunk", "key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("chunk", "key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    nth = F.row_number().over(Window.partitionBy("chunk", "key", "part").orderBy("row_idx")) - 1
    placed = posted.withColumn("nth", nth).join(shifts, ["chunk", "key", "part"])
    return placed.select("row_idx", "chunk", "key", (F.col("nth") + F.col("shift")).cast("int").alias("place"))


def mih_pass1_candidates(spark, sf_dir):
    queries, n = _asked(_base(spark, sf_dir))
    keys = [f"k{c}" for c in range(4)]
    met = S.meet(_words(spark, sf_dir).select("id", *keys), S.prefixed(_coded(queries).select("id", *keys)), n)
    return met.where(S.probe_group() == 0).select(F.col("q_id").alias("query_id"), "id")


def _gate(spark, sf_dir, bits, label, k=K) -> DataFrame:
    """The ``k`` rows nearest to each query by words alone."""
    queries, n = _asked(_base(spark, sf_dir))
    found = S.nearest_words(_words(spark, sf_dir, bits), _coded(queries, bits), k, DIM, bits, n_queries=n, name=label)
    return found.select(F.col("q_id").alias("query_id"), "rank", "id", label)


def hamming_topk(spark, sf_dir):
    return _gate(spark, sf_dir, 1, "hamming")


def ternary_topk(spark, sf_dir):
    return _gate(spark, sf_dir, 2, "distance")


def _knn(metric):
    def run(spark, sf_dir):
        rows = _base(spark, sf_dir)
        queries, n = _asked(rows)
        found = S.knn(rows, queries, K, metric, n)
        return found.select("query_id", "rank", "id", F.round("distance", 5).alias("distance"))

    return run


def knn_float_mode(spark, sf_dir):
    """Search over rotated floats; the public score is the squared distance in thousandths."""
    queries, n = _asked(_base(spark, sf_dir))
    rotated = lambda rows: _coded(rows, with_z=True).select("id", F.col("z").alias("vector"))
    found = S.knn(rotated(_base(spark, sf_dir)), rotated(queries), K, n_queries=n)
    return found.select("query_id", "rank", "id", S.score(F.col("distance"), 1000.0).alias("score"))


def _decoded(mode):
    def run(spark, sf_dir):
        rows = encode(_base(spark, sf_dir), "vector", _rotation(), 1, mode)
        return rows.select("id", F.posexplode("vec").alias("dim", "v")).select("id", "dim", (F.round(F.col("v").cast("double"), 6) + 0.0).alias("value"))

    return run


def fp8_bytes(spark, sf_dir):
    """The sidecar as it is stored: a byte for each component."""
    rows = encode(_base(spark, sf_dir), "vector", _rotation(), 1, "fp8", decoded=False)
    each = rows.select("id", "sidecar", F.explode(F.sequence(F.lit(0), F.lit(DIM - 1))).alias("dim"))
    return each.select("id", "dim", F.conv(F.hex(F.substring("sidecar", F.col("dim") + 1, F.lit(1))), 16, 10).cast("int").alias("code"))


def _fetch(spark, sf_dir, bits, sidecar, tiers):
    """Encodes the candidates alone."""
    kept = ["q_id", "row_idx", "hamming"]
    return lambda near: _coded(_base(spark, sf_dir).drop("label").join(near, "row_idx").select(*kept, "id", "vector"), bits, sidecar, tiers=tiers)


def _cascade(sidecar, bits=1, width=DIM, tiers=None, routed=False, dead=None, scored=False):
    def run(spark, sf_dir):
        base = _base(spark, sf_dir)
        queries, n = _asked(base)
        live = base.where(~F.expr(dead)) if dead else base
        most = S.shortlist(None, K, sidecar, routed)
        words = _coded(live.select("row_idx", "vector"), bits, tiers=tiers).drop("vector")
        asked = _coded(queries.select("id", "vector"), bits, with_z=True, tiers=tiers)
        found = S.cascade(words, asked, K, width, most, DIM, bits, sidecar, routed, _fetch(spark, sf_dir, bits, sidecar, tiers), n)
        public = [S.score(F.col("distance")).alias("score")] if scored else []
        return found.select("query_id", "rank", "id", "hamming", *public)

    return run


def _family_queries(base: DataFrame) -> tuple[DataFrame, int]:
    """The query set, dealt to the families in turn."""
    queries, n = _asked(base)
    family = ((F.col("id") / QUERY_STEP).cast("long") % FAMILIES).cast("int")
    return queries.withColumns({"family": family, "threshold": F.lit(THRESHOLD)}), n


def _masks(spark, sf_dir) -> DataFrame:
    queries, n = _family_queries(_base(spark, sf_dir))
    return V.voting_masks(_words(spark, sf_dir), _coded(queries), DIM, n)


def vote_mask(spark, sf_dir):
    return _masks(spark, sf_dir).select("id", "mask", "votes")


def vote_resonant_count(spark, sf_dir):
    return V.resonant_count(_masks(spark, sf_dir))


def vote_rerank(spark, sf_dir):
    """Resonant rows in order: score, then votes, both descending."""
    queries, n = _family_queries(_base(spark, sf_dir))
    rows = encode(_base(spark, sf_dir), "vector", _rotation(), 1, "fp8")
    return V.grid_rerank(_masks(spark, sf_dir), rows, queries, MIN_VOTES, n).select("id", "votes", "mask", F.round("score", 5).alias("score"))


def _log(spark, sf_dir) -> DataFrame:
    base = _base(spark, sf_dir)
    inserts = base.where("id % 7 = 0").select(F.col("id").alias("seq"), F.lit(1).alias("op"), (F.col("id") + 100_000).alias("id"), "vector")
    deletes = base.where("id % 21 = 0").select((F.col("id") + 1_000_000).alias("seq"), F.lit(2).alias("op"), (F.col("id") + 100_000).alias("id"), F.lit(None).cast("array<float>").alias("vector"))
    return inserts.unionByName(deletes)


def delta_live(spark, sf_dir):
    return live_view(_log(spark, sf_dir)).select("id", "seq")


def delta_search_merged(spark, sf_dir):
    base, live = _base(spark, sf_dir), live_view(_log(spark, sf_dir))
    asked, n = _asked(base)
    return merge_results(S.knn(base, asked, K, n_queries=n), S.knn(live, asked, K, n_queries=n), K).select("query_id", "rank", "id")


def compact_union(spark, sf_dir):
    base = _base(spark, sf_dir)
    half = base.where("id % 2 = 0").withColumn("row_idx", (F.col("id") / 2).cast("long"))
    other = base.where("id % 2 = 1").withColumn("row_idx", ((F.col("id") - 1) / 2).cast("long"))
    return concatenated([(half, half.count()), (other, other.count())]).select("row_idx", "id")


def _index(spark, sf_dir, sidecar) -> Index:
    """An index of the table that is not written: rows by id, as in a compiled one."""
    base = _base(spark, sf_dir)
    manifest = Manifest(DIM, TIERS, base.count(), sidecar=sidecar)
    return Index(spark, None, manifest, encode(base, "vector", _rotation(), 1, sidecar))


def _each_component(vectors: DataFrame) -> DataFrame:
    each = vectors.select("id", F.posexplode("vector").alias("dim", "v"))
    return each.select("id", "dim", (F.round(F.col("v").cast("double"), 6) + 0.0).alias("value"))


def get_vectors(spark, sf_dir):
    return _each_component(_index(spark, sf_dir, "fp8").get_vectors())


def get_vectors_listed(spark, sf_dir):
    """Row numbers in the caller's order, one of them twice."""
    listed = [17, 3, 256, 3]
    found = _index(spark, sf_dir, "fp8").get_vectors(listed)
    return found.select("position", "row_idx", F.round(F.expr("aggregate(vector, 0D, (s, v) -> s + v)"), 5).alias("total"))


def get_vectors_bits(spark, sf_dir):
    """Without a sidecar: the signs at unit length, in rotated space."""
    return _each_component(_index(spark, sf_dir, "none").get_vectors(rotated=True))


def recall_at_k(spark, sf_dir):
    base = _base(spark, sf_dir)
    queries, n = _asked(base)
    exact = S.knn(base, queries, K, n_queries=n).select("query_id", "id")
    near = _gate(spark, sf_dir, 1, "hamming", CANDIDATES).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("hit").alias("hits"))


def _labelled_pairs(spark, sf_dir) -> DataFrame:
    queries, n = _asked(_base(spark, sf_dir))
    names = ["id", "label", "s0"]
    met = S.meet(_words(spark, sf_dir).select(*names), S.prefixed(_coded(queries).select(*names)), n).where("id <> q_id")
    return met.select("q_id", "id", (F.col("label") == F.col("q_label")).alias("same"), S.hamming(DIM).alias("h"))


def hamming_by_label(spark, sf_dir):
    pairs = _labelled_pairs(spark, sf_dir).groupBy("same")
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("h"), 6).alias("mean"), F.round(F.stddev_samp("h"), 6).alias("std"), F.min("h").alias("low"), F.max("h").alias("high"))


def threshold_sweep_f1(spark, sf_dir):
    """Pairs are counted by distance first (at most 2 * 65 rows); thresholds meet the counts alone."""
    counts = _labelled_pairs(spark, sf_dir).groupBy("same", "h").agg(F.count(F.lit(1)).alias("n"))
    limits = spark.range(20, 41).select(F.col("id").cast("int").alias("threshold"))  # 21 rows
    met = counts.crossJoin(F.broadcast(limits))
    near = F.col("h") <= F.col("threshold")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    sums = met.groupBy("threshold").agg(total(near & F.col("same")).alias("tp"), total(near & ~F.col("same")).alias("fp"), total(~near & F.col("same")).alias("fn"))
    f1 = F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6)
    return sums.withColumn("f1", F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, f1).otherwise(0.0))


def geodetic_morton(spark, sf_dir):
    lat, lon = (F.col("id") * 7 % 181 - 90).cast("double"), (F.col("id") * 13 % 361 - 180).cast("double")
    return _base(spark, sf_dir).select("id", morton(lat, lon).alias("code"))


def second_moments(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """(i, j, m): the sum of x_i * x_j over all vectors; each task passes on one partial sum of dim * dim values.

    Null vectors are left out, and null components count as 0.
    """

    def partial(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = batch.column(0).drop_null()
            if len(x):
                x = x.flatten().fill_null(0).to_numpy(zero_copy_only=False).reshape(len(x), dim).astype(np.float64)
                total += x.T @ x
        i, j = np.divmod(np.arange(dim * dim, dtype=np.int32), dim)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "m"])

    return rows.select("vector").mapInArrow(partial, "i int, j int, m double").groupBy("i", "j").agg(F.sum("m").alias("m"))


def moment_energy(moments: DataFrame, dim: int = DIM) -> np.ndarray:
    """Cumulative spectral energy of ``moments``: its singular values squared are those of a square root's."""
    full = np.zeros((dim, dim))
    for r in moments.collect():  # dim * dim rows
        full[r.i, r.j] = r.m
    values, vectors = np.linalg.eigh((full + full.T) / 2)
    return spectral_energy(vectors * np.sqrt(np.clip(values, 0, None)))


def energy_phi(spark, sf_dir):
    """Cumulative spectral energy of the embeddings' second moments, which partial sums gather (D * D values)."""
    phi = moment_energy(second_moments(_base(spark, sf_dir)))
    return spark.createDataFrame([(k + 1, float(p)) for k, p in enumerate(phi)], "k int, phi double")


def gram_matrix(spark, sf_dir):
    """The second moments that ``energy_phi`` takes its spectrum of."""
    return second_moments(_base(spark, sf_dir)).select("i", "j", F.round("m", 4).alias("m"))


def rerank_cosine(spark, sf_dir):
    rows = _base(spark, sf_dir)
    queries, n = _asked(rows)
    return S.rerank(queries, rows, K, n_queries=n).select("query_id", "rank", "id")


def meta_word(spark, sf_dir):
    """An index row's metadata word: the tombstone, the live mark, and the place's Morton code above them."""
    lat, lon = (F.col("id") * 7 % 181 - 90).cast("double"), (F.col("id") * 13 % 361 - 180).cast("double")
    records = _base(spark, sf_dir).withColumns({"lat": lat, "lon": lon, "deleted": F.col("id") % 3 == 1})
    return build(records, DIM, TIERS, sidecar="none").select("id", "meta")


QUERIES = {
    "encode_1bit": encode_1bit, "encode_2bit": encode_2bit, "rotate_norm": rotate_norm, "p20_threshold": p20_threshold,
    "mih_keys": mih_keys, "mih_histogram": mih_histogram, "mih_postings": mih_postings, "mih_pass1_candidates": mih_pass1_candidates,
    "mih_search": _cascade("fp8", routed=True), "hamming_topk": hamming_topk, "ternary_topk": ternary_topk, "knn_l2": _knn("l2"), "knn_cosine": _knn("cosine"),
    "knn_float_mode": knn_float_mode, "fp8_codes": _decoded("fp8"), "fp8_bytes": fp8_bytes, "fp4_codes": _decoded("fp4"), "fp16_codes": _decoded("fp16"),
    "cascade_fp8": _cascade("fp8"), "cascade_fp4": _cascade("fp4"), "cascade_fp16": _cascade("fp16"), "cascade_none": _cascade("none"),
    "cascade_two_bit": _cascade("none", 2), "cascade_two_tiers": _cascade("fp8", width=32, tiers=[32, 64]),
    "cascade_three_tiers": _cascade("fp8", width=48, tiers=[16, 48, 64]), "search_scores": _cascade("fp8", scored=True),
    "tombstone_filter": _cascade("fp8", dead="id % 3 = 1"), "vote_mask": vote_mask,
    "vote_resonant_count": vote_resonant_count, "vote_rerank": vote_rerank, "delta_live": delta_live,
    "delta_search_merged": delta_search_merged, "compact_union": compact_union, "get_vectors": get_vectors,
    "get_vectors_listed": get_vectors_listed, "get_vectors_bits": get_vectors_bits, "recall_at_k": recall_at_k,
    "hamming_by_label": hamming_by_label, "threshold_sweep_f1": threshold_sweep_f1, "geodetic_morton": geodetic_morton, "meta_word": meta_word,
    "gram_matrix": gram_matrix, "energy_phi": energy_phi, "rerank_cosine": rerank_cosine,
}

# --- SQL ---------------------------------------------------------------------

_SIGNS = "[" + ",".join(str(int(s)) for s in rademacher_signs(DIM)) + "]"
_E = f"""e AS (SELECT vec_id AS id, label, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
z AS (SELECT id, label, i, sum(x * ({_SIGNS})[j + 1] * (CASE WHEN bit_count(CAST(i & j AS INTEGER)) % 2 = 0 THEN 1 ELSE -1 END)) / 8.0 AS z
  FROM e CROSS JOIN (SELECT unnest(range({DIM})) AS i) GROUP BY id, label, i),
p AS (SELECT id, list_sort(list(abs(z)))[{int(DIM * 0.2) + 1}] AS t FROM z GROUP BY id)"""
_WRAP = "CAST(CASE WHEN {0} >= 9223372036854775808 THEN {0} - 18446744073709551616 ELSE {0} END AS BIGINT)"
_BIT = "sum(CASE WHEN {0} THEN CAST(pow(2, i) AS HUGEINT) ELSE 0 END)"
_KEYS = "k AS (SELECT id, chunk, CAST(sum(CASE WHEN z >= 0 THEN 1 << (i - 8 * chunk) ELSE 0 END) AS INTEGER) AS key FROM (SELECT id, i, z, CAST(i // 8 AS INTEGER) AS chunk FROM z WHERE i < 32) GROUP BY id, chunk)"
_HAM = f"""h AS (SELECT q.id AS query_id, r.id, any_value(q.label) AS q_label, any_value(r.label) AS label, CAST(sum(CASE WHEN (q.z >= 0) <> (r.z >= 0) THEN 1 ELSE 0 END) AS INTEGER) AS hamming
  FROM z q JOIN z r ON q.i = r.i WHERE q.id % {QUERY_STEP} = 0 GROUP BY q.id, r.id)"""
_TOP = "SELECT query_id, CAST(rank AS INTEGER) AS rank, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM {src}) WHERE rank <= " + str(K)
#: The nearest FP8 value, halves away from zero.
_FP8 = """(CASE WHEN abs(x) >= 448 THEN 448 WHEN abs(x) < pow(2, -10) THEN 0 WHEN abs(x) < pow(2, -6) THEN least(floor(abs(x) * 512 + 0.5), 7) / 512
  ELSE least(448, floor(abs(x) / pow(2, floor(log2(abs(x)))) * 8 + 0.5) / 8 * pow(2, floor(log2(abs(x))))) END * CASE WHEN x < 0 THEN -1 ELSE 1 END)"""
_F8 = f"f AS (SELECT id, j, {_FP8} AS v FROM e)"
_BEST = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hamming, id) AS n FROM h{w}) WHERE n <= {n})"
_L2 = "l AS (SELECT c.query_id, c.id, c.hamming, sum((q.x - f.v) * (q.x - f.v)) AS d FROM c JOIN e q ON q.id = c.query_id JOIN f ON f.id = c.id AND f.j = q.j GROUP BY ALL)"
_FAM = f"""v AS (SELECT q.id // {QUERY_STEP} % {FAMILIES} AS family, r.id, q.id AS qid, sum(CASE WHEN (q.z >= 0) <> (r.z >= 0) THEN 1 ELSE 0 END) AS hamming FROM z q JOIN z r ON q.i = r.i
  WHERE q.id % {QUERY_STEP} = 0 GROUP BY ALL),
w AS (SELECT id, family, max(CASE WHEN hamming <= {THRESHOLD} THEN 1 ELSE 0 END) AS hit FROM v GROUP BY id, family),
m AS (SELECT id, CAST(sum(hit << family) AS INTEGER) AS mask, CAST(sum(hit) AS INTEGER) AS votes FROM w GROUP BY id)"""
_PAIR = f"SELECT q.vec_id AS query_id, r.vec_id AS id, {{d}} AS d FROM embeddings q CROSS JOIN embeddings r WHERE q.vec_id % {QUERY_STEP} = 0"
_D2 = "list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))"
_DOT = "list_sum(list_transform(list_zip({0}.embedding, {1}.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2]))"
_COS = f"({_DOT.format('q', 'r')} / (sqrt({_DOT.format('q', 'q')}) * sqrt({_DOT.format('r', 'r')})))"
_LAB = "g AS (SELECT label = q_label AS same, hamming AS h FROM h WHERE id <> query_id)"
_NEAR = _BEST.format(w="", n=CANDIDATES)


def _casc(cols="id, hamming", values=_F8, ham=_HAM, best=_NEAR, e=_E) -> str:
    return f"WITH {e}, {ham}, {values}, {best}, {_L2} " + _TOP.format(cols=cols, order="d, hamming, id", src="l")


#: The rotation by tiers: within a block at ``start`` of a power of two, signs by the parity of i & j.
def _tiered(blocks: list[tuple[int, int]], width: int) -> tuple[str, str]:
    start = "CASE " + " ".join(f"WHEN {{0}} >= {a} THEN {a}" for a, _ in reversed(blocks)) + " END"
    size = "CASE " + " ".join(f"WHEN {{0}} >= {a} THEN {b}" for a, b in reversed(blocks)) + " END"
    i, j = start.format("i"), start.format("j")
    sign = f"CASE WHEN bit_count(CAST((i - ({i})) & (j - ({j})) AS INTEGER)) % 2 = 0 THEN 1 ELSE -1 END"
    e = f"""e AS (SELECT vec_id AS id, label, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
z AS (SELECT id, label, i, sum(x * ({_SIGNS})[j + 1] * ({sign})) / sqrt(any_value({size.format("i")})) AS z
  FROM e CROSS JOIN (SELECT unnest(range({DIM})) AS i) WHERE ({i}) = ({j}) GROUP BY id, label, i)"""
    return e, _HAM.replace("ON q.i = r.i", f"ON q.i = r.i AND q.i < {width}")


#: Nearest half-precision value, halves to even; nearest FP4 level, halves to the smaller, times the block's FP8 scale.
_F16 = """f AS (SELECT id, j, CASE WHEN abs(x) < pow(2, -14) THEN round_even(x * 16777216, 0) / 16777216
  ELSE round_even(x / pow(2, floor(log2(abs(x)))) * 1024, 0) / 1024 * pow(2, floor(log2(abs(x)))) END AS v FROM e)"""
_F4 = f"""u AS (SELECT id, j, x AS y, max(abs(x)) OVER (PARTITION BY id, j // 16) / 6 AS x FROM e),
f AS (SELECT id, j, CASE WHEN x = 0 THEN 0 ELSE (CASE WHEN y < 0 THEN -1 ELSE 1 END) * {_FP8} * (CASE WHEN abs(y) / x <= 0.25 THEN 0 WHEN abs(y) / x <= 0.75 THEN 0.5
  WHEN abs(y) / x <= 1.25 THEN 1 WHEN abs(y) / x <= 1.75 THEN 1.5 WHEN abs(y) / x <= 2.5 THEN 2 WHEN abs(y) / x <= 3.5 THEN 3 WHEN abs(y) / x <= 5 THEN 4 ELSE 6 END) END AS v FROM u)"""
_CODES = "SELECT id, CAST(j AS INTEGER) AS dim, round(v, 6) + 0.0 AS value FROM f"
#: Passes of the routing: 0 by equal keys, 1 to 4 by one other bit in that chunk, 5 by two in the first; and how far each query goes.
_ROUTE = f"""{_KEYS},
g AS (SELECT q.id AS query_id, r.id, min(CASE bit_count(xor(q.key, r.key)) WHEN 0 THEN 0 WHEN 1 THEN 1 + q.chunk WHEN 2 THEN CASE WHEN q.chunk = 0 THEN 5 END END) AS g
  FROM k q JOIN k r ON q.chunk = r.chunk WHERE q.id % {QUERY_STEP} = 0 GROUP BY q.id, r.id),
p1 AS (SELECT query_id, count(*) FILTER (WHERE g < 1) AS b1, count(*) FILTER (WHERE g < 2) AS b2, count(*) FILTER (WHERE g < 3) AS b3, count(*) FILTER (WHERE g < 4) AS b4,
  count(*) FILTER (WHERE g < 5) AS b5, count(g) AS b6 FROM g GROUP BY query_id),
r AS (SELECT g.query_id, g.id FROM g JOIN p1 ON p1.query_id = g.query_id WHERE CASE g WHEN 0 THEN true WHEN 1 THEN b1 < {2 * ROUTED} WHEN 2 THEN b2 < {2 * ROUTED}
  WHEN 3 THEN b3 < {2 * ROUTED} WHEN 4 THEN b4 < {2 * ROUTED} WHEN 5 THEN b5 < {ROUTED} ELSE b6 = 0 AND id < {ROUTED} END)"""
_ROUTED = f"{_ROUTE}, c AS (SELECT * FROM (SELECT h.*, row_number() OVER (PARTITION BY h.query_id ORDER BY hamming, h.id) AS n FROM h JOIN r ON r.query_id = h.query_id AND r.id = h.id) WHERE n <= {ROUTED})"
_ASYM = "l AS (SELECT c.query_id, c.id, c.hamming, sum({term}) AS d FROM c JOIN z q ON q.id = c.query_id JOIN z r ON r.id = c.id AND r.i = q.i {more} GROUP BY c.query_id, c.id, c.hamming)"
_SPREAD = "list_sum(list_transform(range(24), lambda b: ((({0}) >> b) & 1) << (2 * b + {1})))"
_LAT, _LON = "CAST(floor((vec_id * 7 % 181) / 180.0 * 16777215) AS BIGINT)", "CAST(floor((vec_id * 13 % 361) / 360.0 * 16777215) AS BIGINT)"
_TERN = f"""t AS (SELECT q.id AS query_id, r.id, CAST(sum(CASE WHEN abs(q.z) >= pq.t AND abs(r.z) >= pr.t AND (q.z >= 0) <> (r.z >= 0) THEN 4
  WHEN (abs(q.z) >= pq.t) <> (abs(r.z) >= pr.t) THEN 1 ELSE 0 END) AS INTEGER) AS distance
  FROM z q JOIN z r ON q.i = r.i JOIN p pq ON pq.id = q.id JOIN p pr ON pr.id = r.id WHERE q.id % {QUERY_STEP} = 0 GROUP BY q.id, r.id)"""

ORACLES = {
    "encode_1bit": f"WITH {_E}, w AS (SELECT id, {_BIT.format('z >= 0')} AS w FROM z GROUP BY id) SELECT id, {_WRAP.format('w')} AS word FROM w",
    "encode_2bit": f"WITH {_E}, w AS (SELECT z.id, {_BIT.format('z >= 0 AND abs(z) >= t')} AS w, {_BIT.format('abs(z) >= t')} AS m FROM z JOIN p ON p.id = z.id GROUP BY z.id) SELECT id, {_WRAP.format('w')} AS word, {_WRAP.format('m')} AS mask FROM w",
    "rotate_norm": "SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS norm FROM embeddings",
    "p20_threshold": f"WITH {_E} SELECT id, round(t, 6) AS threshold FROM p",
    "mih_keys": f"WITH {_E}, {_KEYS} SELECT id, " + ", ".join(f"max(key) FILTER (WHERE chunk = {c}) AS k{c}" for c in range(4)) + " FROM k GROUP BY id",
    "mih_histogram": f"WITH {_E}, {_KEYS} SELECT chunk, key, count(*) AS n FROM k GROUP BY chunk, key",
    "mih_postings": f"WITH {_E}, {_KEYS} SELECT id AS row_idx, chunk, key, CAST(row_number() OVER (PARTITION BY chunk, key ORDER BY id) - 1 AS INTEGER) AS place FROM k",
    "mih_pass1_candidates": f"WITH {_E}, {_KEYS} SELECT DISTINCT q.id AS query_id, r.id FROM k q JOIN k r ON q.chunk = r.chunk AND q.key = r.key WHERE q.id % {QUERY_STEP} = 0",
    "hamming_topk": f"WITH {_E}, {_HAM} " + _TOP.format(cols="id, hamming", order="hamming, id", src="h"),
    "ternary_topk": f"WITH {_E}, {_TERN} " + _TOP.format(cols="id, distance", order="distance, id", src="t"),
    "knn_l2": _TOP.format(cols="id, round(d, 5) AS distance", order="d, id", src=f"({_PAIR.format(d=_D2)})"),
    "knn_cosine": _TOP.format(cols="id, round(d, 5) AS distance", order="d DESC, id", src=f"({_PAIR.format(d=_COS)})"),
    "knn_float_mode": _TOP.format(cols="id, CAST(trunc(least(d * 1000, 2147483647)) AS INTEGER) AS score", order="d, id", src=f"({_PAIR.format(d=_D2)})"),
    "fp8_codes": f"WITH {_E}, {_F8} {_CODES}", "fp4_codes": f"WITH {_E}, {_F4} {_CODES}", "fp16_codes": f"WITH {_E}, {_F16} {_CODES}",
    "fp8_bytes": f"WITH {_E}, {_F8}, g AS (SELECT f.id, f.j, abs(v) AS v, e.x < 0 AS minus FROM f JOIN e ON e.id = f.id AND e.j = f.j) SELECT id, CAST(j AS INTEGER) AS dim, CAST(CASE WHEN v < pow(2, -6) THEN v * 512 ELSE (floor(log2(v)) + 7) * 8 + (v / pow(2, floor(log2(v))) - 1) * 8 END AS INTEGER) + CASE WHEN minus THEN 128 ELSE 0 END AS code FROM g",
    "get_vectors": f"WITH {_E}, {_F8} {_CODES}",
    "get_vectors_listed": f"WITH {_E}, {_F8} SELECT position, row_idx, round(sum(v), 5) AS total FROM f JOIN (VALUES (0::BIGINT, 17::BIGINT), (1, 3), (2, 256), (3, 3)) l(position, row_idx) ON f.id = row_idx GROUP BY position, row_idx",
    "get_vectors_bits": f"WITH {_E} SELECT id, CAST(i AS INTEGER) AS dim, CASE WHEN z >= 0 THEN 0.125 ELSE -0.125 END::DOUBLE AS value FROM z",
    "cascade_fp8": _casc(), "cascade_fp4": _casc(values=_F4), "cascade_fp16": _casc(values=_F16),
    "cascade_two_tiers": _casc(e=_tiered([(0, 32), (32, 32)], 32)[0], ham=_tiered([(0, 32), (32, 32)], 32)[1]),
    "cascade_three_tiers": _casc(e=_tiered([(0, 16), (16, 32), (48, 16)], 48)[0], ham=_tiered([(0, 16), (16, 32), (48, 16)], 48)[1]),
    "search_scores": _casc(cols="id, hamming, CAST(trunc(least(d * 1000000, 2147483647)) AS INTEGER) AS score"),
    "mih_search": _casc(best=_ROUTED),
    "tombstone_filter": _casc(best=_BEST.format(w=" WHERE id % 3 <> 1", n=CANDIDATES)),
    "cascade_none": f"WITH {_E}, {_HAM}, {_BEST.format(w='', n=FEW_CANDIDATES)}, " + _ASYM.format(term="(q.z - CASE WHEN r.z >= 0 THEN 1 ELSE -1 END) ** 2", more="") + " " + _TOP.format(cols="id, hamming", order="d, hamming, id", src="l"),
    "cascade_two_bit": f"WITH {_E}, {_TERN}, h AS (SELECT query_id, id, distance AS hamming FROM t), {_BEST.format(w='', n=FEW_CANDIDATES)}, "
    + _ASYM.format(term="(q.z - CASE WHEN abs(r.z) < p.t THEN 0 WHEN r.z >= 0 THEN 1 ELSE -1 END) ** 2", more="JOIN p ON p.id = r.id") + " " + _TOP.format(cols="id, hamming", order="d, hamming, id", src="l"),
    "vote_mask": f"WITH {_E}, {_FAM} SELECT id, mask, votes FROM m",
    "vote_resonant_count": f"WITH {_E}, {_FAM} SELECT count(*) AS resonant_count FROM m WHERE votes >= 5",
    "vote_rerank": f"""WITH {_E}, {_FAM}, {_F8}, s AS (SELECT m.id, votes, mask, q.id AS qid, sum(q.x * f.v) / (sqrt(sum(q.x * q.x)) * sqrt(sum(f.v * f.v))) AS s
  FROM m JOIN f ON f.id = m.id JOIN e q ON q.j = f.j WHERE votes >= {MIN_VOTES} AND q.id % {QUERY_STEP} = 0 GROUP BY ALL), t AS (SELECT id, votes, mask, max(s) AS s FROM s GROUP BY id, votes, mask)
  SELECT id, votes, mask, round(s, 5) AS score FROM t""",
    "delta_live": "SELECT vec_id + 100000 AS id, vec_id AS seq FROM embeddings WHERE vec_id % 7 = 0 AND vec_id % 21 <> 0",
    "delta_search_merged": "WITH " + f"b AS ({_PAIR.format(d=_D2)}), u AS (SELECT *, 0 AS side FROM b UNION ALL SELECT query_id, id + 100000, d, 1 FROM b WHERE id % 7 = 0 AND id % 21 <> 0) " + _TOP.format(cols="id", order="d, side, id", src="u"),
    "compact_union": "SELECT CAST(row_number() OVER (ORDER BY vec_id % 2, vec_id) - 1 AS BIGINT) AS row_idx, vec_id AS id FROM embeddings",
    "recall_at_k": f"WITH {_E}, {_HAM}, {_NEAR}, x AS ({_TOP.format(cols='id', order='d, id', src=f'({_PAIR.format(d=_D2)})')}) SELECT x.query_id, count(c.id) AS hits FROM x LEFT JOIN c ON c.query_id = x.query_id AND c.id = x.id GROUP BY x.query_id",
    "hamming_by_label": f"WITH {_E}, {_HAM}, {_LAB} SELECT same, count(*) AS n, round(avg(h), 6) AS mean, round(stddev_samp(h), 6) AS std, min(h) AS low, max(h) AS high FROM g GROUP BY same",
    "threshold_sweep_f1": f"WITH {_E}, {_HAM}, {_LAB}, s AS (SELECT CAST(t AS INTEGER) AS threshold, count(*) FILTER (WHERE h <= t AND same) AS tp, count(*) FILTER (WHERE h <= t AND NOT same) AS fp, count(*) FILTER (WHERE h > t AND same) AS fn FROM g CROSS JOIN (SELECT unnest(range(20, 41)) AS t) GROUP BY t) SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2.0 * tp / (2 * tp + fp + fn), 6) ELSE 0 END AS f1 FROM s",
    "geodetic_morton": f"SELECT vec_id AS id, CAST({_SPREAD.format(_LON, 0)} + {_SPREAD.format(_LAT, 1)} AS BIGINT) AS code FROM embeddings",
    "rerank_cosine": _TOP.format(cols="id", order="d DESC, id", src=f"({_PAIR.format(d=_COS)})"),
    "gram_matrix": "WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT CAST(a.j AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, round(sum(a.x * b.x), 4) AS m FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY a.j, b.j",
    "meta_word": f"WITH w AS (SELECT vec_id AS id, CAST((({_SPREAD.format(_LON, 0)} + {_SPREAD.format(_LAT, 1)}) << 16) AS HUGEINT) + 2 + CASE WHEN vec_id % 3 = 1 THEN 1 ELSE 0 END AS w FROM embeddings) SELECT id, {_WRAP.format('w')} AS meta FROM w",
}
