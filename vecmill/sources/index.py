"""Compiled indexes: a Parquet table and a manifest, written and read by Spark alone."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecmill.functions.transform import Rotation, spectral_energy, tier_for
from vecmill.operators.encode import SIDECARS, bucket_keys, encode
from vecmill.operators.order import numbered

QUANTISATION = {"one_bit": 1, "two_bit": 2, "float32": 0}
METRICS = ("cosine", "l2", "dot")
VERSION = 1


@dataclass
class Manifest:
    dim: int
    tiers: list[int]
    size: int
    quantisation: str = "one_bit"
    sidecar: str = "fp8"
    metric: str = "cosine"
    planet_id: int = 0
    planet_radius: float = 0.0
    buckets: bool = True
    #: A JSON object, or text as it is (raw, or a JSON document for each line).
    user_metadata: dict | str = field(default_factory=dict)
    #: Ranges of rows: partition_id, start_idx, count, domain_tag.
    partitions: list = field(default_factory=list)
    version: int = VERSION
    kind: str = "vecmill-index"

    def check(self) -> Manifest:
        """Raises ValueError for what no writer makes."""
        if self.kind != "vecmill-index" or self.version != VERSION:
            raise ValueError("not an index of this version")
        if not 0 < self.dim <= 65_536 or not 0 <= self.size <= 10**10:
            raise ValueError("dimension or size out of range")
        if self.quantisation not in QUANTISATION or self.sidecar not in SIDECARS or self.metric not in METRICS:
            raise ValueError("unknown quantisation, sidecar or metric")
        Rotation(self.dim, self.tiers)
        for p in self.partitions:
            if not {"partition_id", "start_idx", "count"} <= set(p) or p["start_idx"] < 0 or p["count"] < 0:
                raise ValueError("a partition needs an id, a start and a count")
            if self.size and p["start_idx"] + p["count"] > self.size:
                raise ValueError("a partition is out of range")
        return self

    def metadata_lines(self) -> list:
        """The JSON documents of user_metadata that is text with one on each line."""
        return [json.loads(line) for line in self.user_metadata.splitlines() if line.strip()]


def clean_path(path: str) -> str:
    if not path or not path.strip() or "\0" in path:
        raise ValueError("a path may not be blank or hold NUL")
    scheme, sep, rest = path.partition("://")
    return f"{scheme}://{posixpath.normpath(rest)}" if sep else posixpath.normpath(path)


def build(
    records: DataFrame, dim: int, tiers: list[int] | None = None, quantisation: str = "one_bit", sidecar: str = "fp8", row_idx: bool = True
) -> DataFrame:
    """The index's rows of ``records`` (id, vector; lat and lon, deleted if there): row_idx, id, meta, words, keys, sidecar.

    Row numbers follow the column ``row_idx`` where there is one, else ``position``
    (the input's order: rows of a table have none of their own), else the id;
    repeated values are told apart by their vectors.
    """
    rotation = Rotation(dim, tiers or [dim])
    if quantisation not in QUANTISATION:
        raise ValueError("unknown quantisation")
    order = F.col("position" if "position" in records.columns else "id")
    rows = records if "row_idx" in records.columns or not row_idx else numbered(records, order, F.xxhash64("vector")).drop("position")
    coded = encode(rows, "vector", rotation, max(1, QUANTISATION[quantisation]), sidecar, with_z=quantisation == "float32")
    deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in records.columns else F.lit(False)
    meta = F.lit(2)
    if {"lat", "lon"} <= set(records.columns):
        from vecmill.functions.spatial import morton

        meta = F.coalesce(F.shiftleft(morton(F.col("lat"), F.col("lon")), 16), F.lit(0)).bitwiseOR(F.lit(2))
    meta = meta.cast("long").bitwiseOR(F.when(deleted, 1).otherwise(0).cast("long"))
    return bucket_keys(coded).withColumns({"deleted": deleted, "meta": meta}).drop("vector", "lat", "lon")


class Index:
    """A compiled index: ``rows`` (lazy) and ``manifest``."""

    def __init__(self, spark: SparkSession, path: str | None, manifest: Manifest, rows: DataFrame, weights: np.ndarray | None = None):
        self.spark, self.path, self.manifest, self.rows = spark, path, manifest, rows
        energy = spectral_energy(weights) if weights is not None else None
        self._energy = [float(energy[t - 1]) if energy is not None else t / manifest.dim for t in manifest.tiers]
        self._budget = 0.90

    def set_energy_budget(self, budget: float) -> None:
        tier_for(self._energy, budget)
        self._budget = budget

    @property
    def width(self) -> int:
        """Bits that the first pass compares."""
        return self.manifest.tiers[tier_for(self._energy, self._budget)]

    @property
    def rotation(self) -> Rotation:
        return Rotation(self.manifest.dim, self.manifest.tiers)

    def info(self) -> dict:
        return {**asdict(self.manifest), "tier_count": len(self.manifest.tiers), "has_sidecar": self.manifest.sidecar != "none", "path": self.path}

    def __len__(self) -> int:
        return self.manifest.size

    def checked(self, queries: DataFrame) -> DataFrame:
        """``queries``, whose columns must fit before a job starts; wrong lengths are found as one runs."""
        kinds = dict(queries.dtypes)
        if "id" not in kinds or kinds.get("vector") not in ("array<float>", "array<double>"):
            raise ValueError("queries need an id and a vector of float or double")
        return queries

    def encode_queries(self, queries: DataFrame) -> DataFrame:
        bits = max(1, QUANTISATION[self.manifest.quantisation])
        return bucket_keys(encode(self.checked(queries).select("id", "vector"), "vector", self.rotation, bits, with_z=True))

    def search(self, queries: DataFrame, k: int, strategy: str = "scan") -> DataFrame:
        """(query_id, rank, id, score, distance) for ``queries`` (id, vector); ``mih`` routes by buckets (approximate)."""
        from vecmill.operators.search import cascade, count_queries, knn, score, shortlist

        if k <= 0:
            raise ValueError("k must be positive")
        if strategy not in ("scan", "mih"):
            raise ValueError("strategy: scan or mih")
        m, n, asked = self.manifest, count_queries(queries), self.encode_queries(queries)
        if m.quantisation == "float32":
            live = self.rows.where(~F.col("deleted"))
            rotated = lambda df, name: df.select(F.col(name).alias("id"), F.col("z").alias("vector"))
            found = knn(rotated(live, "row_idx"), rotated(asked, "id"), k, n_queries=n).withColumnRenamed("id", "row_idx")
            found = found.join(live.select("row_idx", "id"), "row_idx")
            return found.select("query_id", "rank", "id", score(F.col("distance"), 1000.0).alias("score"), "distance")
        routed = strategy == "mih"
        most = shortlist(m.size, k, m.sidecar, routed)
        found = cascade(self.rows, asked, k, self.width, most, m.dim, QUANTISATION[m.quantisation], m.sidecar, routed, n_queries=n)
        return found.select("query_id", "rank", "id", score(F.col("distance")).alias("score"), "distance")

    def query_planetary_grid(self, queries: DataFrame, min_votes: int = 5, rerank: bool = True) -> dict:
        """``queries``: id, vector, family, threshold. Masks, the resonant count, and the reranked rows (with a sidecar)."""
        from vecmill.operators.search import count_queries
        from vecmill.operators.vote import grid_rerank, resonant_count, voting_masks

        if self.manifest.quantisation == "float32":
            raise ValueError("voting compares bits, which a float32 index lacks")
        if not {"family", "threshold"} <= set(self.checked(queries).columns):
            raise ValueError("voting queries need a family and a threshold")
        if queries.where("family IS NULL OR family NOT BETWEEN 0 AND 7").limit(1).count():
            raise ValueError("families are 0 to 7")
        n, coded = count_queries(queries), encode(queries, "vector", self.rotation, 1)
        masks = voting_masks(self.rows, coded, self.width, n)
        best = grid_rerank(masks, self.rows, queries, min_votes, n) if rerank and self.manifest.sidecar != "none" else None
        return {"masks": masks, "resonant": resonant_count(masks), "reranked": best}

    def get_vectors(self, indices: int | Iterable[int] | None = None, rotated: bool = False) -> DataFrame:
        """(position, row_idx, id, vector) in the order of ``indices`` (row numbers, which may repeat; one, several, or all).

        Vectors are the decoded sidecar; without one, the signs at unit length, rotated
        back unless ``rotated``. A row number out of range raises ValueError.
        """
        rows = self.rows.withColumn("position", F.col("row_idx"))
        if indices is not None:
            wanted = [int(i) for i in ([indices] if isinstance(indices, (int, np.integer)) else indices)]
            if any(not 0 <= i < self.manifest.size for i in wanted):
                raise ValueError("a row number is out of range")
            asked = self.spark.createDataFrame(list(enumerate(wanted)), "position long, row_idx long")
            rows = self.rows.join(F.broadcast(asked), "row_idx")  # what the caller listed
        if self.manifest.sidecar != "none":
            found = rows.select("position", "row_idx", "id", F.col("vec").alias("vector"))
            return found if indices is None else found.orderBy("position")
        import pyarrow as pa

        from vecmill.functions.transform import unpack_bits

        dim, rotation, names = self.manifest.dim, self.rotation, [c for c in self.rows.columns if c[0] == "s" and c[1:].isdigit()]
        kept = ["position", "row_idx", "id"]

        def run(batches):
            for b in batches:
                words = np.stack([b.column(n).to_numpy() for n in names], axis=1)
                back = np.where(unpack_bits(words, dim), 1.0, -1.0) / np.sqrt(dim)
                back = (back if rotated else rotation.invert(back)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(list(back), pa.list_(pa.float32()))], names=[*kept, "vector"])

        found = rows.select(*kept, *names).mapInArrow(run, "position long, row_idx long, id long, vector array<float>")
        return found if indices is None else found.orderBy("position")

    def partitions(self) -> DataFrame:
        """(partition_id, start_idx, count, domain_tag) of ``partitions`` in the manifest: ranges of rows."""
        rows = [(p["partition_id"], p["start_idx"], p["count"], p.get("domain_tag")) for p in self.manifest.partitions]
        return self.spark.createDataFrame(rows, "partition_id string, start_idx long, count long, domain_tag string")

    def partition_rows(self, partition_id: str) -> DataFrame:
        """The index's rows in that range."""
        for p in self.manifest.partitions:
            if p["partition_id"] == partition_id:
                return self.rows.where(F.col("row_idx").between(p["start_idx"], p["start_idx"] + p["count"] - 1))
        raise KeyError(partition_id)

    def descriptor(self) -> dict:
        """What a reader of the Parquet files needs: where they are, their columns, and the widths of words, keys and sidecar."""
        m = self.manifest
        bytes_of = {"none": 0, "fp16": 2 * m.dim, "fp8": m.dim, "fp4": 9 * -(-m.dim // 16)}
        return {
            **self.info(), "files": f"{self.path}/rows", "columns": dict(self.rows.dtypes), "words": -(-m.dim // 64), "search_width": self.width,
            "energy": list(self._energy), "sidecar_bytes": bytes_of[m.sidecar], "row_bytes": 8 * -(-m.dim // 64) + bytes_of[m.sidecar],
        }


def compile_index(spark: SparkSession, path: str, records: DataFrame, tiers: list[int] | None = None, attached: DataFrame | None = None, **options) -> Index:
    """Writes ``records`` (id, vector) as an index; ``attached`` is a table kept beside it."""
    path = clean_path(path)
    dim = records.select(F.size("vector")).first()
    if dim is None:
        raise ValueError("an index needs records")
    fields = {k: v for k, v in options.items() if k in Manifest.__dataclass_fields__}
    draft = Manifest(dim[0], tiers or [dim[0]], 0, **fields).check()
    build(records, draft.dim, draft.tiers, draft.quantisation, draft.sidecar).write.mode("overwrite").parquet(f"{path}/rows")
    return _finish(spark, path, draft, attached)


def _finish(spark: SparkSession, path: str, draft: Manifest, attached: DataFrame | None) -> Index:
    draft.size = spark.read.parquet(f"{path}/rows").count()
    draft.check()
    if attached is not None:
        attached.write.mode("overwrite").parquet(f"{path}/attached")
    # the manifest comes last: an index without one was not finished
    spark.createDataFrame([(json.dumps(asdict(draft)),)], T.StructType([T.StructField("value", T.StringType())])).coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return load_index(spark, path)


def _frames(spark: SparkSession, batches: Iterable, dim: int, chunk: int):
    """DataFrames of what a stream gives: DataFrames, (ids, matrix), or single records (id, vector), ``chunk`` of them together."""
    held: list[tuple] = []

    def frame() -> DataFrame:
        rows, held[:] = list(held), []
        return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "position long, id long, vector array<float>")

    for batch in batches:
        if isinstance(batch, DataFrame):
            if held:
                yield frame()
            yield batch
            continue
        ids, vectors = batch
        if np.ndim(ids) == 0:
            ids, vectors = [ids], [vectors]
        for i, v in zip(ids, vectors, strict=True):
            if len(v) != dim:
                raise ValueError(f"every vector needs {dim} components")
            held.append((int(i), [float(x) for x in v]))
            if len(held) == chunk:
                yield frame()
    if held:
        yield frame()


def compile_stream(
    spark: SparkSession, path: str, batches: Iterable, dim: int, tiers: list[int] | None = None, total_records: int | None = None, chunk: int = 5000, **options
) -> Index:
    """As ``compile_index``, from an iterable of DataFrames (id, vector), of (ids, matrix) or of (id, vector); what arrived is written.

    Records other than DataFrames are written ``chunk`` at a time, in the order of
    arrival. ``total_records`` is what the stream was to hold: another number raises
    ValueError, before the manifest makes an index of what was written.
    """
    path, start, mode = clean_path(path), 0, "overwrite"
    fields = {k: v for k, v in options.items() if k in Manifest.__dataclass_fields__}
    draft = Manifest(dim, tiers or [dim], 0, **fields).check()
    for batch in _frames(spark, batches, dim, chunk):
        order = F.col("position" if "position" in batch.columns else "id")
        rows = numbered(batch, order, F.xxhash64("vector")).drop("position").withColumn("row_idx", F.col("row_idx") + F.lit(start))
        build(rows, dim, draft.tiers, draft.quantisation, draft.sidecar).write.mode(mode).parquet(f"{path}/rows")
        start, mode = spark.read.parquet(f"{path}/rows").count(), "append"
    if mode == "overwrite":
        raise ValueError("an index needs records")
    if total_records is not None and total_records != start:
        raise ValueError(f"{total_records} records were announced, {start} came")
    return _finish(spark, path, draft, None)


def load_index(spark: SparkSession, path: str, weights: np.ndarray | None = None) -> Index:
    path = clean_path(path)
    text = "\n".join(r.value for r in spark.read.text(f"{path}/manifest").collect())
    try:
        manifest = Manifest(**json.loads(text)).check()
    except (TypeError, json.JSONDecodeError) as e:
        raise ValueError("the manifest is damaged") from e
    rows = spark.read.parquet(f"{path}/rows")
    words = [f"s{k}" for k in range(-(-manifest.dim // 64))]
    needed = {"row_idx", "id", "deleted", "meta", *words, *[f"k{c}" for c in range(4)]}
    needed |= {w.replace("s", "m") for w in words if manifest.quantisation == "two_bit"}
    needed |= {"z"} if manifest.quantisation == "float32" else set()
    needed |= {"vec", "sidecar"} if manifest.sidecar != "none" else set()
    if missing := needed - set(rows.columns):
        raise ValueError(f"the rows lack what the manifest tells of: {sorted(missing)}")
    return Index(spark, path, manifest, rows, weights)


def attached_table(index: Index) -> DataFrame:
    return index.spark.read.parquet(f"{index.path}/attached")


def concatenated(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Rows of the parts in order, with row_idx shifted by the sizes before; nothing is merged or purged."""
    out, shift = None, 0
    for rows, size in parts:
        moved = rows.withColumn("row_idx", F.col("row_idx") + F.lit(shift))
        out, shift = moved if out is None else out.unionByName(moved), shift + size
    return out


def compact_indices(spark: SparkSession, paths: list[str], target: str) -> Index:
    """One index of several that agree in layout."""
    parts = [load_index(spark, p) for p in paths]
    layout = lambda m: (m.planet_id, m.planet_radius, m.dim, m.tiers, m.quantisation, m.sidecar)
    if not parts or any(layout(p.manifest) != layout(parts[0].manifest) for p in parts):
        raise ValueError("indexes must agree in planet, dimension, tiers, quantisation and sidecar")
    path = clean_path(target)
    concatenated([(p.rows, len(p)) for p in parts]).write.mode("overwrite").parquet(f"{path}/rows")
    return _finish(spark, path, parts[0].manifest, None)
