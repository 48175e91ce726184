"""Encoding of vector tables in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.functions import codecs
from vecmill.functions.transform import Rotation, quantise

SIDECARS = ("none", "fp16", "fp8", "fp4")


def words_of(dim: int) -> int:
    return -(-dim // 64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float32)
    if len(flat) != len(column) * dim:
        raise ValueError(f"every vector needs {dim} components")
    return flat.reshape(len(column), dim)


def encode(
    df: DataFrame, vector_col: str, rotation: Rotation, bits: int = 1, sidecar: str = "none", with_z: bool = False, decoded: bool = True
) -> DataFrame:
    """``df`` with words s0, s1, ... (and masks m0, ... with 2 bits), ``vec`` (decoded sidecar), ``sidecar``, ``z``.

    Words are scalar columns, so that distances stay in generated code and only
    those of the tiers asked for are read.
    """
    if sidecar not in SIDECARS or bits not in (1, 2):
        raise ValueError("unknown sidecar or bits")
    dim, n_words = rotation.dim, words_of(rotation.dim)
    masks = [f"m{k}" for k in range(n_words)] if bits == 2 else []
    names = [f"s{k}" for k in range(n_words)] + masks
    floats = (["vec"] if sidecar != "none" and decoded else []) + (["z"] if with_z else [])
    keep = [c for c in df.columns if c not in (*names, *floats, "sidecar")]
    raw = ["sidecar"] if sidecar != "none" else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(vector_col), dim)
            z = rotation.apply(x)
            signs, mask = quantise(z, bits)
            columns = list(signs.T) + (list(mask.T) if mask is not None else [])
            arrays = [batch.column(c) for c in keep] + [pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns]
            lists = lambda v, t: pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1] or 1), pa.int32()), pa.array(v.ravel(), t))
            if raw:
                code = codecs.encode(x, sidecar)
                if decoded:
                    arrays.append(lists(codecs.decode(code, sidecar, dim).astype(np.float32), pa.float32()))
            if with_z:
                arrays.append(lists(z, pa.float64()))
            if raw:
                arrays.append(pa.array([r.tobytes() for r in code], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names, *floats, *raw])

    types = {"vec": "array<float>", "z": "array<double>"}
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema]
    schema += [f"{n} long" for n in names] + [f"{n} {types[n]}" for n in floats] + [f"{n} binary" for n in raw]
    return df.mapInArrow(run, ", ".join(schema))


def bucket_keys(df: DataFrame) -> DataFrame:
    """``df`` (encoded) with k0 to k3, the four low bytes of the first word."""
    byte = lambda k: F.shiftrightunsigned("s0", 8 * k).bitwiseAND(F.lit(255)).cast("short")
    return df.withColumns({f"k{k}": byte(k) for k in range(4)})
