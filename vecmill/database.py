"""Handles by name: indexes and their mutation logs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from vecmill.functions.transform import Rotation, quantise
from vecmill.sources import index as store
from vecmill.streaming.delta import DeltaBuffer, search_merged


class VectorDb:
    def __init__(self, spark: SparkSession):
        self.spark, self._indexes, self._buffers = spark, {}, {}

    def __enter__(self) -> VectorDb:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self._indexes.clear()
        self._buffers.clear()

    def load_index(self, name: str, path: str, weights: np.ndarray | None = None) -> store.Index:
        self._indexes[name] = store.load_index(self.spark, path, weights)
        return self._indexes[name]

    def get_index(self, name: str) -> store.Index:
        return self._indexes[name]

    def drop_index(self, name: str) -> None:
        del self._indexes[name]
        self._buffers.pop(name, None)

    def create_delta_buffer(self, name: str, flush_threshold: int = 10_000) -> DeltaBuffer:
        index = self._indexes[name]
        self._buffers[name] = DeltaBuffer(self.spark, f"{index.path}-log", index.manifest.dim, flush_threshold)
        return self._buffers[name]

    def get_delta_buffer(self, name: str) -> DeltaBuffer:
        return self._buffers[name]

    def search(self, name: str, queries: DataFrame, k: int, strategy: str = "scan") -> DataFrame:
        return self._indexes[name].search(queries, k, strategy)

    def search_merged(self, name: str, queries: DataFrame, k: int, upsert: bool = False) -> DataFrame:
        return search_merged(self._indexes[name], self._buffers[name], queries, k, upsert)

    def compile_index(self, path: str, records: DataFrame, **options) -> store.Index:
        return store.compile_index(self.spark, path, records, **options)

    def compile_stream(self, path: str, batches, dim: int, **options) -> store.Index:
        return store.compile_stream(self.spark, path, batches, dim, **options)

    def compact_indices(self, paths: list[str], target: str) -> store.Index:
        return store.compact_indices(self.spark, paths, target)

    @staticmethod
    def transform_and_quantize(x: np.ndarray, tiers: list[int], bits: int = 1) -> tuple[np.ndarray, np.ndarray | None]:
        x = np.atleast_2d(x)
        return quantise(Rotation(x.shape[1], tiers).apply(x), bits)
