"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from vecmill.llm import (
    line_dedup,
    mixing,
    near_dedup,
    packing,
    quality,
    secret_scan,
    sharding,
    topk,
    url_filter,
    warc,
)

_MODULES = (line_dedup, secret_scan, sharding, warc, near_dedup, url_filter, topk, packing, mixing, quality)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
