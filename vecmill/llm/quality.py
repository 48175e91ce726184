"""Quality rules: base rules, and repetition by suffix array.

Method: the suffix array of a document's words; intervals of its longest common
prefixes find the maximal repeated substrings; the union of their spans bounds
the covered fraction, and the longest repeat is bounded too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vecmill.llm.common import ASCII_SPACE, WordHashes, table

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Repeats of at least so many words count for the method.
MIN_REPEAT = 8
#: Half of the base's limit: repeats of MIN_REPEAT words are among those of WINDOW words, so at 20 % the base fails first.
MAX_COVERED = 0.1
MAX_LONGEST = 50
SYMBOLS = b"#*$%&|<>"


def suffix_repeats(words: np.ndarray) -> np.ndarray:
    """For each position, the length in words of the longest substring that starts there and occurs elsewhere too.

    Ranks are doubled until all suffixes differ. The longest common prefix of
    neighbours in the suffix array follows from the ranks of each round; a
    position's longest repeat is the larger one of its two neighbours'.
    """
    n = len(words)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    # a text has under 2^31 words: the ranks of all rounds are kept in 32 bits
    rounds, width, classes = [rank.astype(np.int32)], 1, int(rank.max()) + 1
    order = None
    while classes < n:
        second = np.full(n, 0, dtype=np.int64)
        second[: max(0, n - width)] = rank[width:] + 1
        pair = rank * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        differs = np.empty(n, dtype=np.int64)
        differs[0] = 0
        ordered = pair[order]
        np.cumsum(ordered[1:] != ordered[:-1], out=differs[1:])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = differs
        classes, width = int(differs[-1]) + 1, width * 2
        rounds.append(rank.astype(np.int32))
    if order is None:
        return np.zeros(n, dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    prefix = np.zeros(n - 1, dtype=np.int64)
    for level in range(len(rounds) - 1, -1, -1):
        known, step = rounds[level], 1 << level
        fits = (a + step <= n) & (b + step <= n)
        same = np.zeros(n - 1, dtype=bool)
        same[fits] = known[a[fits]] == known[b[fits]]
        prefix[same] += step
        a[same] += step
        b[same] += step
    longest = np.zeros(n, dtype=np.int64)
    longest[order[:-1]] = prefix
    longest[order[1:]] = np.maximum(longest[order[1:]], prefix)
    return longest


def covered(longest: np.ndarray, least: int) -> int:
    """Words in the union of the repeats of at least ``least`` words."""
    starts = np.flatnonzero(longest >= least)
    if not len(starts):
        return 0
    edge = np.zeros(len(longest) + 1, dtype=np.int64)
    edge[starts] += 1
    np.add.at(edge, starts + longest[starts], -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None, hashes: WordHashes, window: int = WINDOW, least: int = MIN_REPEAT) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered words, longest repeat."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # splits at [\x20\x09-\x0D], as bytes do
    chars = len(text) - sum(text.count(c) for c in ASCII_SPACE)
    symbols = sum(raw.count(s) for s in (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    longest = suffix_repeats(hashes.of(words))
    return len(words), chars, symbols, dup, covered(longest, window), covered(longest, least), int(longest.max(initial=0))


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def _measured(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = [measure(t.as_py(), hashes) for t in batch.column("text")]
            found = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * len(_COLUMNS))]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in schema.names[: -len(_COLUMNS)]] + found, names=schema.names)

    return run


def quality_measures(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text``) with the measures of each whole text; columns of their names are replaced.

    A null text has no words and one empty line. Nulls elsewhere, repeated rows
    and other columns pass through. No rows give no rows.
    """
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in _COLUMNS])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{c} long" for c in _COLUMNS]
    names = pa.schema([(c, pa.null()) for c in [*kept.columns, *_COLUMNS]])
    return kept.mapInArrow(_measured(names), ", ".join(fields))


BASE_FAILED = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
REPEATS = f"(n_covered > {MAX_COVERED} * n_words OR longest_repeat > {MAX_LONGEST})"


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """The measures with ``base_failed`` and ``kept``; columns of their names are replaced."""
    docs = docs.drop("base_failed", "kept")
    return quality_measures(docs).selectExpr("*", f"{BASE_FAILED} AS base_failed", f"NOT ({BASE_FAILED} OR {REPEATS}) AS kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
e AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS word, len(ws) AS n FROM w),
l AS (SELECT r, count(line) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
g AS (SELECT r, i, k, array_to_string(ws[i:i + k - 1], ' ') AS part FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w CROSS JOIN (VALUES (5), (8)) v(k) WHERE len(ws) >= k)),
c AS (SELECT r, k, count(DISTINCT p) AS n FROM (SELECT r, k, unnest(range(i, i + k)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, k, part) AS m FROM g) WHERE m > 1) GROUP BY r, k),
d AS (SELECT a.r, b.i - a.i AS gap, a.i - row_number() OVER (PARTITION BY a.r, b.i - a.i ORDER BY a.i) AS run FROM e a JOIN e b ON a.r = b.r AND a.word = b.word AND a.i < b.i),
z AS (SELECT r, max(m) AS longest FROM (SELECT r, count(*) AS m FROM d GROUP BY r, gap, run) GROUP BY r),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(c5.n, 0) AS n_repeat_words, coalesce(c8.n, 0) AS n_covered, coalesce(longest, 0) AS longest_repeat
  FROM w LEFT JOIN l ON l.r = w.r LEFT JOIN c c5 ON c5.r = w.r AND c5.k = 5 LEFT JOIN c c8 ON c8.r = w.r AND c8.k = 8 LEFT JOIN z ON z.r = w.r)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_covered > 0.1 * n_words OR longest_repeat > 50) AS kept FROM m
"""
QUERIES = {"op10_quality": op10_quality}
ORACLES = {"op10_quality": ORACLE}
