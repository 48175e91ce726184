"""Secret scans over an incremental ledger of blobs.

Method: every historical version of a text is addressed by its content; only
pairs of blob and rule version that the ledger lacks are scanned; the findings
are joined back to all paths that hold the blob.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm.common import cut, shared_table, table

Span = tuple[int, int]


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``find`` gives the spans (code points, end exclusive) of a text.

    A change of ``find`` needs a new ``version``: the ledger goes by both.
    """

    kind: str
    version: int
    find: Callable[[str, str], list[Span]]

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
# A run is taken whole, so a bound in the pattern drops just what a later test would.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY-----)")
_SIGNED = re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")


def _assign(text: str, low: str) -> list[Span]:
    if not any(w in low for w in _ASSIGN_WORDS):
        return []
    return [m.span() for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]


def _pem(text: str, low: str) -> list[Span]:
    """Whole blocks, from BEGIN to the END of the same kind; where there is none, the BEGIN line."""
    if "-----BEGIN" not in text:
        return []
    out, at, open_kinds = [], 0, set()
    while m := _PEM.search(text, at):
        # a kind without an END from here on has none further on either
        end = -1 if m[1] in open_kinds else text.find(f"-----END {m[1]}", m.end())
        if end < 0:
            open_kinds.add(m[1])
            at = m.end()
        else:
            at = end + len("-----END ") + len(m[1])
        out.append((m.start(), at))
    return out


#: In the order in which spans of one start are listed.
RULES = (
    Rule("assign", 1, _assign),
    Rule("access", 1, lambda t, low: [m.span() for m in _ACCESS.finditer(t)]),
    Rule("hex", 1, lambda t, low: [m.span() for m in _HEX.finditer(t)]),
    Rule("pem", 2, _pem),
    Rule("signed", 1, lambda t, low: [m.span() for m in _SIGNED.finditer(t)] if "eyJ" in t else []),
)
BASE = ("assign", "access", "hex")

LEDGER = "blob string, rules array<string>, findings array<struct<kind: string, start: long, end: long>>"


def _scan(rules: tuple[Rule, ...]):
    out = pa.schema([
        ("blob", pa.string()),
        ("rules", pa.list_(pa.string())),
        ("findings", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, pending, found = batch.column("blob").to_pylist(), batch.column("pending").to_pylist(), []
            for text, keys in zip(batch.column("text"), pending):
                text, keys = text.as_py(), set(keys)
                low = text.lower()
                found.append([
                    {"kind": r.kind, "start": a, "end": b} for r in rules if r.key in keys for a, b in r.find(text, low)
                ])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((blobs, pending, found), out)], schema=out)

    return run


def new_ledger(spark: SparkSession) -> DataFrame:
    """A ledger of nothing."""
    return spark.createDataFrame([], LEDGER)


def scan_unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows to append to the ledger: one for each blob of ``versions`` with unscanned rules.

    ``versions`` has ``blob`` and ``text``; a blob counts once, however many rows hold it.
    """
    keys = F.array(*[F.lit(r.key) for r in rules])
    done = cut(ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done")))
    todo = (
        versions.select("blob", "text")
        .join(done, "blob", "left")
        .withColumn("pending", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>"))))
        .where(F.size("pending") > 0)
        .select("blob", "text", "pending")
        .dropDuplicates(["blob"])
    )
    return todo.mapInArrow(_scan(rules), LEDGER)


def with_blobs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``blob``, the SHA-256 of the text (a null text is empty)."""
    return docs.withColumn("blob", F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))


def findings_by_path(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``paths`` (with ``blob``) with ``findings``: those of the current rules, by start and rule order.

    Paths whose blob the ledger lacks get null.
    """
    live = F.array(*[F.lit(r.kind) for r in rules])
    current = F.array(*[F.lit(r.key) for r in rules])
    each = ledger.where(F.arrays_overlap("rules", current)).select(
        "blob",
        F.transform(
            F.filter("findings", lambda f: F.array_contains(live, f["kind"])),
            lambda f: F.struct(f["start"].alias("start"), F.array_position(live, f["kind"]).alias("order"), f["end"].alias("end"), f["kind"].alias("kind")),
        ).alias("found"),
    )
    by_blob = cut(each.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("findings")))
    # Both sides are plain scans: a blob that a third of the paths hold is split when the join runs.
    return paths.join(by_blob, "blob", "left")


def digest(findings, kinds: tuple[str, ...]):
    chosen = F.filter(findings, lambda f: f["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The findings for each row of ``docs`` (doc_id, text), and the ledger after the scan.

    Each row is a path at one version: pass all versions' rows, or those since the
    ``ledger`` was written, which then spares what it has. Without one, all is new.

    Nulls: a null text is empty, a null id stays. Repeated rows each get their
    findings. Other columns are not read. No rows give no rows.
    """
    ledger = new_ledger(docs.sparkSession) if ledger is None else ledger
    versions = with_blobs(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    added = shared_table(scan_unseen(versions, ledger, rules), "blob-ledger")
    after = ledger.unionByName(added)
    return findings_by_path(versions.select("doc_id", "blob"), after, rules), after


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan_documents(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(digest(F.col("findings"), BASE), 256).alias("base_sha256"),
        digest(F.col("findings"), tuple(r.kind for r in RULES)).alias("spans"),
    )


def scan_text(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """All findings of one text, by start and rule order."""
    text = text or ""
    low = text.lower()
    found = [(a, n, b, r.kind) for n, r in enumerate(rules) for a, b in r.find(text, low)]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLES: dict[str, str] = {}
