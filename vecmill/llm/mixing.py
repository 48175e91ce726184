"""Mixing sources to target weights.

Method: iterative proportional fitting. Token weights of the cells (source,
language, topic) are raked to target marginals; documents are sampled by the
calibrated probabilities. These keep a fixed share of all tokens, and are bounded
at 1: cells that reach it are kept whole, and the rest is raked again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecmill.llm.common import cut, shared_table, table

MARGINS = ("source", "lang", "topic")
#: Default targets: a value's share of tokens to this power, normalised.
FLATTEN = 0.9
#: Share of all tokens that is kept. Dividing by the largest factor, as was done before, kept 0.57, 0.52 and 0.49 of sf0.001,
#: sf0.01 and sf0.1; this keeps no less of any of them.
KEPT_SHARE = 0.6
ROUNDS = 20
TOLERANCE = 1e-6
SEED = 17
#: Cells that the driver rakes (some 100 MB); a table takes longer, and has no bound.
MAX_CELLS = 200_000
_WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column, n_tokens: Column) -> Column:
    """A coarse topic by the shape of a text: table, list, numeric or prose."""
    per_100 = lambda pattern: F.regexp_count(text, F.lit(pattern)) * 100
    return (
        F.when(per_100(r"\|") > n_tokens * 10, "table")
        .when(per_100(r"\n") > n_tokens * 10, "list")
        .when(per_100(r"[0-9]") > n_tokens * 20, "numeric")
        .otherwise("prose")
    )


def described(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens and a uniform draw of each row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    tokens = F.regexp_count(text, F.lit(_WORD)).cast("long")
    topic = F.col("topic") if "topic" in docs.columns else topic_of(text, F.col("n_tokens"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("doc_id"), text), 11) / F.lit(float(1 << 53))
    rows = docs.withColumns({"n_tokens": tokens, "draw": draw})
    return rows.withColumn("topic", topic).withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in MARGINS})


def flattened(cells: DataFrame, margin: str, power: float = FLATTEN) -> DataFrame:
    """(value, target): each value's share of tokens to ``power``, normalised."""
    sums = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("n_tokens").alias("t"))
    raised = sums.where("t > 0").withColumn("p", F.pow(F.col("t").cast("double"), F.lit(power)))
    total = raised.agg(F.sum("p").alias("total"))  # one row
    return raised.crossJoin(F.broadcast(total)).select("value", (F.col("p") / F.col("total")).alias("target"))


def _rake_here(cells: list, goals: dict[str, dict[str, float]], rounds: int, tolerance: float) -> np.ndarray:
    """Factors of the cells (rows with the margins and n_tokens)."""
    tokens = np.array([c.n_tokens for c in cells], dtype=float)
    factor = np.ones(len(cells))
    steps = []
    for margin, goal in goals.items():
        values, code = np.unique([c[margin] for c in cells], return_inverse=True)
        steps.append((code, np.array([goal.get(v, 0.0) for v in values])))
    for _ in range(rounds):
        off = 0.0
        for code, target in steps:
            sums = np.bincount(code, tokens * factor, minlength=len(target))
            scale = np.divide(target, sums, out=np.zeros_like(target), where=sums > 0)
            off = max(off, float(np.abs(scale[code][factor > 0] - 1).max(initial=0.0)))
            factor = factor * scale[code]
        if off <= tolerance:
            break
    return factor


def _rake_there(cells: DataFrame, goals: dict[str, DataFrame], rounds: int, tolerance: float) -> DataFrame:
    """The same over a table of any size."""
    now = cells.withColumn("factor", F.lit(1.0))
    for margin, goal in goals.items():
        now = now.join(goal.select(F.col("value").alias(margin), F.col("target").alias(f"t_{margin}")), margin, "left")
    now = cut(now.fillna(0.0, [f"t_{m}" for m in goals]))
    for _ in range(rounds):
        now = now.withColumn("off", F.lit(0.0))
        for margin in goals:
            sums = F.sum(F.col("n_tokens") * F.col("factor")).over(Window.partitionBy(margin))
            now = now.withColumn("scale", F.when(sums > 0, F.col(f"t_{margin}") / sums).otherwise(0.0))
            worse = F.when(F.col("factor") > 0, F.abs(F.col("scale") - 1)).otherwise(0.0)
            now = now.withColumns({"off": F.greatest("off", worse), "factor": F.col("factor") * F.col("scale")})
        now = cut(now.drop("scale"))
        worst = now.agg(F.max("off")).first()[0]
        now = now.drop("off")
        if worst is None or worst <= tolerance:
            break
    return now.drop(*[f"t_{m}" for m in goals])


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE, most: int = MAX_CELLS
) -> DataFrame:
    """``cells`` (with n_tokens) with ``factor``: n_tokens * factor has the target marginals.

    Each step scales the cells of a value by its target over its present sum; a
    value without target gets factor 0. It ends after ``rounds`` rounds, or when
    no scale is off 1 by more than ``tolerance``. Where marginals contradict each
    other, the last margin holds. Cells without tokens have no row.

    Up to ``most`` cells are raked on the driver; more than that as a table.
    """
    filled = cells.where("n_tokens > 0")
    if filled.count() > most:
        return _rake_there(filled, targets, rounds, tolerance)
    held = filled.collect()
    goals = {m: {r["value"]: r["target"] for r in t.collect()} for m, t in targets.items()}
    factors = _rake_here(held, goals, rounds, tolerance)
    rows = [(*c, float(f)) for c, f in zip(held, factors)]
    return cells.sparkSession.createDataFrame(rows, T.StructType([*filled.schema, T.StructField("factor", T.DoubleType())]))


def _fill(tokens: np.ndarray, factor: np.ndarray, code: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The scale of each value with which its tokens * min(1, factor * scale) sum up to its target.

    Factors are positive. Where the target is all of a value's tokens, the least scale that saturates its cells.
    """
    order = np.lexsort((-factor, code))  # the largest factor saturates first
    n, f, c = tokens[order], factor[order], code[order]
    after = np.cumsum((n * f)[::-1])[::-1] - n * f
    ends = np.searchsorted(c, np.arange(len(target)), side="right") - 1
    starts = np.searchsorted(c, np.arange(len(target)), side="left")
    before = np.cumsum(n) - (np.cumsum(n)[starts] - n[starts])[c]
    # the sum once the scale saturates this cell
    sums = before + (after - after[ends][c]) / f
    full = sums <= target[c] * (1 + 1e-12)
    taken = np.bincount(c, n * full, minlength=len(target))
    left = np.bincount(c, n * f * ~full, minlength=len(target))
    least = np.zeros(len(target))
    np.maximum.at(least, c[full], 1 / f[full])
    return np.maximum(np.divide(target - taken, left, out=np.zeros_like(target), where=left > 0), least)


def _bound_here(cells: list, goals: dict[str, dict[str, float]], share: float, rounds: int, tolerance: float) -> np.ndarray:
    """Probabilities of the cells (rows with the margins, n_tokens and factor)."""
    tokens, factor = (np.array([c[n] for c in cells], dtype=float) for n in ("n_tokens", "factor"))
    odds, held = np.zeros(len(cells)), factor > 0
    volume = min(share * tokens.sum(), tokens[held].sum())
    if volume <= 0:
        return odds
    n, f = tokens[held], factor[held] * volume
    steps = []
    for margin, goal in goals.items():
        values, code = np.unique([c[margin] for c, h in zip(cells, held) if h], return_inverse=True)
        sums, wanted = np.bincount(code, n), np.array([goal[v] for v in values])
        level = _fill(sums, wanted / sums, np.zeros(len(sums), dtype=int), np.array([volume]))[0]
        steps.append((code, np.minimum(sums, wanted * level)))
    for _ in range(rounds):
        off = 0.0
        for code, target in steps:
            sums = np.bincount(code, n * np.minimum(1.0, f), minlength=len(target))
            off = max(off, float(np.abs(sums / target - 1).max()))
            f = f * _fill(n, f, code, target)[code]
        if off <= tolerance:
            break
    odds[held] = np.where(f >= 1 - 1e-9, 1.0, f)
    return odds


def _level_there(values: DataFrame, volume: float) -> float:
    """The level with which the values' least(tokens, wanted * level) sum up to ``volume``: Newton's steps from below."""
    level = volume / values.agg(F.sum("wanted")).first()[0]
    while True:
        full = F.col("wanted") * level >= F.col("tokens")
        taken, left = values.agg(F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("wanted")))).first()
        risen = (volume - (taken or 0)) / left if left else level
        if risen <= level * (1 + 1e-12):
            return level
        level = risen


def _bound_there(raked: DataFrame, goals: dict[str, DataFrame], share: float, rounds: int, tolerance: float) -> DataFrame:
    """The same over a table of any size."""
    every = raked.agg(F.sum("n_tokens"), F.sum(F.when(F.col("factor") > 0, F.col("n_tokens")))).first()
    volume = min(share * (every[0] or 0), every[1] or 0)
    if volume <= 0:
        return raked.withColumn("probability", F.lit(0.0))
    now = raked.where("factor > 0").withColumn("f", F.col("factor") * F.lit(float(volume)))
    for margin, goal in goals.items():
        sums = now.groupBy(margin).agg(F.sum("n_tokens").alias("tokens"))
        wanted = goal.select(F.col("value").alias(margin), F.col("target").alias("wanted"))
        values = cut(sums.join(wanted, margin))
        reached = F.least(F.col("tokens").cast("double"), F.col("wanted") * F.lit(_level_there(values, volume)))
        now = now.join(values.select(margin, reached.alias(f"t_{margin}")), margin)
    now = cut(now)
    for _ in range(rounds):
        now = now.withColumn("off", F.lit(0.0))
        for margin in goals:
            whole = Window.partitionBy(margin)
            first = whole.orderBy(F.col("f").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
            n, f, target = F.col("n_tokens"), F.col("f"), F.col(f"t_{margin}")
            sums = F.sum(n).over(first) + (F.sum(n * f).over(whole) - F.sum(n * f).over(first)) / f
            now = now.withColumn("off", F.greatest("off", F.abs(F.sum(n * F.least(F.lit(1.0), f)).over(whole) / target - 1)))
            now = now.withColumn("full", sums <= target * (1 + 1e-12))
            taken = F.coalesce(F.sum(F.when(F.col("full"), n)).over(whole), F.lit(0))
            left = F.sum(F.when(~F.col("full"), n * f)).over(whole)
            least = F.coalesce(F.max(F.when(F.col("full"), 1 / f)).over(whole), F.lit(0.0))
            now = now.withColumn("scale", F.greatest(F.when(left > 0, (target - taken) / left).otherwise(0.0), least))
            now = now.withColumn("f", F.col("f") * F.col("scale")).drop("scale", "full")
        now = cut(now)
        worst = now.agg(F.max("off")).first()[0]
        now = now.drop("off")
        if worst <= tolerance:
            break
    odds = F.when(F.col("f") >= 1 - 1e-9, 1.0).otherwise(F.col("f"))
    out = now.withColumn("probability", odds).select(*raked.columns, "probability")
    return out.unionByName(raked.where("factor <= 0").withColumn("probability", F.lit(0.0)))


def bounded(
    raked: DataFrame, targets: dict[str, DataFrame], share: float = KEPT_SHARE, rounds: int = ROUNDS, tolerance: float = TOLERANCE, most: int = MAX_CELLS
) -> DataFrame:
    """``raked`` cells with ``probability``, at most 1: n_tokens * probability sums up to ``share`` of all tokens.

    The sums of each margin's values are in proportion to their targets. A value
    with fewer tokens than that gives all, and the others share the rest. Each
    step scales the cells of a value so that they meet its sum, those that reach
    1 kept whole. Where marginals contradict each other under the bound, the last
    margin holds. Cells of factor 0 have probability 0; where all others together
    are under the share, they are kept whole.
    """
    if not 0 < share <= 1:
        raise ValueError("a share lies in (0, 1]")
    if raked.count() > most:
        return _bound_there(raked, targets, share, rounds, tolerance)
    held = raked.collect()
    goals = {m: {r["value"]: r["target"] for r in t.collect()} for m, t in targets.items()}
    rows = [(*c, float(p)) for c, p in zip(held, _bound_here(held, goals, share, rounds, tolerance))]
    return raked.sparkSession.createDataFrame(rows, T.StructType([*raked.schema, T.StructField("probability", T.DoubleType())]))


def sample_mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, power: float = FLATTEN, share: float = KEPT_SHARE) -> DataFrame:
    """``docs`` (doc_id, text, source, lang) with n_tokens, topic, weight, probability and kept.

    ``targets`` has (value, target) for margins; the default flattens each margin.
    A document's weight is its cell's factor; its probability is its cell's, raked
    with a bound of 1, so that the kept tokens are ``share`` of all in expectation
    and have the target marginals, as far as the tokens go (see ``bounded``).
    The draw is a hash of id and text: repeated rows share it.

    A null source, language or topic is a value of its own (the empty string). A
    document without tokens is in no margin and is dropped. Other columns pass
    through; a column ``topic`` is used where there is one. No rows give no rows.
    """
    rows = described(docs)
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n_tokens")))
    goals = targets or {m: flattened(cells, m, power) for m in MARGINS}
    odds = bounded(rake(cells, goals), goals, share).select(*MARGINS, F.col("factor").alias("weight"), "probability")
    # read from a table, so that Spark broadcasts it only if it is small
    placed = rows.drop("weight", "probability", "kept").join(shared_table(odds, "mixing-cells"), list(MARGINS), "left")
    fill = {c: F.when(F.col("n_tokens") > 0, F.coalesce(c, F.lit(0.0))).otherwise(0.0) for c in ("weight", "probability")}
    return placed.withColumns(fill).withColumn("kept", F.col("draw") < F.col("probability"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = sample_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", *MARGINS, "n_tokens", "weight", "probability", "kept")


QUERIES = {"op9_mixing": op9_mixing}
ORACLES: dict[str, str] = {}
