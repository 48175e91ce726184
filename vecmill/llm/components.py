"""Connected components over edge tables that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.llm.common import shared_table


def connected_components(edges: DataFrame, n_edges: int | None = None) -> DataFrame:
    """(node, root) for each node of ``edges`` (long columns u, v): root is the smallest node reachable.

    Each round, every node hooks to its smallest neighbour, pointers are
    doubled twice, and the edges are contracted by them; the edges between
    contracted nodes keep what isn't joined yet. The rounds' pointers are
    composed at the end. No edges give no rows. ``n_edges``, if known, bounds the
    files of what is written.
    """
    most = None if n_edges is None else 2 * n_edges  # both directions; as many nodes
    pairs = edges.where("u <> v")
    current = shared_table(pairs.select("u", "v").union(pairs.select("v", "u")).distinct(), "edges", most)
    hooks: list[DataFrame] = []
    while not current.isEmpty():
        hook = shared_table(current.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "hooks", most)
        up = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
        twice = hook.join(up, "p").select("u", F.col("q").alias("p"))
        up = twice.select(F.col("u").alias("p"), F.col("p").alias("q"))
        hook = shared_table(twice.join(up, "p").select("u", F.col("q").alias("p")), "pointers", most)
        hooks.append(hook)
        a, b = hook.select("u", F.col("p").alias("a")), hook.select(F.col("u").alias("v"), F.col("p").alias("b"))
        moved = current.join(a, "u").join(b, "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
        current = shared_table(moved.distinct(), "edges", most)
    if not hooks:
        return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = hooks[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for hook in hooks[1:]:
        to = hook.select(F.col("u").alias("root"), "p")
        found = found.join(to, "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    return shared_table(found, "components", most)
