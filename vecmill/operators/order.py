"""Row numbers over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, first: Column, *ties: Column, name: str = "row_idx") -> DataFrame:
    """``df`` with ``name``: 0, 1, ... by ``first`` (a number, ascending), then ``ties``.

    Ranges of ``first`` are numbered apart, and shifted by the rows before them. The
    ranges' bounds are values that the driver holds (one for each shuffle partition),
    so that rows fall into the same range whenever ``df`` is evaluated.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    shares = [(n + 1) / parts for n in range(parts - 1)] or [0.5]
    cuts = sorted(set(df.agg(F.percentile_approx(first, shares, 10_000)).first()[0] or []))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < first)) if cuts else F.lit(0)
    dealt = df.withColumn("__part", part)
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row for each range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(first, *ties)) - 1
    out = dealt.withColumn("__nth", nth).join(F.broadcast(shift), "__part")
    return out.withColumn(name, F.col("__nth") + F.col("__shift")).drop("__nth", "__shift", "__part")
