"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import cut, fewer, shuffled


def _least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with the least v of each u as m. A sum by key and a join, so a hot u is split."""
    return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _least(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return near.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    near = _least(down)
    return near.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) with v the least node that u reaches, for every node u that has a smaller one."""
    spark, last = edges.sparkSession, None
    keep = lambda df: cut(fewer(df, shuffled(spark), 32))  # noqa: E731  two longs a row
    edges = keep(edges.select("u", "v").filter("u <> v").distinct())
    while True:
        edges = keep(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            return edges
        last = now
