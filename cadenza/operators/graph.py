"""Dependency closures: connected components by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import cut


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for each end of an edge; root is the least node of the component.

    Each round a node takes the least root among its neighbours' roots, and then its root's root; rounds stop when
    nothing changes, after about the logarithm of the longest chain. Null ends and self-loops are ignored.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.unionAll(e.select("v", "u")).distinct())
    r = cut(e.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")))
    while True:
        near = e.join(r.select(F.col("node").alias("v"), F.col("root").alias("rv")).hint("merge"), "v").groupBy(F.col("u").alias("node")).agg(F.min("rv").alias("m"))
        x = r.join(near.hint("merge"), "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = r.select(F.col("node").alias("root"), F.col("root").alias("up")).hint("merge")
        x = cut(x.join(jump, "root", "left").select("node", "old", F.least("root", "up").alias("root")))
        r = x.select("node", "root")
        if x.where("old <> root").isEmpty():
            return r


def closure_edges(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Edges between the namespaced nodes of each row: ``keys`` maps a namespace to a column; null names no node."""
    nodes = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{n}:"), F.col(c).cast("string"))) for n, c in keys.items()]))
    x = df.select(nodes.alias("n")).where(F.size("n") > 1)
    return x.select(F.col("n")[0].alias("src"), F.explode(F.slice("n", 2, len(keys))).alias("dst")).distinct()
