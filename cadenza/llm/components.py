"""Connected components by random-mate contraction, expressed as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import cut


def random_mate_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(vertex, root) for every vertex that has an edge to another vertex; vertices of one component share ``root``.

    Each round gives every vertex a coin, the last bit of a hash that is hashed on from round to round. A tail with at
    least one head among its neighbours collapses into the least of them; edges are rewritten by two joins, loops and
    repeats vanish. As only tails move and only onto heads, no chains arise inside a round. When no edge is left the
    rounds' parents, a forest as deep as there were rounds, are unwound by doubling: each join halves the depth.
    Expected rounds: O(log vertices); each is a written table, so a lost executor costs one round.
    Null ends and self-loops tie nothing and are ignored; repeated edges count once; an empty input gives no rows.
    A vertex of very high degree is pre-aggregated map-side (min per tail), never collected. Joins sort and merge
    throughout: a broadcast in each of many rounds would stay in the driver's memory; and all rounds
    have the same plan, so its code is compiled once.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    e = cut(e.select("u", F.xxhash64("u").alias("hu"), "v", F.xxhash64("v").alias("hv")))
    parents = None
    rounds = 0
    while not e.isEmpty():
        p = cut(e.where((F.col("hu").bitwiseAND(F.lit(1)) == 0) & (F.col("hv").bitwiseAND(F.lit(1)) == 1)).groupBy("u").agg(F.min(F.struct("v", "hv")).alias("p")).select("u", F.col("p.v").alias("p"), F.col("p.hv").alias("hp")))
        parents = p if parents is None else parents.unionAll(p)
        rounds += 1
        pu, pv = p.hint("merge"), p.select(F.col("u").alias("v"), F.col("p").alias("q"), F.col("hp").alias("hq")).hint("merge")
        e = e.join(pu, "u", "left").select(F.coalesce("p", "u").alias("u"), F.coalesce("hp", "hu").alias("hu"), "v", "hv").where("u <> v")
        e = e.join(pv, "v", "left").select("u", "hu", F.coalesce("q", "v").alias("v"), F.coalesce("hq", "hv").alias("hv")).where("u <> v").distinct()
        e = cut(e.select("u", F.xxhash64("hu", "u").alias("hu"), "v", F.xxhash64("hv", "v").alias("hv")))
    if parents is None:
        return e.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    labels = cut(parents.select(F.col("u").alias("vertex"), F.col("p").alias("root")))
    while rounds > 1:
        above = labels.select(F.col("vertex").alias("root"), F.col("root").alias("r")).hint("merge")
        labels = cut(labels.join(above, "root", "left").select("vertex", F.coalesce("r", "root").alias("root")))
        rounds = -(-rounds // 2)
    return labels.unionAll(labels.select(F.col("root").alias("vertex"), "root").distinct())
