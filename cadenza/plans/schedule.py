"""Folds, training caps, comparison lattices and partitions of a cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.hashing import SEED, hash_fold, rank_key
from cadenza.operators.relational import power_set
from cadenza.session import cut, hash_bucket, with_running_total

#: The golden ratio's fraction, whose multiples are spread most evenly over the unit interval.
GOLDEN = 0.6180339887498949


def with_buckets(c: DataFrame, folds: int = 5, seed: str = "20260907") -> DataFrame:
    return c.withColumn("fold", hash_fold(F.col("group_id"), folds, seed))


def held_source_cells(c: DataFrame, least_groups: int = 2, folds: int = 5) -> DataFrame:
    """(held_source, label, bucket, test_rows, train_rows, train_sources, status) for each held-out source and bucket.

    Test: the source's rows of the bucket and the other class's rows of the bucket. Train: the rest of other buckets
    whose group is in no test row. All cells are counted at once: rows are summed per group first, and a group's own
    buckets decide whether it is purged, so no cell repeats the rows. ``c`` has fold.
    """
    g = c.groupBy("group_id", "fold", "label", "source_group").agg(F.count(F.lit(1)).alias("n"))
    cells = g.select("source_group", "label").distinct().collect()  # the schedule's held sources: a plan, not data
    one = [F.struct(F.lit(r["source_group"]).alias("held"), F.lit(r["label"]).alias("held_label"), F.lit(b).alias("bucket")) for r in cells for b in range(folds)]
    if not one:
        one = [F.struct(F.lit(None).cast("string").alias("held"), F.lit(None).cast("int").alias("held_label"), F.lit(0).alias("bucket"))]
    x = g.select("*", F.explode(F.array(*one)).alias("cell")).select("*", "cell.*")
    test = (F.col("fold") == F.col("bucket")) & ((F.col("source_group") == F.col("held")) | (F.col("label") != F.col("held_label")))
    train = (F.col("fold") != F.col("bucket")) & ~((F.col("source_group") == F.col("held")) & (F.col("label") == F.col("held_label")))
    x = x.groupBy("held", "held_label", "bucket", "group_id").agg(
        F.sum(F.when(test, F.col("n")).otherwise(0)).alias("test"), F.sum(F.when(test & (F.col("label") == 1), F.col("n")).otherwise(0)).alias("test1"),
        *[F.sum(F.when(train & (F.col("label") == y), F.col("n")).otherwise(0)).alias(f"train{y}") for y in (0, 1)],
    )
    keep = lambda c_: F.when(F.col("test") == 0, F.col(c_)).otherwise(0)
    y = x.groupBy("held", "held_label", "bucket").agg(
        F.sum("test").alias("test_rows"), F.sum("test1").alias("test_generated"), F.sum(keep("train0")).alias("train_human"), F.sum(keep("train1")).alias("train_generated"),
        F.count_if((F.col("test") == 0) & (F.col("train0") > 0)).alias("human_groups"), F.count_if((F.col("test") == 0) & (F.col("train1") > 0)).alias("generated_groups"),
    )
    status = F.when((F.col("test_generated") == 0) | (F.col("test_generated") == F.col("test_rows")), "test_single_class").when((F.col("train_human") == 0) | (F.col("train_generated") == 0), "train_single_class").when(F.least("human_groups", "generated_groups") < least_groups, "few_groups").otherwise("eligible")
    return y.select(F.col("held").alias("held_source"), F.col("held_label").alias("label"), "bucket", "test_rows", (F.col("train_human") + F.col("train_generated")).alias("train_rows"), "human_groups", "generated_groups", status.alias("status"))


def comparison_lattice(old: Sequence[str], new: Sequence[str]) -> list[tuple[str, str, str, str]]:
    """(old, new, arm, combination): each old combination alone and with each new one added."""
    return [(o, n, arm, o if arm == "baseline" else f"{o}+{n}") for o in power_set(old) for n in power_set(new) for arm in ("baseline", "added")]


def partition_closures(closures: DataFrame, shares: Sequence[tuple[str, float]] = (("train", 0.6), ("calibration", 0.2), ("test", 0.2)), seed: str = SEED) -> DataFrame:
    """(root, part): whole closures dealt to parts so that every source is in every part, as far as it has closures, and near its share of each.

    ``closures``: root, source, n (rows), one row per closure and source. A closure's stratum is the rarest of its sources (the one with the fewest
    closures, then by name), so rare sources are dealt by themselves. A stratum's first closures in seeded hash order go to one part each. The
    others are laid out by size class (powers of two, large ones first) and hash, and their places are spread over the shares by a
    low-discrepancy sequence (multiples of the golden ratio): each part's number of closures of each class stays within a few of its share, and
    so does its number of rows. Places are running totals over ranges of class and hash, so no task holds a stratum. A null source is one of its own.
    """
    c = closures.select("root", F.coalesce("source", F.lit("")).alias("source"), "n").groupBy("root", "source").agg(F.sum("n").alias("n"))
    rare = c.groupBy("source").agg(F.count(F.lit(1)).alias("m"))
    x = c.join(rare, "source").groupBy("root").agg(F.min(F.struct("m", "source")).alias("r"), F.sum("n").alias("n"))
    x = cut(x.select("root", F.col("r.source").alias("stratum"), "n", rank_key(F.col("root"), seed).alias("h")))
    first = F.conv(F.substring("h", 1, 2), 16, 10).cast("int")
    size = F.floor(F.log2(F.greatest("n", F.lit(1))) + 1e-9).cast("int")
    k = len(shares)
    x = with_running_total(x, ["stratum"], first, [F.col("h"), F.col("root")], F.lit(1), "__drawn")
    x = with_running_total(x.withColumn("__rest", (F.col("__drawn") >= k).cast("int")), ["stratum", "__rest"], (62 - size) * 256 + first, [F.col("h"), F.col("root")], F.lit(1), "__place")
    at = (F.col("__place") + 0.5) * GOLDEN
    at = at - F.floor(at)
    total, up = sum(w for _, w in shares), 0.0
    rest = anchor = None
    for i, (name, w) in enumerate(shares):
        up += w / total
        rest = (F if rest is None else rest).when(at < round(up, 12), name)
        anchor = (F if anchor is None else anchor).when(F.col("__drawn") == i, name)
    last = shares[-1][0]
    return x.select("root", F.when(F.col("__rest") == 0, anchor.otherwise(last)).otherwise(rest.otherwise(last)).alias("part"))


def shards(df: DataFrame, id_: str, size: int) -> DataFrame:
    """Rows with the shard of their place in hash order: equal shards of ``size`` by running totals over ranges of the hash."""
    h = F.xxhash64(id_)
    x = with_running_total(df, [], hash_bucket(h, 256), [h, F.col(id_)], F.lit(1), "__at")
    return x.withColumn("shard", F.floor(F.col("__at") / size)).drop("__at")


__all__ = ["comparison_lattice", "held_source_cells", "partition_closures", "rank_key", "shards", "with_buckets"]
