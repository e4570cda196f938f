"""Splits that keep related records together (problem 4)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.components import random_mate_components
from cadenza.session import cut, with_running_total

#: Notations of a missing key, after normalisation.
MISSING_KEYS = ["", "unknown", "n_a", "na", "none", "null", "nan", "nil"]


def normal_key(c: Column) -> Column:
    """Case, blanks and separators don't distinguish keys; notations of a missing key become null."""
    k = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    return F.when(~k.isin(MISSING_KEYS), k)


def numeric_key(c: Column) -> Column:
    """The number in a key, without leading zeros, as text (so of any length); null if there is none."""
    n = F.regexp_extract(c, r"([0-9]+)\D*$", 1)
    return F.when(n != "", F.regexp_replace(n, r"^0+(?=\d)", ""))


def tied_sets(records: DataFrame, id_col: str, keys: Mapping[str, Column]) -> DataFrame:
    """(id, set_id, set_size): records tied directly or through others by any of ``keys``; set_id is the smallest id.

    ``keys`` maps a namespace to a column of normalised keys; null ties nothing. Only keys are vertices, so a key
    that a third of the rows share is one vertex, not a clique: a record contributes edges between its own keys.
    Records without any key are sets of one. A repeated id counts once, with the keys of all its rows. Rows with a
    null id are left out (they can't be named). Other columns of ``records``, whatever their names, are not read.
    """
    names = list(keys)
    r = records.select(F.col(id_col).cast("string").alias("id"), *[F.when(keys[n].isNotNull(), F.concat(F.lit(f"{n}:"), keys[n].cast("string"))).alias(f"k{i}") for i, n in enumerate(names)]).where("id is not null").distinct()
    keyed = r.select("id", F.explode(F.array_compact(F.array(*[f"k{i}" for i in range(len(names))]))).alias("key"))
    # An id's first key ties its keys to each other, whether they stand in one row or in several.
    anchor = keyed.groupBy("id").agg(F.min("key").alias("anchor"), F.max("key").alias("other"), F.collect_set("key").alias("all"))
    anchor = cut(anchor)
    edges = anchor.where("anchor <> other").select(F.col("anchor").alias("src"), F.explode("all").alias("dst"))
    roots = random_mate_components(edges)
    placed = anchor.select("id", F.col("anchor").alias("vertex")).join(roots, "vertex", "left").select("id", F.coalesce("root", "vertex").alias("root"))
    sets = placed.groupBy("root").agg(F.min("id").alias("set_id"), F.count(F.lit(1)).alias("set_size"))
    tied = placed.join(sets, "root").select("id", "set_id", "set_size")
    alone = r.select("id").distinct().join(anchor.select("id"), "id", "left_anti").select("id", F.col("id").alias("set_id"), F.lit(1).cast("bigint").alias("set_size"))
    return tied.unionAll(alone)


def assign_splits(sets: DataFrame, shares: Sequence[tuple[str, float]], seed: str = "split", giant: float = 0.01) -> DataFrame:
    """Adds ``new_split`` to tied_sets' rows: whole sets, in hash order, cut at the cumulative shares of the records.

    Sets larger than ``giant`` of all records come first (and so fall to the first split); the place of a set is
    the middle of its interval, so a share is missed by at most half a set. Running totals are taken over
    ranges of the hash, not in one task.
    """
    total = sets.count()
    s = sets.select("set_id", "set_size").distinct()
    h = F.sha2(F.concat_ws("|", F.lit(seed), "set_id"), 256)
    bucket = F.when(F.col("set_size") > giant * total, F.lit(-1)).otherwise(F.conv(F.substring(h, 1, 3), 16, 10).cast("int"))
    s = with_running_total(s, [], bucket, [h, F.col("set_id")], F.col("set_size"), "__before")
    at = (F.col("__before") + F.col("set_size") / 2) / F.lit(max(total, 1))
    c, up = None, 0.0
    for name, share in shares[:-1]:
        up += share
        c = (F if c is None else c).when(at < F.lit(round(up, 12)), name)
    s = s.select("set_id", c.otherwise(shares[-1][0]).alias("new_split"))
    return sets.join(s, "set_id")
