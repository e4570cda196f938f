"""Order-dependent operators: runs, windows, merges, greedy selections."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.session import with_running_total, with_sums_below


def true_runs(df: DataFrame, key: Sequence[str], index: str, flag: Column) -> DataFrame:
    """(<key>, first, last, length) of each run of consecutive indexes at which ``flag`` is true."""
    x = df.where(flag).withColumn("__g", F.col(index) - F.row_number().over(W.partitionBy(*key).orderBy(index)))
    return x.groupBy(*key, "__g").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("length")).drop("__g")


def window_starts(first: Column, last: Column, size: int, hop: int) -> Column:
    """Starts of windows of ``size`` within [first, last], every ``hop``, and once the window that ends at last."""
    end = last - (size - 1)
    return F.when(end >= first, F.array_distinct(F.concat(F.sequence(first, F.greatest(first, end), F.lit(hop).cast("bigint")), F.array(end)))).otherwise(F.array().cast("array<bigint>"))


def merge_intervals(df: DataFrame, key: Sequence[str], start: str, end: str) -> DataFrame:
    """(<key>, start, end, parts): intervals that overlap by more than a point, merged."""
    w = W.partitionBy(*key).orderBy(start, end)
    x = df.withColumn("__m", F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1)))
    x = x.withColumn("__g", F.sum(F.when(F.col(start) < F.col("__m"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(*key, "__g").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("parts")).drop("__g")


def fill_gaps(df: DataFrame, key: Sequence[str], index: str, active: Column, valid: Column, gap: int, least: int) -> DataFrame:
    """(<key>, first, last): runs of active frames with gaps of up to ``gap`` inactive but valid frames filled, of ``least`` frames or more."""
    w = W.partitionBy(*key).orderBy(index)
    x = df.select(*key, index, active.alias("__a"), valid.alias("__v")).withColumn("__bad", F.sum((~F.col("__v")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    x = x.where("__a and __v").withColumn("__new", ((F.col(index) - F.lag(index).over(w) - 1 > gap) | (F.col("__bad") != F.lag("__bad").over(w))).cast("int"))
    x = x.withColumn("__g", F.sum(F.coalesce("__new", F.lit(1))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = x.groupBy(*key, "__g").agg(F.min(index).alias("first"), F.max(index).alias("last")).drop("__g")
    return g.where(F.col("last") - F.col("first") + 1 >= least)


def lagged_similarity(blocks: DataFrame, key: Sequence[str], index: str, vector: str, ok: Column, lags: Sequence[int], span: int = 4) -> DataFrame:
    """(<key>, lag, index, similarity, turn): patterns of ``span`` blocks against the patterns a lag later, in their best turn of the pitch classes.

    ``vector``: array<double> of 12 with length 1. Each block meets the blocks its lags later by an equi join (so a block costs
    as many rows as there are lags, whatever the recording's length); the products of all 12 turns are averaged over ``span`` blocks in a row, all
    of which have to be there and ``ok`` on both sides; of equal turns the first counts. ``index`` is the pattern's first block.
    """
    keys = list(key)
    x = blocks.where(ok).select(*keys, index, vector)
    later = x.select(*keys, F.col(index).alias("__j"), F.col(vector).alias("__v"))
    a = x.select("*", F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag")).withColumn("__j", F.col(index) + F.col("lag"))
    turns = [sum((F.get(vector, F.lit((c - t) % 12)) * F.get("__v", F.lit(c)) for c in range(12)), F.lit(0.0)).alias(f"t{t}") for t in range(12)]
    p = a.join(later, [*keys, "__j"]).select(*keys, "lag", index, *turns)
    w = W.partitionBy(*keys, "lag").orderBy(index).rangeBetween(0, span - 1)
    m = p.select(*keys, "lag", index, F.count(F.lit(1)).over(w).alias("__n"), *[F.round(F.avg(f"t{t}").over(w), 9).alias(f"t{t}") for t in range(12)]).where(F.col("__n") == span)
    best = F.greatest(*[f"t{t}" for t in range(12)])
    return m.select(*keys, "lag", index, best.alias("similarity"), (F.array_position(F.array(*[f"t{t}" for t in range(12)]), best) - 1).cast("int").alias("turn"))


def anchor_clusters(times: Column, width: float) -> Column:
    """Cluster anchors of an ascending array: a time beyond ``width`` of the current anchor starts a new one (not a session: gaps don't count)."""
    return F.aggregate(times, F.array().cast("array<double>"), lambda a, t: F.when(F.coalesce(t - F.get(a, F.size(a) - 1) > width, F.lit(True)), F.array_append(a, t)).otherwise(a))


def clean_boundaries(values: Column, duration: float, least: float = 1.0) -> Column:
    """Boundaries clipped to [0, duration], distinct and ascending, spaced by ``least`` greedily, with 0 and the duration as ends."""
    v = F.array_sort(F.array_distinct(F.transform(values, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(float(duration))))))
    inner = F.filter(v, lambda x: (x >= least) & (x <= duration - least))
    kept = F.aggregate(inner, F.array(F.lit(0.0)), lambda a, t: F.when(t - F.get(a, F.size(a) - 1) >= least, F.array_append(a, t)).otherwise(a))
    return F.array_append(kept, F.lit(float(duration)))


def coupled_caps(df: DataFrame, by: Sequence[str], caps: Sequence[int]) -> DataFrame:
    """(<by>, group_id, cap): groups in one hash order, taken while all their sources are below the cap; caps are nested.

    ``df``: by, group_id, source_group, order (a hash). A scan that keeps a counter per source, per value of ``by``; its input is one row
    per group and source, not per record.
    """
    keys = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = [(o, g, sorted(x["source_group"].unique())) for (o, g), x in pdf.groupby(["order", "group_id"], sort=True)]
        out, taken, used = [], set(), {}
        for cap in sorted(caps):
            for _, g, sources in groups:
                if g not in taken and all(used.get(s, 0) < cap for s in sources):
                    taken.add(g)
                    for s in sources:
                        used[s] = used.get(s, 0) + 1
                    out.append((*[pdf[k].iloc[0] for k in keys], g, cap))
        return pd.DataFrame(out, columns=[*keys, "group_id", "cap"])

    kinds = dict(df.dtypes)
    return df.select(*keys, "group_id", "source_group", "order").distinct().groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", group_id string, cap int")


def proportional_targets(df: DataFrame, key: str, available: str, count: int, order: str) -> DataFrame:
    """(key, target): ``count`` shared out evenly, capped by what is available, the rest one by one in hash order. One row per key.

    Sharing out in rounds fills all keys to one level, those with less to what they have, and gives the rest of the last round to the first keys in
    order that have more. The level comes from sums over the different amounts available; places in the order from ranges of the hash
    ``order`` (hex digits). Null or negative amounts are 0.
    """
    x = df.select(key, F.greatest(F.coalesce(available, F.lit(0)), F.lit(0)).cast("bigint").alias("__have"), F.col(order).alias("__order"))
    h = x.groupBy("__have").agg(F.count(F.lit(1)).alias("n"))
    total = h.agg(F.sum("n")).first()[0] or 0
    h = with_sums_below(h, [], "__have", {"keys": F.col("n"), "sum": F.col("n") * F.col("__have")})
    # At the level of an amount the keys below it give all they have; the highest one that ``count`` reaches, and how many keys have more.
    best = h.where(F.col("sum") + F.col("__have") * (F.lit(total) - F.col("keys")) <= count).agg(F.max(F.struct("__have", "sum", "keys", "n")).alias("b")).first()["b"]
    level, got, more = (best["__have"], best["sum"] + best["__have"] * (total - best["keys"]), total - best["keys"] - best["n"]) if best else (0, 0, total)
    step = (count - got) // more if more else 0
    level, left = level + step, count - got - step * more if more else 0
    first = F.conv(F.substring("__order", 1, 3), 16, 10).cast("int")
    y = with_running_total(x, [], first, [F.col("__order"), F.col(key)], (F.col("__have") > level).cast("int"), "__place")
    extra = ((F.col("__have") > level) & (F.col("__place") < left)).cast("bigint")
    return y.select(key, (F.least("__have", F.lit(level)) + extra).alias("target"))
