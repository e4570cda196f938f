"""Resampling with materialised multiplicities: draws are a table, statistics are aggregations."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Upper bounds, in 2**32nds, of a uniform number for which a Poisson(1) count is 0, 1, 2, ...
POISSON = [int(2**32 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(11)]


def _drawn(names: Sequence[str], replicates: int, seed: int) -> np.ndarray:
    """The draws of multiplicities: a row per name, a column per replicate."""
    eights = [str(i).encode() for i in range(-(-replicates // 8))]
    h = b"".join([hashlib.sha256(name + i).digest() for name in [f"{seed}|{n}|".encode() for n in names] for i in eights])
    u = np.frombuffer(h, ">u4").reshape(len(names), 8 * len(eights))[:, :replicates].astype(np.uint32)
    k = np.zeros(u.shape, np.int8)
    for t in POISSON:
        k += u >= np.uint32(t)
    return k


def multiplicities(groups: DataFrame, key: str, replicates: int, seed: int = 20260907) -> DataFrame:
    """(key, draws array<int>): how often each group is drawn in each replicate, as Poisson(1) counts given by group, replicate and seed.

    Eight uniform numbers of 32 bits come from each SHA-256 of seed, group and number of the eight. One draw is shared by all
    models, folds and sources. Poisson counts make each group's draws independent of the others, so the table is made where the groups
    are, at any number of them, and is the same after a retry. A null group is not drawn.
    """
    kind = dict(groups.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            draws = _drawn(b.column("__name").to_pylist(), replicates, seed)
            ends = np.arange(len(draws) + 1, dtype=np.int32) * replicates
            yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(pa.array(ends), pa.array(draws.astype(np.int32).ravel()))], names=[key, "draws"])

    return groups.where(F.col(key).isNotNull()).select(key).distinct().select(key, F.col(key).cast("string").alias("__name")).mapInArrow(run, f"{key} {kind}, draws array<int>")


def draws_sql(replicates: int, seed: int = 20260907) -> str:
    """The same for DuckDB, from a table g (key varchar): (key, rep, k)."""
    u = "('0x' || substr(h, j * 8 + 1, 8))::bigint"
    return f"""d0 as (select key, i, sha256('{seed}|' || key || '|' || i::varchar) as h from (select distinct key from g where key is not null), (select unnest(range({(replicates - 1) // 8 + 1})) as i)), d1 as (select key, i * 8 + j as rep, {u} as u from d0, (select unnest(range(8)) as j)),
  draws as (select key, rep::int as rep, ({' + '.join(f'(u >= {t})::int' for t in POISSON)}) as k from d1 where rep < {replicates})"""


def replicate_sums(df: DataFrame, draws: DataFrame, key: str, by: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """(<by>, rep, <sums>): weighted sums per replicate. Rows are summed per group first; only groups meet their draws.

    The outer explode keeps the planner from deriving a filter on the draws that it would then evaluate on every row below the grouping.
    """
    g = df.groupBy(*by, key).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    x = g.join(draws, key).select(*by, *sums, F.posexplode_outer("draws").alias("rep", "k")).where("k > 0")
    return x.groupBy(*by, "rep").agg(*[F.sum(F.col(n) * F.col("k")).alias(n) for n in sums])


def drawn_sums(df: DataFrame, key: str, by: Sequence[str], sums: dict[str, str], replicates: int, seed: int = 20260907) -> DataFrame:
    """(<by>, rep, <sums>): what replicate_sums gives with the draws of multiplicities, for as many keys as rows.

    A key's draws follow from the key, so they are made and added up where its rows are; a table of draws, a thousand times as long as the keys
    and of a size that the planner can't see (it would broadcast it), is never made. A task holds the draws of 1,000 rows and the sums of some
    values of ``by``. Sums are of whole numbers, exact up to 2**53; null values add nothing, rows with a null key aren't drawn.
    """
    x = df.where(F.col(key).isNotNull()).select(*by, F.col(key).cast("string").alias("__name"), *[F.col(c).alias(n) for n, c in sums.items()])
    kinds = dict(x.dtypes)
    if other := [n for n in sums if kinds[n] not in ("tinyint", "smallint", "int", "bigint")]:
        raise ValueError(f"not whole numbers: {', '.join(other)}")
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "rep int", *[f"`{n}` bigint" for n in sums]])

    def table(total: dict[tuple, np.ndarray], types: list[pa.DataType]) -> pa.RecordBatch:
        reps = [np.flatnonzero(t[0]) for t in total.values()]  # those that drew a row
        which = pa.array(np.repeat(np.arange(len(reps)), [len(r) for r in reps]))
        own = [pa.array(list(c), kind).take(which) for c, kind in zip(zip(*total), types)]
        values = [np.concatenate([t[i, r] for t, r in zip(total.values(), reps)]) for i in range(1, 1 + 2 * len(sums))]
        found = [pa.array(v.astype(np.int64), mask=seen == 0) for v, seen in zip(values[::2], values[1::2])]
        return pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(reps).astype(np.int32)), *found], names=[*by, "rep", *sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}  # per values of by: times drawn; per sum the sum and the times its value was not null
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            for b in (batch.slice(i, 1_000) for i in range(0, batch.num_rows, 1_000)):
                rows: dict[tuple, list[int]] = {}
                for i, values in enumerate(zip(*[b.column(c).to_pylist() for c in by]) if by else [()] * b.num_rows):
                    rows.setdefault(values, []).append(i)
                parts = [f for n in sums for f in (b.column(n).fill_null(0), b.column(n).is_valid())]
                w = np.stack([np.ones(b.num_rows), *[f.to_numpy(zero_copy_only=False).astype(np.float64) for f in parts]])
                draws = _drawn(b.column("__name").to_pylist(), replicates, seed)
                for values, i in rows.items():
                    t = w[:, i] @ draws[i].astype(np.float64)
                    total[values] = total[values] + t if values in total else t
                if len(total) > 100:
                    yield table(total, types)
                    total = {}
        if total:
            yield table(total, types)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number: small rows with much work each, that would be put into few tasks
    return x.repartition(parts).mapInArrow(run, schema).groupBy(*by, "rep").agg(*[F.sum(n).alias(n) for n in sums])


def interval(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Percentile interval, standard error (ddof 1), share above 0 and number of defined replicates of ``value`` over rep; six decimals."""
    v = F.col(value)
    r = lambda c: F.round(c, 6)
    return df.groupBy(*by).agg(r(F.percentile(v, F.lit(0.025))).alias("low"), r(F.percentile(v, F.lit(0.975))).alias("high"), r(F.stddev_samp(v)).alias("se"), r(F.avg((v > 0).cast("double"))).alias("above_zero"), F.count(v).alias("valid"), F.count_if(v.isNull()).alias("undefined"))


INTERVAL_SQL = "round(quantile_cont({0}, 0.025), 6) as low, round(quantile_cont({0}, 0.975), 6) as high, round(stddev_samp({0}), 6) as se, round(avg(({0} > 0)::int) filter ({0} is not null), 6) as above_zero, count({0}) as valid, count(*) filter ({0} is null) as undefined"


def cluster_statistics(df: DataFrame, by: str, cluster: str, value: str, replicates: int, seed: int, bins: int = 4096) -> DataFrame:
    """(by, mean, mean_low, mean_high, median, median_low, median_high) resampling whole clusters by multiplicities.

    A cluster counts with the mean of its values. A replicate's mean is exact; its median is that of the clusters' means in ``bins`` equal
    steps of their range per ``by`` (its error is at most one step), so a replicate is a bounded histogram and not a sorted list of clusters.
    Clusters without values don't count; a ``by`` without any has no row.
    """
    m = df.groupBy(by, cluster).agg(F.avg(value).alias("m")).where("m is not null")
    span = m.groupBy(by).agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    x = m.join(span, by).withColumn("bin", F.floor(F.coalesce(F.try_divide(F.col("m") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * (bins - 1) + 0.5).cast("int"))
    x = x.join(multiplicities(m, cluster, replicates, seed), cluster)
    one = x.select(by, "lo", "hi", "bin", "m", F.posexplode_outer(F.array_prepend("draws", 1)).alias("rep", "k")).where("k > 0")  # replicate 0 is the sample itself
    h = one.groupBy(by, "rep", "bin").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("m")).alias("s"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    w = W.partitionBy(by, "rep")
    h = h.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("bin")))
    r = h.groupBy(by, "rep").agg((F.sum("s") / F.sum("n")).alias("mean"), at(F.floor((F.col("all") + 1) / 2)).alias("a"), at(F.floor(F.col("all") / 2) + 1).alias("b"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    r = r.select(by, "rep", "mean", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("a") + F.col("b")) / 2 / (bins - 1)).alias("median"))
    again = lambda c: F.when(F.col("rep") > 0, F.col(c))
    return r.groupBy(by).agg(*[f for c in ("mean", "median") for f in (F.max(F.when(F.col("rep") == 0, F.col(c))).alias(c), F.percentile(again(c), F.lit(0.025)).alias(f"{c}_low"), F.percentile(again(c), F.lit(0.975)).alias(f"{c}_high"))])
