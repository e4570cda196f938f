"""Joins, selections and set algebra of measurement tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, failing at run time if a key occurs twice (for joins that must be one to one or many to one)."""
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return df.withColumn("__n", n).where(F.coalesce(F.assert_true(F.col("__n") == 1, F.lit("repeated key")).cast("string"), F.lit("")) == "").drop("__n")


def coalescing_join(a: DataFrame, b: DataFrame, key: str, values: Sequence[str], rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """Full outer merge: a's value, else b's; ``conflicts`` counts columns in which both are known and not close."""
    r = b.select(key, *[F.col(v).alias(f"__{v}") for v in values])
    x = a.join(r, key, "full")
    clash = sum(F.coalesce((F.abs(F.col(v) - F.col(f"__{v}")) > atol + rtol * F.abs(F.col(f"__{v}"))).cast("int"), F.lit(0)) for v in values)
    return x.select(key, *[F.coalesce(F.col(v), F.col(f"__{v}")).alias(v) for v in values], clash.alias("conflicts"))


def matched_deltas(df: DataFrame, keys: Sequence[str], arm: str, baseline: str, added: str, values: Sequence[str]) -> DataFrame:
    """value of the added arm - value of the baseline on the same key; one pass by conditional aggregation, no self-join."""
    pick = lambda a, v: F.max(F.when(F.col(arm) == a, F.col(v)))
    x = df.groupBy(*keys).agg(*[pick(a, v).alias(f"{s}_{v}") for v in values for s, a in (("b", baseline), ("a", added))], F.count_distinct(F.when(F.col(arm).isin(baseline, added), F.col(arm))).alias("__arms"))
    return x.where("__arms = 2").select(*keys, *[(F.col(f"a_{v}") - F.col(f"b_{v}")).alias(f"delta_{v}") for v in values])


def interval_join(points: DataFrame, intervals: DataFrame, key: Sequence[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Points within [start, end) of intervals of the same key: an equi join on buckets of ``width`` instead of a nested loop.

    An interval is in every bucket that it meets, a point in one, so no pair comes twice. Choose ``width`` near the
    usual length of an interval.
    """
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    i = intervals.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(i, [*key, "__b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")


def asof_interpolate(grid: DataFrame, samples: DataFrame, key: str, at: str, value: str, ok: str, atol: float = 1e-9) -> DataFrame:
    """For each grid time the sample there, or the linear interpolation between two adjacent good samples; else null.

    Grid and samples are merged in one sort per key: the last sample at or before and the first after come from windows, no range join.
    """
    g = grid.select(key, F.col(at), F.lit(1).alias("__g"), F.lit(None).cast("double").alias("__v"), F.lit(None).cast("boolean").alias("__ok"))
    s = samples.select(key, F.col(at), F.lit(0).alias("__g"), F.col(value).cast("double").alias("__v"), F.col(ok).alias("__ok"))
    x = g.unionByName(s)
    one = F.when(F.col("__g") == 0, F.struct(F.col(at).alias("t"), F.col("__v").alias("v"), F.col("__ok").alias("ok")))
    up, down = W.partitionBy(key).orderBy(at, "__g").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(key).orderBy(at, "__g").rowsBetween(1, W.unboundedFollowing)
    x = x.withColumn("__a", F.last(one, True).over(up)).withColumn("__z", F.first(one, True).over(down)).where("__g = 1")
    a, z, t = F.col("__a"), F.col("__z"), F.col(at)
    exact = (F.abs(a["t"] - t) <= atol) & a["ok"]
    between = a["ok"] & z["ok"]
    v = F.when(exact, a["v"]).when((F.abs(z["t"] - t) <= atol) & z["ok"], z["v"]).when((F.abs(a["t"] - t) > atol) & between, a["v"] + (z["v"] - a["v"]) * (t - a["t"]) / (z["t"] - a["t"]))
    return x.select(key, at, v.alias(value))


def nearest(points: DataFrame, marks: DataFrame, key: str, at: str, index: str) -> DataFrame:
    """Each point with the index of the nearest mark of its key, the first on ties: from the marks before and after in one sort."""
    p = points.select(key, F.col(at), F.lit(1).alias("__p"), F.lit(None).cast("bigint").alias("__i"))
    m = marks.select(key, F.col(at), F.lit(0).alias("__p"), F.col(index).cast("bigint").alias("__i"))
    one = F.when(F.col("__p") == 0, F.struct(F.col(at).alias("t"), F.col("__i").alias("i")))
    first = F.when(F.col("__p") == 0, F.struct(F.col(at).alias("t"), (-F.col("__i")).alias("i")))
    w = W.partitionBy(key)
    x = p.unionByName(m).withColumn("__a", F.max(first).over(w.orderBy(at, "__p").rowsBetween(W.unboundedPreceding, 0))).withColumn("__z", F.min(one).over(w.orderBy(at, "__p").rowsBetween(1, W.unboundedFollowing))).where("__p = 1")
    before, after = F.col(at) - F.col("__a.t"), F.col("__z.t") - F.col(at)
    idx = F.when(after.isNull() | (before <= after), -F.col("__a.i")).otherwise(F.col("__z.i"))
    return x.select(key, at, idx.alias(index))


def match_events(reference: DataFrame, predicted: DataFrame, key: str, at: str, tolerance: float) -> DataFrame:
    """Greedy one-to-one matches of event times within ``tolerance``, per key, nearest pairs first: (key, t_reference, t_predicted).

    Each key's events are one group (a recording). Equal distances go to the earlier reference, then prediction.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, side = pdf["t"].to_numpy(float), pdf["side"].to_numpy()
        r, p = np.sort(t[side == 0]), np.sort(t[side == 1])
        lo, hi = np.searchsorted(p, r - tolerance - 1e-12), np.searchsorted(p, r + tolerance + 1e-12, "right")
        pairs = sorted((abs(r[i] - p[j]), i, j) for i in range(len(r)) for j in range(lo[i], hi[i]))
        ur, up, out = set(), set(), []
        for _, i, j in pairs:
            if i not in ur and j not in up:
                ur.add(i)
                up.add(j)
                out.append((pdf["key"].iloc[0], r[i], p[j]))
        return pd.DataFrame(out, columns=["key", "t_reference", "t_predicted"])

    kind = dict(reference.dtypes)[key]
    both = reference.select(F.col(key).alias("key"), F.col(at).alias("t"), F.lit(0).alias("side")).unionAll(predicted.select(F.col(key).alias("key"), F.col(at).alias("t"), F.lit(1).alias("side")))
    return both.where("t is not null").groupBy("key").applyInPandas(run, f"key {kind}, t_reference double, t_predicted double").withColumnRenamed("key", key)


def window_hashes(text: str, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` characters: sums of code times B**k (mod 2**64, B odd), shifted to a common exponent."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if len(c) < width:
        return np.empty(0, np.int64)
    b, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    one = np.ones(1, np.uint64)
    up = np.concatenate([one, np.cumprod(np.full(len(c) - 1, b, np.uint64))])
    down = np.concatenate([one, np.cumprod(np.full(len(c) - width, inverse, np.uint64))])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * up)])
    return ((total[width:] - total[:-width]) * down).view(np.int64)


def containing(texts: DataFrame, queries: DataFrame, key: str, text: str, width: int = 32) -> DataFrame:
    """(key, item, exact): texts that contain a query's text (columns ``item`` and ``query``) of ``width`` characters or more, or equal it.

    Hashes of every window of a text meet the hashes of the queries' first windows in an equi join; the texts
    themselves are joined only for those pairs, and containment is checked on them. Shorter and null texts match nothing.
    """
    kind = dict(texts.dtypes)[key]

    def rows(held: list) -> pd.DataFrame:
        return pd.DataFrame({"k": np.repeat(np.array([k for k, _ in held], object), [len(h) for _, h in held]), "h": np.concatenate([h for _, h in held]) if held else np.empty(0, np.int64)})

    def run(batches):
        for pdf in batches:
            held, size = [], 0
            for k, t in zip(pdf["k"], pdf["t"]):
                held.append((k, np.unique(window_hashes(t, width))))
                size += len(held[-1][1])
                if size > 500_000:
                    yield rows(held)
                    held, size = [], 0
            yield rows(held)

    t = texts.where(F.length(text) >= width).select(F.col(key).alias("k"), F.col(text).alias("t"))
    q = queries.where(F.length("query") >= width)
    head = q.select(F.col("item").alias("k"), F.substring("query", 1, width).alias("t")).mapInPandas(run, f"k {dict(queries.dtypes)['item']}, h bigint").withColumnRenamed("k", "item")
    near = t.mapInPandas(run, f"k {kind}, h bigint").join(head, "h").select("k", "item").distinct()
    x = near.join(t, "k").join(q, "item").where(F.col("t").contains(F.col("query")))
    return x.select(F.col("k").alias(key), "item", (F.col("t") == F.col("query")).alias("exact"))


def best_assignment(edges: pd.DataFrame) -> list[tuple]:
    """A matching of most pairs of a bipartite graph (columns a, b) by augmenting paths, trying vertices in order."""
    near: dict = {}
    for a, b in sorted(set(zip(edges["a"], edges["b"]))):
        near.setdefault(a, []).append(b)
    owner: dict = {}

    def grow(a, seen: set) -> bool:
        for b in near[a]:
            if b not in seen:
                seen.add(b)
                if b not in owner or grow(owner[b], seen):
                    owner[b] = a
                    return True
        return False

    for a in near:
        grow(a, set())
    return sorted((a, b) for b, a in owner.items())


def quota_matching(candidates: DataFrame, group: str) -> DataFrame:
    """(group, a, b): per group a one-to-one matching of most candidates (columns a, b as bigint)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = best_assignment(pdf)
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(m), "a": [x for x, _ in m], "b": [y for _, y in m]})

    return candidates.groupBy(group).applyInPandas(run, f"{group} {dict(candidates.dtypes)[group]}, a bigint, b bigint")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def eligibility(rules: Mapping) -> Column:
    """A predicate from declarative rules: any (list of rules), min, max, equals (a value or list), in; values that are no numbers fail min and max."""
    out = F.lit(True)
    for kind, spec in rules.items():
        if kind == "any":
            out = out & F.reduce(F.array(*[eligibility(r) for r in spec]), F.lit(False), lambda a, x: a | F.coalesce(x, F.lit(False)))
            continue
        for c, v in spec.items():
            if kind in ("min", "max"):
                number = F.col(c).try_cast("double")
                out = out & F.coalesce(number >= v if kind == "min" else number <= v, F.lit(False))
            elif kind in ("equals", "in"):
                out = out & F.coalesce(F.col(c).cast("string").isin([str(x) for x in (v if isinstance(v, list | tuple) else [v])]), F.lit(False))
            else:
                raise ValueError(f"unknown rule {kind}")
    return out


def power_set(names: Sequence[str], sep: str = "+") -> list[str]:
    """All nonempty combinations in canonical order: by size, then by the order of the names."""
    from itertools import combinations

    return [sep.join(c) for k in range(1, len(names) + 1) for c in combinations(names, k)]


