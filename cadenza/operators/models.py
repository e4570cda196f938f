"""Small weighted linear models: one Gram matrix per fit, solved on the driver; replay, calibration and explanation as expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.session import cut

MODES = ("values_plus_missing", "median_only", "missingness_only")


@dataclass(frozen=True)
class Prepared:
    """Column-wise preparation of a training set and its full Gram matrix, from which every subset of columns is sliced.

    Order of the design: the values of ``columns``, then their indicators of missing values.
    """

    columns: tuple[str, ...]
    medians: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    gram: np.ndarray
    moment: np.ndarray
    mass: float
    target: float


@dataclass(frozen=True)
class Ridge:
    columns: tuple[str, ...]
    mode: str
    medians: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    coefficients: np.ndarray
    intercept: float


def design(columns: Sequence[str], medians: Sequence[float]) -> list[Column]:
    """Imputed values, then indicators."""
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return [F.when(known(c), F.col(c)).otherwise(F.lit(float(m))) for c, m in zip(columns, medians)] + [F.when(known(c), 0.0).otherwise(1.0) for c in columns]


def exact_medians(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The median of each column's known values, 0 for none, in three aggregations without a shuffle of rows.

    Approximate quantiles (to 1 in 10,000 of rank) enclose the median in a thousandth of the ranks on either side; values below are counted;
    only the values enclosed are kept by the exact aggregate, about one in 500 of the different ones.
    """
    n = len(columns)
    v = [F.when(~F.isnan(c), F.col(c).cast("double")) for c in columns]
    near = df.agg(*[F.percentile_approx(x, [0.499, 0.501], 10_000).alias(f"q{i}") for i, x in enumerate(v)]).first()
    known = [i for i in range(n) if near[f"q{i}"]]
    out = np.zeros(n)
    if not known:
        return out
    inside = {i: F.when((v[i] >= near[f"q{i}"][0]) & (v[i] <= near[f"q{i}"][1]), v[i]) for i in known}
    count = df.agg(*[f.alias(f"{k}{i}") for i in known for k, f in (("n", F.count(v[i])), ("b", F.count(F.when(v[i] < near[f"q{i}"][0], 1))), ("m", F.count(inside[i])))]).first()
    at = lambda i, rank: F.percentile(inside[i], F.lit((rank - count[f"b{i}"]) / max(count[f"m{i}"] - 1, 1)))
    mid = df.agg(*[at(i, r).alias(f"{k}{i}") for i in known for k, r in (("a", (count[f"n{i}"] - 1) // 2), ("z", count[f"n{i}"] // 2))]).first()
    for i in known:
        out[i] = (mid[f"a{i}"] + mid[f"z{i}"]) / 2
    return out


def prepare(df: DataFrame, columns: Sequence[str], weight: str) -> Prepared:
    """Medians of the known training values (0 if none), weighted means, population deviations and the Gram matrix.

    The matrix is p x p sums of products, combined map-side; its size depends on the number of columns only.
    """
    columns = tuple(columns)
    p = 2 * len(columns)
    df = cut(df.select(weight, "label", *columns))  # read five times
    medians = exact_medians(df, columns)
    x = df.select(F.col(weight).cast("double").alias("w"), F.col("label").cast("double").alias("y"), *[d.alias(f"x{i}") for i, d in enumerate(design(columns, medians))])
    w = F.col("w")
    sums = [F.sum(w).alias("w"), F.sum(w * F.col("y")).alias("wy"), *[F.sum(w * F.col(f"x{i}")).alias(f"s{i}") for i in range(p)], *[F.sum(w * F.col(f"x{i}") * F.col("y")).alias(f"t{i}") for i in range(p)], *[F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]]
    r = x.agg(*sums).first()
    mass = r["w"] or 0.0
    mean = np.array([r[f"s{i}"] for i in range(p)]) / mass
    raw = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    cov = raw - mass * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov) / mass, 0))
    scale[scale < 1e-8] = 1.0
    target = r["wy"] / mass
    moment = (np.array([r[f"t{i}"] for i in range(p)]) - mass * mean * target) / scale
    return Prepared(columns, medians, mean, scale, cov / np.outer(scale, scale), moment, mass, target)


def ridge(prep: Prepared, columns: Sequence[str] | None = None, mode: str = "values_plus_missing", alpha: float = 10.0) -> Ridge:
    """The ridge fit on a subset of the prepared columns by slicing the Gram matrix; the intercept is not penalised."""
    n = len(prep.columns)
    own = [prep.columns.index(c) for c in (columns or prep.columns)]
    at = {"values_plus_missing": own + [n + i for i in own], "median_only": own, "missingness_only": [n + i for i in own]}[mode]
    beta = np.linalg.solve(prep.gram[np.ix_(at, at)] + alpha * np.eye(len(at)), prep.moment[at])
    full = np.zeros(2 * n)
    full[at] = beta
    pick = own + [n + i for i in own]
    return Ridge(tuple(prep.columns[i] for i in own), mode, prep.medians[own], prep.mean[pick], prep.scale[pick], full[pick], prep.target)


def normal_equation_residual(prep: Prepared, model: Ridge, alpha: float = 10.0) -> tuple[float, float]:
    """Largest residual of the normal equations and the tolerance 128 eps p max(1, |A||b|, |r|) that it must not pass."""
    n = len(prep.columns)
    own = [prep.columns.index(c) for c in model.columns]
    at = own + [n + i for i in own]
    used = [k for k, i in enumerate(at) if model.mode == "values_plus_missing" or (i < n) == (model.mode == "median_only")]
    a = prep.gram[np.ix_(at, at)][np.ix_(used, used)] + alpha * np.eye(len(used))
    b, r = model.coefficients[used], prep.moment[at][used]
    return float(np.abs(a @ b - r).max()), float(128 * np.finfo(float).eps * len(used) * max(1.0, np.abs(a).max() * np.abs(b).max(), np.abs(r).max()))


def terms(model: Ridge) -> list[tuple[str, str, Column]]:
    """(column, kind, contribution) of each term of the score."""
    x = design(model.columns, model.medians)
    n = len(model.columns)
    return [(model.columns[i % n], "value" if i < n else "missing", (c - float(model.mean[i])) / float(model.scale[i]) * float(model.coefficients[i])) for i, c in enumerate(x)]


def raw_score(model: Ridge) -> Column:
    out = F.lit(float(model.intercept))
    for _, _, c in terms(model):
        out = out + c
    return out


def platt(df: DataFrame, score: str, weight: str, rounds: int = 60) -> tuple[float, float, float, float]:
    """(slope, intercept, centre, spread) of the weighted logistic link with a slope of 0 or more: projected Newton steps on aggregated sums."""
    s, w, y = F.col(score), F.col(weight).cast("double"), F.col("label").cast("double")
    m = df.agg((F.sum(w * s) / F.sum(w)).alias("m"), (F.sum(w * s * s) / F.sum(w)).alias("q"), F.sum(w).alias("w")).first()
    spread = float(np.sqrt(max(m["q"] - m["m"] ** 2, 0.0)))
    spread = spread if spread >= 1e-8 else 1.0
    z = (s - float(m["m"])) / spread
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-F.greatest(F.least(z * a + b, F.lit(40.0)), F.lit(-40.0))))
        v = w / float(m["w"])
        g = df.agg(F.sum(v * (p - y) * z).alias("ga"), F.sum(v * (p - y)).alias("gb"), F.sum(v * p * (1 - p) * z * z).alias("haa"), F.sum(v * p * (1 - p) * z).alias("hab"), F.sum(v * p * (1 - p)).alias("hbb")).first()
        h = np.array([[g["haa"] + 1e-6, g["hab"]], [g["hab"], g["hbb"] + 1e-12]])
        step = np.linalg.solve(h, [g["ga"] + 1e-6 * a, g["gb"]])
        na, nb = float(np.clip(a - step[0], 0, 1e4)), float(np.clip(b - step[1], -50, 50))
        done = max(abs(na - a), abs(nb - b)) < 1e-9
        a, b = na, nb
        if done:
            break
    return a, b, float(m["m"]), spread


def logistic(df: DataFrame, columns: Sequence[str], weight: str, ridge_: float = 1.0, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, coefficients with intercept first) of an L2 logistic regression by Newton steps; each step is one aggregation of p x p sums."""
    w, y = F.col(weight).cast("double"), F.col("label").cast("double")
    known = df.select(w.alias("w"), y.alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)])
    p = len(columns)
    m = known.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)], *[F.stddev_pop(f"x{i}").alias(f"d{i}") for i in range(p)]).first()
    mean, scale = np.array([m[f"m{i}"] for i in range(p)]), np.array([m[f"d{i}"] if m[f"d{i}"] > 1e-8 else 1.0 for i in range(p)])
    z = [F.lit(1.0), *[(F.col(f"x{i}") - float(mean[i])) / float(scale[i]) for i in range(p)]]
    beta = np.zeros(p + 1)
    for _ in range(rounds):
        link = F.lit(0.0)
        for c, x in zip(beta, z):
            link = link + x * float(c)
        q = 1 / (1 + F.exp(-F.greatest(F.least(link, F.lit(40.0)), F.lit(-40.0))))
        r = known.agg(*[F.sum(F.col("w") * (F.col("y") - q) * z[i]).alias(f"g{i}") for i in range(p + 1)], *[F.sum(F.col("w") * q * (1 - q) * z[i] * z[j]).alias(f"h{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]).first()
        pen = np.array([0.0, *[ridge_] * p])
        h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)]) + np.diag(pen + 1e-12)
        step = np.linalg.solve(h, np.array([r[f"g{i}"] for i in range(p + 1)]) - pen * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, beta


def fit_combinations(df: DataFrame, families: Mapping[str, Sequence[str]], weight: str, combinations: Sequence[str]) -> dict[str, Ridge]:
    """A model for each combination of families from one shared preparation."""
    columns = list(dict.fromkeys(c for f in families.values() for c in f))
    prep = prepare(df, columns, weight)
    return {c: ridge(prep, [x for f in c.split("+") for x in families[f]]) for c in combinations}


def score_models(df: DataFrame, models: Mapping[str, Ridge], keep: Sequence[str]) -> DataFrame:
    """(<keep>, combination, raw, predicted) of every model for every row, in one pass: the models' terms are literals of the plan."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("combination"), raw_score(m).alias("raw")) for n, m in models.items()])).alias("s")
    return df.select(*keep, each).select(*keep, "s.combination", "s.raw", (F.col("s.raw") >= 0.5).alias("predicted"))


def receipt_faults(columns: Mapping[str, Sequence[str]], combination: Column, families: Column, mode: Column, digests: Mapping[str, Column], values: Column, modes: Sequence[str] = MODES) -> Column:
    """array<string> of what is wrong with a receipt's row, in this order; empty for a sound one.

    ``columns``: the columns of each family in canonical order of the families. ``families``: those the row's combination names, however it is
    written (array<string>). Faults: each of ``digests`` (by name) that isn't 64 hex digits; combination, if not the families in canonical
    order joined by +; mode, if none of ``modes``; no_values without a map; foreign_column, a column of no family of the combination;
    missing_column, one of the combination that is absent; infinite_value. A null or NaN value is no fault: it is imputed.
    """
    order = F.array(*[F.lit(f) for f in columns])
    own = F.filter(order, lambda f: F.array_contains(families, f))
    known = F.create_map(*[x for f, c in columns.items() for x in (F.lit(f), F.array(*[F.lit(n) for n in c]))])
    want = F.coalesce(F.flatten(F.transform(own, lambda f: F.try_element_at(known, f))), F.array().cast("array<string>"))
    keys = F.map_keys(values)
    flag = lambda bad, name: F.when(F.coalesce(bad, F.lit(True)), F.lit(name))
    has = values.isNotNull()
    return F.array_compact(
        F.array(
            *[flag(~c.rlike("^[0-9a-f]{64}$"), n) for n, c in digests.items()],
            flag((F.array_join(own, "+") != combination) | (F.size(own) == 0), "combination"),
            flag(~mode.isin(list(modes)), "mode"),
            F.when(~has, F.lit("no_values")),
            F.when(has & (F.size(F.array_except(keys, want)) > 0), F.lit("foreign_column")),
            F.when(has & (F.size(F.array_except(want, keys)) > 0), F.lit("missing_column")),
            F.when(has & F.exists(F.map_values(values), lambda v: F.coalesce(F.abs(v) == F.lit(float("inf")), F.lit(False))), F.lit("infinite_value")),
        )
    )
