"""Weights and grouped metrics of scored binary cohorts. Labels are 0/1; rows with null labels or scores don't count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.session import in_ranges, with_sums_below


def six(c: Column | str, name: str) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 6).alias(name)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def hierarchical_weights(df: DataFrame, levels: Sequence[str] = ("label", "source_group", "group_id"), out: str = "weight") -> DataFrame:
    """Equal mass for the values of each level within the one above, down to rows; weights sum to the number of rows.

    Each level's number of children is counted per distinct path (map-side combined) and joined back.
    """
    levels = list(levels)
    paths = df.groupBy(*levels).agg(F.count(F.lit(1)).alias("__n"))
    x = paths
    for i in range(len(levels)):
        above = levels[:i]
        n = paths.select(*levels[: i + 1]).distinct().groupBy(*above).agg(F.count(F.lit(1)).alias(f"__c{i}")) if above else None
        x = x.join(n, above) if above else x.withColumn("__c0", F.lit(paths.select(levels[0]).distinct().count()))
    total = df.count()
    product = F.col("__n")
    for i in range(len(levels)):
        product = product * F.col(f"__c{i}")
    return df.join(x.select(*levels, (F.lit(float(total)) / product).alias(out)), levels)


def confusion(df: DataFrame, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """tp, fn, fp, tn, sensitivity, specificity and balanced accuracy per group; a rate of an empty class is null."""
    pos, hit = F.col("label") == 1, F.col("score") >= threshold
    n = lambda c: F.count(F.when(c, 1))
    a = df.groupBy(*by).agg(n(pos & hit).alias("tp"), n(pos & ~hit).alias("fn"), n(~pos & hit).alias("fp"), n(~pos & ~hit).alias("tn"))
    a = a.withColumns({"sensitivity": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "specificity": ratio(F.col("tn"), F.col("tn") + F.col("fp"))})
    return a.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def auc(df: DataFrame, by: Sequence[str], weight: Column | None = None, out: str = "auc") -> DataFrame:
    """Weighted area under the curve with half credit for ties, per group; null without both classes.

    Rows are first summed per score; sums below a score are taken over ranges of scores, so no task sorts a whole group.
    """
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    s = df.where("label in (0, 1) and score is not null").groupBy(*by, "score").agg(F.sum(F.when(F.col("label") == 1, w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("label") == 0, w).otherwise(0.0)).alias("n"))
    s = with_sums_below(s, list(by), "score", {"__below": F.col("n")})
    return s.groupBy(*by).agg(F.try_divide(F.sum(F.col("p") * (F.col("__below") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias(out))


def probability_metrics(df: DataFrame, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Weighted Brier score and log loss (probabilities clipped at 1e-15)."""
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    p = F.greatest(F.least(F.col("score"), F.lit(1 - 1e-15)), F.lit(1e-15))
    y = F.col("label").cast("double")
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    return df.groupBy(*by).agg(F.try_divide(F.sum(w * (F.col("score") - y) * (F.col("score") - y)), F.sum(w)).alias("brier"), F.try_divide(F.sum(w * loss), F.sum(w)).alias("log_loss"))


def calibration_bins(df: DataFrame, by: Sequence[str], weight: Column | None = None, bins: int = 10) -> DataFrame:
    """Per equal-width bin: rows, mass, confidence and positive rate; a score of 1 is in the last bin."""
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(*by, b).agg(F.count(F.lit(1)).alias("rows"), F.sum(w).alias("mass"), F.try_divide(F.sum(w * F.col("score")), F.sum(w)).alias("confidence"), F.try_divide(F.sum(w * F.col("label")), F.sum(w)).alias("positive"))


def expected_calibration_error(bins: DataFrame, by: Sequence[str]) -> DataFrame:
    return bins.groupBy(*by).agg((F.sum(F.col("mass") * F.abs(F.col("confidence") - F.col("positive"))) / F.sum("mass")).alias("ece"))


def source_pairs(df: DataFrame, by: Sequence[str] = (), least_groups: int = 1) -> DataFrame:
    """Metrics of each pair of a human and a generated source: rows, confusion rates and AUC.

    Counts add up per source, so they are aggregated per source first and paired after. The AUC of a pair needs its distinct scores only,
    which the pairs of sources join; sources are few, rows are not multiplied. Pairs in which a class has fewer than ``least_groups``
    groups are left out.
    """
    by = list(by)
    hit = F.col("score") >= 0.5
    s = df.groupBy(*by, "label", "source_group").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(hit == (F.col("label") == 1), 1)).alias("right"), F.count_distinct("group_id").alias("groups"))
    h = s.where("label = 0").select(*by, F.col("source_group").alias("human_source"), F.col("n").alias("human_rows"), F.col("right").alias("hr"), F.col("groups").alias("hg"))
    a = s.where("label = 1").select(*by, F.col("source_group").alias("ai_source"), F.col("n").alias("ai_rows"), F.col("right").alias("ar"), F.col("groups").alias("ag"))
    key = by or ["__one"]
    if not by:
        h, a = h.withColumn("__one", F.lit(1)), a.withColumn("__one", F.lit(1))
    pairs = h.join(a, key).where((F.col("hg") >= least_groups) & (F.col("ag") >= least_groups)).withColumns({"sensitivity": ratio(F.col("ar"), F.col("ai_rows")), "specificity": ratio(F.col("hr"), F.col("human_rows"))})
    scores = df.groupBy(*by, "label", "source_group", "score").agg(F.count(F.lit(1)).alias("m"))
    names = pairs.select(*by, "human_source", "ai_source")
    one = lambda label, side: scores.where(F.col("label") == label).select(*by, F.col("source_group").alias(side), "score", "m", F.lit(label).alias("label"))
    both = names.join(one(0, "human_source"), [*by, "human_source"]).select(*by, "human_source", "ai_source", "label", "score", "m").unionByName(names.join(one(1, "ai_source"), [*by, "ai_source"]).select(*by, "human_source", "ai_source", "label", "score", "m"))
    area = auc(both, [*by, "human_source", "ai_source"], F.col("m"))
    return pairs.join(area, [*by, "human_source", "ai_source"]).select(*by, "human_source", "ai_source", "human_rows", "ai_rows", "sensitivity", "specificity", ((F.col("sensitivity") + F.col("specificity")) / 2).alias("balanced_accuracy"), "auc")


def nested_mean(df: DataFrame, value: Column, levels: Sequence[Sequence[str]], out: str) -> DataFrame:
    """Means of means: over rows within levels[0], then over those within levels[1], and so on; nulls are skipped."""
    x = df.groupBy(*levels[0]).agg(F.avg(value).alias(out))
    for level in levels[1:]:
        x = x.groupBy(*level).agg(F.avg(out).alias(out))
    return x


def with_average_rank(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Adds the rank of ``value`` with ties sharing their mean rank, ascending, within ``by``; a null value has none.

    Values are counted first; ranks come from sums over ranges of values and are joined back.
    """
    by = list(by)
    n = with_sums_below(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")), by, value, {"__below": F.col("__n")})
    r = n.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(by)], F.col(value).alias("__rv"), (F.col("__below") + (F.col("__n") + 1) / F.lit(2.0)).alias(out))
    return df.join(r, [*[df[k].eqNullSafe(r[f"__r{i}"]) for i, k in enumerate(by)], df[value] == r["__rv"]], "left").drop("__rv", *[f"__r{i}" for i in range(len(by))])


def error_summary(df: DataFrame, by: Sequence[str], reference: str, estimate: str) -> DataFrame:
    """Bias, mean, median and 90th percentile of absolute error, root mean square error and correlation over known pairs."""
    e = F.col(estimate) - F.col(reference)
    x = df.where(F.col(reference).isNotNull() & F.col(estimate).isNotNull())
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.percentile(F.abs(e), F.lit(0.5)).alias("median_ae"), F.percentile(F.abs(e), F.lit(0.9)).alias("p90_ae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr(reference, estimate).alias("pearson"))


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = (), out: str = "adjusted") -> DataFrame:
    """Adjusted p-values within ``by``: the running minimum from the greatest of p * m / rank, at most 1; null for null.

    Equal values are one, ranked by the last of them. Ranks and minima are taken over ranges of values, no task holds a whole group.
    """
    by = list(by)
    n = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("__n"))
    total = n.groupBy(*by).agg(F.sum("__n").alias("__m")).select(*[F.col(k).alias(f"__t{i}") for i, k in enumerate(by)], "__m")
    x = with_sums_below(n, by, p, {"__below": F.col("__n")})
    x = x.crossJoin(F.broadcast(total)) if not by else x.join(total, [x[k].eqNullSafe(total[f"__t{i}"]) for i, k in enumerate(by)])  # without keys: one row
    x = in_ranges(x.select(*by, p, (F.col(p) * F.col("__m") / (F.col("__below") + F.col("__n"))).alias("__r")), by, p)
    least = x.groupBy(*by, "__b").agg(F.min("__r").alias("__l"))
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # over ranges
    above = least.select(*[F.col(k).alias(f"__t{i}") for i, k in enumerate(by)], F.col("__b").alias("__c"), F.min("__l").over(part.orderBy(F.desc("__b")).rowsBetween(W.unboundedPreceding, -1)).alias("__up"))
    x = x.withColumn("__in", F.min("__r").over(W.partitionBy(*by, "__b").orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)))
    x = x.join(above, [*[x[k].eqNullSafe(above[f"__t{i}"]) for i, k in enumerate(by)], x["__b"] == above["__c"]])
    r = x.select(*[F.col(k).alias(f"__t{i}") for i, k in enumerate(by)], F.col(p).alias("__p"), F.least(F.lit(1.0), F.col("__in"), F.col("__up")).alias(out))
    return df.join(r, [*[df[k].eqNullSafe(r[f"__t{i}"]) for i, k in enumerate(by)], df[p] == r["__p"]], "left").drop("__p", *[f"__t{i}" for i in range(len(by))])


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k of n; null for n = 0."""
    p, n = ratio(k, n), n.cast("double")
    mid = F.try_divide(p + F.lit(z * z) / (2 * n), 1 + F.lit(z * z) / n)
    half = F.try_divide(F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.lit(z * z) / (4 * n * n)), 1 + F.lit(z * z) / n)
    return mid - half, mid + half


def effect_sizes(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Medians, mean difference, pooled Cohen's d (ddof 1) and AUC of a value between labels 1 and 0."""
    v = lambda y: F.when(F.col("label") == y, F.col(value))
    x = df.where(F.col(value).isNotNull())
    a = x.groupBy(*by).agg(*[f(v(y)).alias(f"{n}{y}") for y in (0, 1) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp), ("median", F.median))])
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("var0") + (F.col("n1") - 1) * F.col("var1")) / (F.col("n0") + F.col("n1") - 2))
    a = a.select(*by, "median0", "median1", (F.col("mean1") - F.col("mean0")).alias("mean_difference"), F.try_divide(F.col("mean1") - F.col("mean0"), pooled).alias("cohens_d"))
    area = auc(x.withColumn("score", F.col(value).cast("double")), by)
    return a.join(area, list(by)) if by else a.crossJoin(area)  # one row each


def choose_threshold(df: DataFrame, weight: Column) -> DataFrame:
    """The score threshold of the greatest weighted balanced accuracy; ties go to the one nearest 0.5, then to the lowest. One row."""
    s = df.groupBy("score").agg(F.sum(F.when(F.col("label") == 1, weight).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("label") == 0, weight).otherwise(0.0)).alias("n"))
    all_ = s.agg(F.sum("p").alias("__p"), F.sum("n").alias("__n"))  # one row
    s = with_sums_below(s, [], "score", {"__pb": F.col("p"), "__nb": F.col("n")}).crossJoin(F.broadcast(all_))
    s = s.select("score", ((1 - F.col("__pb") / F.col("__p")) / 2 + F.col("__nb") / F.col("__n") / 2).alias("ba")).withColumn("ba", F.round("ba", 9))
    return s.orderBy(F.desc("ba"), F.abs(F.col("score") - 0.5), "score").limit(1)
