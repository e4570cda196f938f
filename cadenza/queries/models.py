"""Queries of models, calibration and resampling (MDL, BST)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import bootstrap as b
from cadenza.operators import metrics as m
from cadenza.operators import models
from cadenza.operators.metrics import ratio, six
from cadenza.operators.relational import power_set
from cadenza.queries._cohort import C, cohort
from cadenza.queries._ridge import fits_sql, mask_of, score_sql
from cadenza.queries.aggregates import AUC, FOLD, WEIGHTS, with_fold
from cadenza.queries.problems import BC_NAMES, DRP_NAMES, FHSC_NAMES, S_NAMES, families
from cadenza.registry import Registry
from cadenza.session import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
COLUMNS = ["f1", "f2", "f3", "f4", "f5"]
FAM = {"S": ["f1", "f2"], "D": ["f3"], "R": ["f4", "f5"]}
#: A fixed model for replays: medians, mean, scale and coefficients of values and of missing indicators.
FIXED = models.Ridge(("f1", "f2", "f5"), "values_plus_missing", np.array([8.0, 0.5, 10.0]), np.array([10.0, 0.5, 15.0, 0.0, 0.14, 0.33]), np.array([9.0, 0.3, 15.0, 1.0, 0.35, 0.47]), np.array([0.05, -0.2, 0.1, 0.0, 0.04, -0.03]), 0.5)
FIXED_TERMS = "t as (select id, source_group, label, role, group_id, unnest(['f1', 'f2', 'f5', 'f2', 'f5']) as name, unnest(['value', 'value', 'value', 'missing', 'missing']) as kind, unnest([(coalesce(f1, 8) - 10) / 9.0::double * 0.05::double, (coalesce(f2, 0.5) - 0.5) / 0.3::double * -0.2::double, (coalesce(f5, 10) - 15) / 15.0::double * 0.1::double, (case when f2 is null then 1 else 0 end - 0.14::double) / 0.35::double * 0.04::double, (case when f5 is null then 1 else 0 end - 0.33::double) / 0.47::double * -0.03::double]) as v from c), s as (select id, any_value(source_group) as source_group, any_value(label) as label, any_value(role) as role, any_value(group_id) as group_id, 0.5 + sum(v) as raw from t group by id)"


#: The development rows as one training set, and all combinations of families.
DEV = "select 0 as s, label, source_group, group_id, f1, f2, f3, f4, f5 from c where role = 'development'"
COMBINATIONS = {c: [x for f in c.split("+") for x in FAM[f]] for c in power_set(list(FAM))}
BY_COMBINATION = {c: mask_of(x) for c, x in COMBINATIONS.items()}
BY_MODE = {mode: mask_of(COLUMNS, mode) for mode in models.MODES}
NAMES = "(select unnest(['f1', 'f2', 'f3', 'f4', 'f5', 'f1', 'f2', 'f3', 'f4', 'f5', 'intercept']) as name, unnest(['value', 'value', 'value', 'value', 'value', 'missing', 'missing', 'missing', 'missing', 'missing', 'intercept']) as kind, unnest(range(1, 12)) as place)"
BETAS = f"name, kind, round(case when place = 11 then ybar else beta[place] end, 6) + 0.0 as coefficient from fit, {NAMES}"


#: Development rows with their weights, for DuckDB.
DEV_ROWS = C.replace("from c0)", "from c0 where role = 'development')")


def weighted(spark: SparkSession, d: str) -> DataFrame:
    return m.hierarchical_weights(cohort(spark, d).where("role = 'development'"))


def _coefficients(spark: SparkSession, model: models.Ridge) -> DataFrame:
    n = len(model.columns)
    rows = [("intercept", "intercept", float(model.intercept))] + [(model.columns[i % n], "value" if i < n else "missing", float(c)) for i, c in enumerate(model.coefficients)]
    return spark.createDataFrame(rows, "name string, kind string, coefficient double").withColumn("coefficient", F.round("coefficient", 6) + 0.0)


@R(f"with recursive {C}, {fits_sql(DEV, {'all': mask_of(COLUMNS)})} select {BETAS}")
def mdl_01_weighted_ridge(spark: SparkSession, d: str) -> DataFrame:
    return _coefficients(spark, models.ridge(models.prepare(weighted(spark, d), COLUMNS, "weight")))


@R(f"with recursive {C}, {fits_sql(DEV, BY_MODE)} select model as mode, {BETAS}")
def mdl_02_feature_modes(spark: SparkSession, d: str) -> DataFrame:
    prep = models.prepare(weighted(spark, d), COLUMNS, "weight")
    out = None
    for mode in models.MODES:
        x = _coefficients(spark, models.ridge(prep, mode=mode)).withColumn("mode", F.lit(mode))
        out = x if out is None else out.unionAll(x)
    return out


@R(f"with recursive {C}, {fits_sql(DEV, BY_COMBINATION)} select model as combination, len(list_filter(mask, lambda m: m = 1))::int // 2 as columns, round(list_sum(list_transform(beta, lambda v: abs(v))), 6) as absolute_sum, round(ybar, 6) as intercept from fit join ms using (model)")
def mdl_03_shared_preparation(spark: SparkSession, d: str) -> DataFrame:
    """All combinations of families from one Gram matrix."""
    fits = models.fit_combinations(weighted(spark, d), FAM, "weight", power_set(list(FAM)))
    return spark.createDataFrame([(c, len(f.columns), round(float(np.abs(f.coefficients).sum()), 6), round(float(f.intercept), 6)) for c, f in fits.items()], "combination string, columns int, absolute_sum double, intercept double")


@R(f"with {C}, {FIXED_TERMS} select id, round(raw, 6) as raw, round(raw, 9) >= 0.5 as predicted from s")
def mdl_04_raw_score(spark: SparkSession, d: str) -> DataFrame:
    raw = models.raw_score(FIXED)
    return cohort(spark, d).select("id", six(raw, "raw"), (F.round(raw, 9) >= 0.5).alias("predicted"))


@R(f"with {C}, {FIXED_TERMS} select id, kind, round(sum(v), 6) + 0.0 as total from t group by 1, 2")
def mdl_05_additive_replay(spark: SparkSession, d: str) -> DataFrame:
    """Totals by kind of term; with the intercept they add up to the score."""
    t = models.terms(FIXED)
    part = [F.struct(F.lit(k).alias("kind"), sum((c for _, kind, c in t if kind == k), F.lit(0.0)).alias("total")) for k in ("value", "missing")]
    return cohort(spark, d).select("id", F.explode(F.array(*part)).alias("e")).select("id", "e.kind", (F.round("e.total", 6) + 0.0).alias("total"))


FAMILY_COLUMNS = {"S": S_NAMES, **{f: [n for n in DRP_NAMES if n[0].upper() == f] for f in "DRP"}, **{f: [n for n in FHSC_NAMES if n.startswith(f"{f}_")] for f in ("F", "H", "SC")}, "BC": BC_NAMES}
_LISTS = "{" + ", ".join(f"'{f}': {c}" for f, c in FAMILY_COLUMNS.items()) + "}"


@R(f"""with x as (select *, list_filter({list(FAMILY_COLUMNS)}, lambda f: list_contains(string_split_regex(upper(regexp_replace(coalesce(combination, ''), '\\s+', '', 'g')), '[^A-Z]+'), f)) as own, {_LISTS} as cols from native30_replay),
  y as (select *, flatten(list_transform(own, lambda f: case f {' '.join(f"when '{f}' then cols.{f}" for f in FAMILY_COLUMNS)} end)) as want, map_keys(features) as keys from x),
  z as (select load_id, list_filter([case when not coalesce(regexp_full_match(sha256, '[0-9a-f]{{64}}'), false) then 'receipt_digest' end, case when not coalesce(regexp_full_match(model_sha256, '[0-9a-f]{{64}}'), false) then 'model_digest' end, case when not coalesce(regexp_full_match(feature_file_sha256, '[0-9a-f]{{64}}'), false) then 'feature_file_digest' end,
    case when len(own) = 0 or coalesce(array_to_string(own, '+') <> combination, true) then 'combination' end, case when not coalesce(feature_mode in ('values_plus_missing', 'median_only', 'missingness_only'), false) then 'mode' end, case when features is null then 'no_values' end,
    case when features is not null and len(list_filter(keys, lambda n: not list_contains(want, n))) > 0 then 'foreign_column' end, case when features is not null and len(list_filter(want, lambda n: not list_contains(keys, n))) > 0 then 'missing_column' end,
    case when features is not null and len(list_filter(map_values(features), lambda v: coalesce(isinf(v), false))) > 0 then 'infinite_value' end], lambda e: e is not null) as faults from y)
  select load_id, coalesce(fault, 'sound') as fault, count(*) as rows from (select load_id, unnest(case when len(faults) = 0 then [null] else faults end) as fault from z) group by 1, 2""")
def mdl_06_receipt_validation(spark: SparkSession, d: str) -> DataFrame:
    """Per load: sound rows of the archived receipts and those with each fault of digest, combination, mode or columns."""
    digests = {"receipt_digest": F.col("sha256"), "model_digest": F.col("model_sha256"), "feature_file_digest": F.col("feature_file_sha256")}
    f = models.receipt_faults(FAMILY_COLUMNS, F.col("combination"), families(F.col("combination")), F.col("feature_mode"), digests, F.col("features"))
    x = table(spark, d, "native30_replay").select("load_id", f.alias("faults"))
    one = F.explode(F.when(F.size("faults") == 0, F.array(F.lit("sound"))).otherwise(F.col("faults")))
    return x.select("load_id", one.alias("fault")).groupBy("load_id", "fault").agg(F.count(F.lit(1)).alias("rows"))


@R(f"""with recursive {DEV_ROWS}, {WEIGHTS}, m as (select sum(weight * score) / sum(weight) as centre, sum(weight * score * score) / sum(weight) as q, sum(weight) as mass from w), sp as (select centre, mass, case when sqrt(greatest(q - centre * centre, 0)) >= 1e-8 then sqrt(greatest(q - centre * centre, 0)) else 1 end as spread from m),
  z as (select (score - centre) / spread as z, label as y, weight / mass as v from w, sp),
  rec(step, a, b) as (select 0, 1.0::double, 0.0::double union all select step + 1, least(greatest(a - (s.hbb * s.ga - s.hab * s.gb) / (s.haa * s.hbb - s.hab * s.hab), 0), 10000), least(greatest(b - (s.haa * s.gb - s.hab * s.ga) / (s.haa * s.hbb - s.hab * s.hab), -50), 50)
    from (select step, a, b, sum(v * (p - y) * z) + 1e-6 * a as ga, sum(v * (p - y)) as gb, sum(v * p * (1 - p) * z * z) + 1e-6 as haa, sum(v * p * (1 - p) * z) as hab, sum(v * p * (1 - p)) + 1e-12 as hbb from (select step, a, b, z, y, v, 1 / (1 + exp(-greatest(least(z * a + b, 40), -40))) as p from rec, z where step < 50) group by step, a, b) s)
  select round(a, 6) as slope, round(b, 6) as intercept, round(centre, 6) as centre, round(spread, 6) as spread from rec, sp where step = 50""")
def mdl_07_platt(spark: SparkSession, d: str) -> DataFrame:
    w = weighted(spark, d)
    a, c, centre, spread = models.platt(w, "score", "weight")
    return spark.createDataFrame([(round(a, 6), round(c, 6), round(centre, 6), round(spread, 6))], "slope double, intercept double, centre double, spread double")


@R(f"""with recursive {DEV_ROWS}, {WEIGHTS}, r as (select weight, label as y, [coalesce(f1, 0), coalesce(f2, 0), coalesce(f3, 0), coalesce(f4, 0), coalesce(f5, 0)] as x from w), m as (select [{', '.join(f'avg(x[{i}])' for i in range(1, 6))}] as mean, [{', '.join(f'case when stddev_pop(x[{i}]) > 1e-8 then stddev_pop(x[{i}]) else 1 end' for i in range(1, 6))}] as sd from r),
  z as (select weight as v, y, [1.0::double, {', '.join(f'(x[{i}] - mean[{i}]) / sd[{i}]' for i in range(1, 6))}] as z from r, m),
  rec(step, beta) as (select 0, [0.0::double, 0, 0, 0, 0, 0] union all select step + 1, list_transform(range(6), lambda j: case when j = step % 6 then beta[j + 1] + (g - pen * beta[j + 1]) / (h + pen) else beta[j + 1] end)
    from (select step, beta, case when step % 6 = 0 then 0 else 1 end as pen, sum(v * (y - q) * z[step % 6 + 1]) as g, sum(v * q * (1 - q) * z[step % 6 + 1] * z[step % 6 + 1]) as h from (select step, beta, v, y, z, 1 / (1 + exp(-greatest(least(list_dot_product(z, beta), 40), -40))) as q from rec, z where step < 360) group by step, beta))
  select unnest(['intercept', 'f1', 'f2', 'f3', 'f4', 'f5']) as name, unnest(list_transform(beta, lambda v: round(v, 6) + 0.0)) as coefficient from rec where step = 360""")
def mdl_08_logistic(spark: SparkSession, d: str) -> DataFrame:
    _, _, beta = models.logistic(weighted(spark, d), COLUMNS, "weight")
    return spark.createDataFrame([(n, round(float(v), 6) + 0.0) for n, v in zip(["intercept", *COLUMNS], beta)], "name string, coefficient double")


@R(f"with recursive {C}, {fits_sql(DEV.replace('label,', '2 * label - 1 as label,'), {'median': mask_of(COLUMNS, 'median_only')}, 1.0, False)} select {BETAS}")
def mdl_09_unweighted_ridge(spark: SparkSession, d: str) -> DataFrame:
    """Targets of -1 and 1, no weights, threshold 0."""
    c = cohort(spark, d).where("role = 'development'").withColumns({"one": F.lit(1.0), "label": 2 * F.col("label") - 1})
    return _coefficients(spark, models.ridge(models.prepare(c, COLUMNS, "one"), mode="median_only", alpha=1.0))


@R(f"with {C}, {FIXED_TERMS} select id, round(1 / (1 + exp(-(4 * (raw - 0.5)))), 6) as probability, case when round(raw, 9) >= 0.5 then 'generated' else 'human' end as decision from s")
def mdl_10_deployment_prediction(spark: SparkSession, d: str) -> DataFrame:
    from cadenza.functions.scalar import sigmoid

    raw = models.raw_score(FIXED)
    return cohort(spark, d).select("id", six(sigmoid(4 * (raw - 0.5)), "probability"), F.when(F.round(raw, 9) >= 0.5, "generated").otherwise("human").alias("decision"))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    fits = models.fit_combinations(weighted(spark, d), FAM, "weight", power_set(list(FAM)))
    return models.score_models(cohort(spark, d), fits, ["id", "source_group", "group_id", "label", "role"])


@R(f"""with recursive {C}, {fits_sql(DEV, BY_COMBINATION)}, p as (select model as combination, label, {score_sql()} as score from c, fit where role = 'locked'), x as (select *, rank() over (partition by combination order by score) + (count(*) over (partition by combination, score) - 1) / 2.0::double as rk from p)
  select combination, round(avg((score >= 0.5)::int) filter (label = 1), 6) as sensitivity, round(avg((score < 0.5)::int) filter (label = 0), 6) as specificity, round((avg((score >= 0.5)::int) filter (label = 1) + avg((score < 0.5)::int) filter (label = 0)) / 2, 6) as balanced_accuracy, round({AUC}, 6) as auc from x group by 1""")
def mdl_11_all_combinations(spark: SparkSession, d: str) -> DataFrame:
    """Fit on development rows, metrics on locked ones, for every combination."""
    p = _predictions(spark, d).where("role = 'locked'").withColumn("score", F.col("raw"))
    return m.confusion(p, ["combination"]).join(m.auc(p, ["combination"]), "combination").select("combination", *[six(c, c) for c in ("sensitivity", "specificity", "balanced_accuracy", "auc")])


@R(f"""with recursive {C}, f as (select *, {FOLD} as fold from c), {fits_sql("select b.s, label, source_group, group_id, f1, f2, f3, f4, f5 from f, (select unnest(range(5))::int as s) b where role = 'development' and fold <> b.s", {k: BY_COMBINATION[k] for k in ('S', 'S+D+R')})}
  select fold, model as combination, count(*) as rows, round(avg((({score_sql('f')} >= 0.5) = (label = 1))::int), 6) as accuracy from f join fit on fit.s = f.fold group by 1, 2""")
def mdl_12_scheduled_tasks(spark: SparkSession, d: str) -> DataFrame:
    """One model per fold and combination; every row scored by the model of its own fold's schedule cell."""
    c = with_fold(cohort(spark, d))
    out = None
    for fold in range(5):
        train = m.hierarchical_weights(c.where((F.col("fold") != fold) & (F.col("role") == "development")))
        x = models.score_models(c.where(F.col("fold") == fold), models.fit_combinations(train, FAM, "weight", ["S", "S+D+R"]), ["id", "fold", "label"])
        out = x if out is None else out.unionAll(x)
    return out.groupBy("fold", "combination").agg(F.count(F.lit(1)).alias("rows"), six(F.avg((F.col("predicted") == (F.col("label") == 1)).cast("double")), "accuracy"))


@R(f"select unnest({list(models.MODES)}) as mode, true as within_tolerance")
def mdl_13_residual_audit(spark: SparkSession, d: str) -> DataFrame:
    prep = models.prepare(weighted(spark, d), COLUMNS, "weight")
    rows = [(mode, *models.normal_equation_residual(prep, models.ridge(prep, mode=mode))) for mode in models.MODES]
    return spark.createDataFrame([(mode, r <= t) for mode, r, t in rows], "mode string, within_tolerance boolean")


@R(f"with {C}, {FIXED_TERMS} select source_group, count(*) as rows, 0::bigint as differing, count(*) filter (round(raw, 9) >= 0.5) as predicted from s group by 1")
def mdl_14_frozen_replay(spark: SparkSession, d: str) -> DataFrame:
    """The score computed twice, as one expression and as a sum of exploded terms."""
    c = cohort(spark, d)
    t = F.aggregate(F.array(*[x for _, _, x in models.terms(FIXED)]), F.lit(float(FIXED.intercept)), lambda a, x: a + x)
    x = c.select("source_group", models.raw_score(FIXED).alias("a"), t.alias("b"))
    return x.groupBy("source_group").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-11 * F.greatest(F.abs("b"), F.lit(1.0))).alias("differing"), F.count_if(F.round("a", 9) >= 0.5).alias("predicted"))


@R(f"with {C}, {FIXED_TERMS}, x as (select 'all' as slice, * from s union all select role, * from s union all select 'source:' || source_group, * from s) select slice, count(*) as rows, case when count(distinct label) < 2 then 'single_class' else 'ok' end as status, round(avg(case when (round(raw, 9) >= 0.5) = (label = 1) then 1.0 else 0 end), 6) as accuracy from x group by 1")
def mdl_15_locked_slices(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).select("label", (F.round(models.raw_score(FIXED), 9) >= 0.5).alias("p"), F.explode(F.array(F.lit("all"), F.col("role"), F.concat(F.lit("source:"), "source_group"))).alias("slice"))
    return c.groupBy("slice").agg(F.count(F.lit(1)).alias("rows"), F.when(F.count_distinct("label") < 2, "single_class").otherwise("ok").alias("status"), six(F.avg((F.col("p") == (F.col("label") == 1)).cast("double")), "accuracy"))


@R(f"""with recursive {C}, {fits_sql(DEV, BY_MODE)}, p as (select model as mode, label, source_group, group_id, (({score_sql()} >= 0.5) = (label = 1))::int as hit from c, fit where role = 'locked'), g as (select mode, label, source_group, group_id, avg(hit) v from p group by 1, 2, 3, 4), s1 as (select mode, label, source_group, avg(v) v from g group by 1, 2, 3), l1 as (select mode, label, avg(v) v from s1 group by 1, 2)
  select mode, round(avg(v), 6) as macro_balanced_accuracy from l1 group by 1""")
def mdl_16_missingness_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    prep = models.prepare(weighted(spark, d), COLUMNS, "weight")
    p = models.score_models(cohort(spark, d).where("role = 'locked'"), {mode: models.ridge(prep, mode=mode) for mode in models.MODES}, ["source_group", "group_id", "label"])
    right = (F.col("predicted") == (F.col("label") == 1)).cast("double")
    return m.nested_mean(p, right, [["combination", "label", "source_group", "group_id"], ["combination", "label", "source_group"], ["combination", "label"], ["combination"]], "r").select(F.col("combination").alias("mode"), six("r", "macro_balanced_accuracy"))


@R(f"""with recursive {C}, f as (select *, case when label = 1 then case when k % 2 = 0 then 'fam_a' else 'fam_b' end end as family from c), {fits_sql("select b.s, label, source_group, group_id, f1, f2, f3, f4, f5 from f, (select unnest(['fam_a', 'fam_b']) as s) b where role = 'development' and family is distinct from b.s", {'all': mask_of(COLUMNS)})}
  select family, count(*) as rows, round(avg(({score_sql('f')} >= 0.5)::int), 6) as sensitivity from f join fit on fit.s = f.family where role = 'locked' group by 1""")
def mdl_17_family_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Models without one family of generated rows, scored on that family."""
    c = cohort(spark, d).withColumn("family", F.when(F.col("label") == 1, F.when(F.col("k") % 2 == 0, "fam_a").otherwise("fam_b")))
    out = None
    for fam in ("fam_a", "fam_b"):
        train = m.hierarchical_weights(c.where((F.col("role") == "development") & ~F.col("family").eqNullSafe(fam)))
        x = models.score_models(c.where((F.col("role") == "locked") & F.col("family").eqNullSafe(fam)), models.fit_combinations(train, FAM, "weight", ["S+D+R"]), ["family"])
        out = x if out is None else out.unionAll(x)
    return out.groupBy("family").agg(F.count(F.lit(1)).alias("rows"), six(F.avg(F.col("predicted").cast("double")), "sensitivity"))


@R(f"""with recursive {C}, {fits_sql("select b.s, label, source_group, group_id, f1, f2, f3, f4, f5 from c, (select distinct source_group as s from c where label = 1) b where role = 'development' and (label = 0 or source_group = b.s)", {'all': mask_of(COLUMNS)})}
  select fit.s as trained_on, source_group, round(avg(({score_sql()} >= 0.5)::int), 6) as sensitivity from c, fit where role = 'locked' and label = 1 group by 1, 2""")
def mdl_18_cross_domain(spark: SparkSession, d: str) -> DataFrame:
    """Trained on one generated source, tested on each."""
    c = cohort(spark, d)
    ai = [r[0] for r in c.where("label = 1").select("source_group").distinct().orderBy("source_group").collect()]
    out = None
    for s in ai:
        train = m.hierarchical_weights(c.where((F.col("role") == "development") & ((F.col("label") == 0) | (F.col("source_group") == s))))
        x = models.score_models(c.where("role = 'locked' and label = 1"), models.fit_combinations(train, FAM, "weight", ["S+D+R"]), ["source_group"]).withColumn("trained_on", F.lit(s))
        out = x if out is None else out.unionAll(x)
    return out.groupBy("trained_on", "source_group").agg(six(F.avg(F.col("predicted").cast("double")), "sensitivity"))


@R(f"""with recursive {C}, f as (select *, {FOLD} as fold from c), {fits_sql("select b.s, label, source_group, group_id, f1, f2, f3, f4, f5 from f, (select unnest([1, 3, 5]) as s) b where role = 'development' and fold < b.s", {k: BY_COMBINATION[k] for k in ('S', 'S+D+R')})}
  select fit.s as buckets, model as combination, round(avg((({score_sql()} >= 0.5) = (label = 1))::int), 6) as accuracy from c, fit where role = 'locked' group by 1, 2""")
def mdl_19_quantity_grid(spark: SparkSession, d: str) -> DataFrame:
    """Training on growing shares of the groups (by hash), accuracy on locked rows."""
    c = cohort(spark, d)
    dev = with_fold(c.where("role = 'development'"))
    out = None
    for amount in (1, 3, 5):
        train = m.hierarchical_weights(dev.where(F.col("fold") < amount))
        x = models.score_models(c.where("role = 'locked'"), models.fit_combinations(train, FAM, "weight", ["S", "S+D+R"]), ["label"]).withColumn("buckets", F.lit(amount))
        out = x if out is None else out.unionAll(x)
    return out.groupBy("buckets", "combination").agg(six(F.avg((F.col("predicted") == (F.col("label") == 1)).cast("double")), "accuracy"))


@R(f"with {C}, {FIXED_TERMS}, x as (select s.*, s.raw + case when id % 1000 = 0 then 0.01 else 0 end as again from s) select source_group, round(max(abs(raw - again)), 6) as largest, count(*) filter ((round(raw, 9) >= 0.5) <> (round(again, 9) >= 0.5)) as changed from x group by 1")
def mdl_20_refit_comparison(spark: SparkSession, d: str) -> DataFrame:
    raw = models.raw_score(FIXED)
    x = cohort(spark, d).select("source_group", raw.alias("a"), (raw + F.when(F.col("id") % 1000 == 0, 0.01).otherwise(0.0)).alias("z"))
    return x.groupBy("source_group").agg(six(F.max(F.abs(F.col("a") - F.col("z"))), "largest"), F.count_if((F.round("a", 9) >= 0.5) != (F.round("z", 9) >= 0.5)).alias("changed"))


@R("""with a as (select id, load_id, unnest(map_keys(features)) k, unnest(map_values(features)) v from sample_reference_features), m as (select id, k, min(v) filter (isfinite(v)) lo, max(v) filter (isfinite(v)) hi, count(*) n from a group by 1, 2 having count(*) > 1)
  select k as name, count(*) as pairs, count(*) filter ((lo is null and hi is null) or abs(hi - lo) <= 1e-9 + 1e-6 * abs(lo)) as close from m group by 1""")
def mdl_21_feature_replay(spark: SparkSession, d: str) -> DataFrame:
    """Values of recordings measured more than once: equal within tolerance or both missing."""
    a = table(spark, d, "sample_reference_features").select("id", F.explode("features").alias("k", "v"))
    v = F.when(~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))), F.col("v"))
    x = a.groupBy("id", "k").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 1")
    close = F.coalesce(F.abs(F.col("hi") - F.col("lo")) <= 1e-9 + 1e-6 * F.abs("lo"), F.col("lo").isNull())
    return x.groupBy(F.col("k").alias("name")).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(close).alias("close"))


@R(f"with {C}, {FIXED_TERMS}, f as (select id, case when name = 'f5' then 'R' else 'S' end as family, sum(v) filter (kind = 'value') as value_sum, coalesce(sum(v) filter (kind = 'missing'), 0) as missing_sum, arg_max(name, round(abs(v), 9)) filter (kind = 'value') as x from t group by 1, 2) select id, family, round(value_sum, 6) + 0.0 as value_sum, round(missing_sum, 6) + 0.0 as missing_sum, case when round(value_sum + missing_sum, 6) > 0 then 'generated' when round(value_sum + missing_sum, 6) < 0 then 'human' else 'neutral' end as direction from f")
def mdl_22_family_explanation(spark: SparkSession, d: str) -> DataFrame:
    t = models.terms(FIXED)
    fam = {"f1": "S", "f2": "S", "f5": "R"}
    pick = lambda f, kind: sum((c for n, k, c in t if fam[n] == f and k == kind and not (n == "f1" and k == "missing")), F.lit(0.0))
    x = cohort(spark, d).select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("family"), pick(f, "value").alias("v"), pick(f, "missing").alias("m")) for f in ("S", "R")])).alias("e")).select("id", "e.*")
    total = F.round(F.col("v") + F.col("m"), 6)
    return x.select("id", "family", (F.round("v", 6) + 0.0).alias("value_sum"), (F.round("m", 6) + 0.0).alias("missing_sum"), F.when(total > 0, "generated").when(total < 0, "human").otherwise("neutral").alias("direction"))


REPLICATES = 1000
#: Rows of both arms, groups and their draws, and sums per replicate and a key, for DuckDB.
ARMS = f"{C}, {FIXED_TERMS}, arms as (select s.source_group, s.label, s.group_id, ((round(s.raw, 9) >= 0.5) = (s.label = 1))::int as added, ((c.score >= 0.5) = (c.label = 1))::int as base from s join c using (id))"
SUMS = ARMS + ", g as (select distinct group_id as key from arms), " + b.draws_sql(REPLICATES) + ", gs as (select group_id, {0}, count(*) n, sum(base) base, sum(added) added from arms group by all), reps as (select {0}, rep, (sum(added * k) - sum(base * k))::double / sum(n * k) as delta from gs join draws on draws.key = gs.group_id where k > 0 group by all)"


def _arms(spark: SparkSession, d: str) -> DataFrame:
    """Correctness of two arms per row: the score and the score of the fixed model."""
    c = cohort(spark, d)
    right = lambda s: (s >= 0.5) == (F.col("label") == 1)
    return c.select("source_group", "label", "group_id", F.lit(1).alias("n"), right(F.col("score")).cast("int").alias("base"), right(F.round(models.raw_score(FIXED), 9)).cast("int").alias("added"))


def _replicates(spark: SparkSession, d: str, by: list[str]) -> DataFrame:
    a = _arms(spark, d)
    draws = b.multiplicities(a, "group_id", REPLICATES)
    return b.replicate_sums(a, draws, "group_id", by, {"n": "n", "base": "base", "added": "added"}).withColumn("delta", ratio(F.col("added") - F.col("base"), F.col("n")))


@R(f"with {SUMS.format('source_group')} select source_group, {b.INTERVAL_SQL.format('delta')} from reps group by 1")
def bst_01_paired_group_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return b.interval(_replicates(spark, d, ["source_group"]), ["source_group"], "delta")


@R(f"with {SUMS.format('label')} select label, {b.INTERVAL_SQL.format('delta')} from reps group by 1")
def bst_02_intervals(spark: SparkSession, d: str) -> DataFrame:
    return b.interval(_replicates(spark, d, ["label"]), ["label"], "delta")


@R(f"with {C}, {FIXED_TERMS}, x as (select s.source_group, avg(case when (round(s.raw, 9) >= 0.5) = (s.label = 1) then 1.0 else 0 end) - avg(case when (c.score >= 0.5) = (c.label = 1) then 1.0 else 0 end) as delta from s join c using (id) group by 1) select source_group, round(delta, 6) as delta, true as agrees from x")
def bst_03_point_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The point estimate by rows and through groups with a multiplicity of one must agree."""
    a = _arms(spark, d)
    one = a.select("group_id").distinct().withColumn("draws", F.array(F.lit(1)))
    g = b.replicate_sums(a, one, "group_id", ["source_group"], {"n": "n", "base": "base", "added": "added"}).select("source_group", ratio(F.col("added") - F.col("base"), F.col("n")).alias("g"))
    r = a.groupBy("source_group").agg((F.avg("added") - F.avg("base")).alias("r"))
    return r.join(g, "source_group").select("source_group", six("r", "delta"), (F.abs(F.col("r") - F.col("g")) <= 1e-12).alias("agrees"))


@R(f"""with {ARMS}, a as (select label, source_group, avg(added - base) as delta from arms group by 1, 2), g as (select distinct source_group as key from a), {b.draws_sql(REPLICATES)}, x as (select label, rep, sum(k * delta) / nullif(sum(k), 0)::double as m from a join draws on draws.key = a.source_group group by 1, 2),
  y as (select rep, case when count(m) = 2 then avg(m) end as delta from x group by 1) select {b.INTERVAL_SQL.format('delta')} from y""")
def bst_04_crossed_sources(spark: SparkSession, d: str) -> DataFrame:
    """Human and generated sources drawn separately; a replicate's pairs weigh as the product, so its mean is the product of sums."""
    a = _arms(spark, d).groupBy("label", "source_group").agg(F.avg(F.col("added") - F.col("base")).alias("delta"))
    draws = b.multiplicities(a, "source_group", REPLICATES)
    x = a.join(draws, "source_group").select("label", "delta", F.posexplode_outer("draws").alias("rep", "k")).groupBy("label", "rep").agg(F.try_divide(F.sum(F.col("k") * F.col("delta")), F.sum("k").cast("double")).alias("m"))
    return b.interval(x.groupBy("rep").agg(F.when(F.count("m") == 2, F.avg("m")).alias("delta")), [], "delta")


@R(f"""with {SUMS.format('source_group, label')}, y as (select h.source_group as human_source, a.source_group as ai_source, (h.delta + a.delta) / 2 as delta from reps h join reps a using (rep) where h.label = 0 and a.label = 1) select human_source, ai_source, {b.INTERVAL_SQL.format('delta')} from y group by 1, 2""")
def bst_05_pair_group_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Per pair of sources; a group in both classes is drawn once for both."""
    x = _replicates(spark, d, ["source_group", "label"])
    h = x.where("label = 0").select(F.col("source_group").alias("human_source"), "rep", F.col("delta").alias("dh"))
    a = x.where("label = 1").select(F.col("source_group").alias("ai_source"), "rep", F.col("delta").alias("da"))
    return b.interval(h.join(a, "rep").withColumn("delta", (F.col("dh") + F.col("da")) / 2), ["human_source", "ai_source"], "delta")


@R(f"""with {C}, r as (select id::varchar as key, label, ((score >= 0.5) = (label = 1))::int as hit from c where role = 'locked'), g as (select key from r), {b.draws_sql(REPLICATES)}, x as (select label, rep, sum(hit * k)::double / sum(k) as v from r join draws using (key) where k > 0 group by 1, 2), y as (select rep, avg(v) as ba from x group by 1) select {b.INTERVAL_SQL.format('ba')} from y""")
def bst_06_stratified_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows drawn within classes: each row is its own group."""
    c = cohort(spark, d).where("role = 'locked'").select("id", "label", F.lit(1).alias("n"), ((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("int").alias("hit"))
    x = b.drawn_sums(c, "id", ["label"], {"n": "n", "hit": "hit"}, REPLICATES).groupBy("rep").agg(F.avg(ratio(F.col("hit"), F.col("n"))).alias("ba"))
    return b.interval(x, [], "ba")


@R()
def bst_07_cluster_statistics(spark: SparkSession, d: str) -> DataFrame:
    return b.cluster_statistics(cohort(spark, d), "source_group", "group_id", "f5", REPLICATES, 20260907)


@R(f"with {SUMS.format('source_group')}, y as (select rep, avg(delta) as macro from reps group by 1) select {b.INTERVAL_SQL.format('macro')} from y")
def bst_08_held_source_macro(spark: SparkSession, d: str) -> DataFrame:
    """Macro over sources, each with draws given by its own identity."""
    x = _replicates(spark, d, ["source_group"]).groupBy("rep").agg(F.avg("delta").alias("macro"))
    return b.interval(x, [], "macro")


@R(f"with {C}, {FIXED_TERMS}, x as (select s.group_id, avg(case when (round(s.raw, 9) >= 0.5) = (s.label = 1) then 1.0 else 0 end) - avg(case when (c.score >= 0.5) = (c.label = 1) then 1.0 else 0 end) as delta from s join c using (id) group by 1) select count(*) as groups, count(*) filter (round(delta, 9) > 0) as positive, count(*) filter (round(delta, 9) < 0) as negative, round(avg(delta), 6) as mean, round(median(delta), 6) as median from x")
def bst_09_paired_change(spark: SparkSession, d: str) -> DataFrame:
    x = _arms(spark, d).groupBy("group_id").agg((F.avg("added") - F.avg("base")).alias("delta"))
    return x.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.round("delta", 9) > 0).alias("positive"), F.count_if(F.round("delta", 9) < 0).alias("negative"), six(F.avg("delta"), "mean"), six(F.median("delta"), "median"))


