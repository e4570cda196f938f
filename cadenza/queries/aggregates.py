"""Queries of weights, metrics and other aggregates (AGG)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.hashing import SET_DIGEST, set_digest
from cadenza.operators import metrics as m
from cadenza.operators.metrics import ratio, six
from cadenza.queries._cohort import C, cohort
from cadenza.registry import Registry
from cadenza.session import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
RATES = "tp::double / nullif(tp + fn, 0) as sensitivity, tn::double / nullif(tn + fp, 0) as specificity"
COUNTS = "count(*) filter (label = 1 and score >= 0.5) as tp, count(*) filter (label = 1 and score < 0.5) as fn, count(*) filter (label = 0 and score >= 0.5) as fp, count(*) filter (label = 0 and score < 0.5) as tn"
WEIGHTS = """w as (select c.*, (select count(*) from c)::double / ((select count(distinct label) from c) * s.ns * g.ng * r.nr) as weight from c
  join (select label, count(distinct source_group) ns from c group by 1) s using (label)
  join (select label, source_group, count(distinct group_id) ng from c group by 1, 2) g using (label, source_group)
  join (select label, source_group, group_id, count(*) nr from c group by 1, 2, 3) r using (label, source_group, group_id))"""
#: Brute-force area under the curve over the rows of x, by average ranks.
AUC = "(sum(rk) filter (label = 1) - count(*) filter (label = 1) * (count(*) filter (label = 1) + 1) / 2.0) / nullif(count(*) filter (label = 1) * count(*) filter (label = 0), 0)"


@R(f"with {C}, {WEIGHTS} select id, round(weight, 6) as weight from w")
def agg_01_hierarchical_weights(spark: SparkSession, d: str) -> DataFrame:
    return m.hierarchical_weights(cohort(spark, d)).select("id", six("weight", "weight"))


@R(f"""with {C}, n as (select label, count(distinct source_group) ns from c group by 1), r as (select label, source_group, count(*) nr from c group by 1, 2)
  select id, round((select count(*) from c)::double / ((select count(distinct label) from c) * ns * nr), 6) as weight from c join n using (label) join r using (label, source_group)""")
def agg_02_two_level_weights(spark: SparkSession, d: str) -> DataFrame:
    return m.hierarchical_weights(cohort(spark, d), ["label", "source_group"]).select("id", six("weight", "weight"))


@R(f"""with {C}, s as (select label, role, count(distinct source_group) ns from c group by 1, 2), g as (select label, role, source_group, count(distinct group_id) ng from c group by 1, 2, 3)
  select label, role, source_group, round(1.0 / ns, 6) as source_weight, round(1.0 / (ns * ng), 6) as group_weight from g join s using (label, role)""")
def agg_03_source_and_group_weights(spark: SparkSession, d: str) -> DataFrame:
    g = cohort(spark, d).groupBy("label", "role", "source_group").agg(F.count_distinct("group_id").alias("ng"))
    s = g.groupBy("label", "role").agg(F.count(F.lit(1)).alias("ns"))
    return g.join(s, ["label", "role"]).select("label", "role", "source_group", six(F.lit(1.0) / F.col("ns"), "source_weight"), six(F.lit(1.0) / (F.col("ns") * F.col("ng")), "group_weight"))


@R(f"with {C}, t as (select role, {COUNTS} from c group by 1), u as (select *, {RATES} from t) select role, tp, fn, fp, tn, round(sensitivity, 6) as sensitivity, round(specificity, 6) as specificity, round((sensitivity + specificity) / 2, 6) as balanced_accuracy from u")
def agg_04_confusion(spark: SparkSession, d: str) -> DataFrame:
    return m.confusion(cohort(spark, d), ["role"]).select("role", "tp", "fn", "fp", "tn", *[six(c, c) for c in ("sensitivity", "specificity", "balanced_accuracy")])


@R(f"with {C}, x as (select role, label, rank() over (partition by role order by score) + (count(*) over (partition by role, score) - 1) / 2.0 as rk from c) select role, round({AUC}, 6) as auc from x group by role")
def agg_05_auc(spark: SparkSession, d: str) -> DataFrame:
    return m.auc(cohort(spark, d), ["role"]).select("role", six("auc", "auc"))


@R(f"""with {C}, {WEIGHTS}, s as (select role, score, sum(case when label = 1 then weight else 0 end) p, sum(case when label = 0 then weight else 0 end) n from w group by 1, 2)
  select a.role, round(sum(a.p * b.n * case when a.score > b.score then 1 when a.score = b.score then 0.5 else 0 end) / (sum(a.p * b.n)), 6) as auc from s a join s b using (role) group by 1""")
def agg_06_weighted_auc(spark: SparkSession, d: str) -> DataFrame:
    return m.auc(m.hierarchical_weights(cohort(spark, d)), ["role"], F.col("weight")).select("role", six("auc", "auc"))


@R(f"""with {C}, {WEIGHTS}, p as (select role, sum(weight * (score - label) * (score - label)) / sum(weight) as brier,
    sum(weight * -(label * ln(greatest(least(score, 1 - 1e-15), 1e-15)) + (1 - label) * ln(1 - greatest(least(score, 1 - 1e-15), 1e-15)))) / sum(weight) as log_loss from w group by 1),
  b as (select role, least(floor(score * 10), 9) as bin, sum(weight) as mass, sum(weight * score) / sum(weight) as conf, sum(weight * label) / sum(weight) as pos from w group by 1, 2)
  select role, round(brier, 6) as brier, round(log_loss, 6) as log_loss, round(ece, 6) as ece from p join (select role, sum(mass * abs(conf - pos)) / sum(mass) as ece from b group by 1) using (role)""")
def agg_07_probability_metrics(spark: SparkSession, d: str) -> DataFrame:
    w = m.hierarchical_weights(cohort(spark, d))
    ece = m.expected_calibration_error(m.calibration_bins(w, ["role"], F.col("weight")), ["role"])
    return m.probability_metrics(w, ["role"], F.col("weight")).join(ece, "role").select("role", six("brier", "brier"), six("log_loss", "log_loss"), six("ece", "ece"))


@R(f"""with {C}, {WEIGHTS}, t as (select source_group, sum(weight) filter (label = 1 and score >= 0.5) / sum(weight) filter (label = 1) as sens, coalesce(sum(weight) filter (label = 0 and score < 0.5), 0) / sum(weight) filter (label = 0) as spec from w group by 1)
  select source_group, round(sens, 6) as sensitivity, round(spec, 6) as specificity from t""")
def agg_08_weighted_rates(spark: SparkSession, d: str) -> DataFrame:
    w = m.hierarchical_weights(cohort(spark, d))
    part = lambda y, hit: F.sum(F.when((F.col("label") == y) & hit, F.col("weight")))
    yes = F.lit(True)
    return w.groupBy("source_group").agg(six(F.try_divide(part(1, F.col("score") >= 0.5), part(1, yes)), "sensitivity"), six(F.try_divide(F.coalesce(part(0, F.col("score") < 0.5), F.when(part(0, yes) > 0, 0.0)), part(0, yes)), "specificity"))


PAIRS = """h as (select distinct source_group as human_source from c where label = 0), a as (select distinct source_group as ai_source from c where label = 1),
  x as (select {by} human_source, ai_source, label, score, group_id, rank() over (partition by {by} human_source, ai_source order by score) + (count(*) over (partition by {by} human_source, ai_source, score) - 1) / 2.0 as rk
    from c join (select * from h, a) p on c.source_group in (p.human_source, p.ai_source)),
  y as (select {by} human_source, ai_source, count(*) filter (label = 0) as human_rows, count(*) filter (label = 1) as ai_rows, count(*) filter (label = 1 and score >= 0.5)::double / count(*) filter (label = 1) as sens,
    count(*) filter (label = 0 and score < 0.5)::double / count(*) filter (label = 0) as spec, {auc} as auc, least(count(distinct case when label = 0 then group_id end), count(distinct case when label = 1 then group_id end)) as groups from x group by {group})"""


@R(f"with {C}, {PAIRS.format(by='', auc=AUC, group='human_source, ai_source')} select human_source, ai_source, human_rows, ai_rows, round(sens, 6) as sensitivity, round(spec, 6) as specificity, round((sens + spec) / 2, 6) as balanced_accuracy, round(auc, 6) as auc from y")
def agg_09_source_pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    return m.source_pairs(cohort(spark, d)).select("human_source", "ai_source", "human_rows", "ai_rows", *[six(c, c) for c in ("sensitivity", "specificity", "balanced_accuracy", "auc")])


@R(f"with {C}, {PAIRS.format(by='role, ', auc=AUC, group='role, human_source, ai_source')} select role, human_source, ai_source, round(auc, 6) as auc from y where groups >= 10")
def agg_10_pair_metrics_min_groups(spark: SparkSession, d: str) -> DataFrame:
    return m.source_pairs(cohort(spark, d), ["role"], 10).select("role", "human_source", "ai_source", six("auc", "auc"))


@R(f"""with {C}, g as (select label, source_group, group_id, avg(case when (score >= 0.5) = (label = 1) then 1.0 else 0 end) r, count(*) n, sum(case when (score >= 0.5) = (label = 1) then 1 else 0 end) k from c group by 1, 2, 3),
  e as (select source_group, count(distinct component_id) components from c group by 1)
  select label, source_group, round(sum(k)::double / sum(n), 6) as recording_rate, round(avg(r), 6) as group_rate, components from g join e using (source_group) group by label, source_group, components""")
def agg_11_source_endpoints(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).withColumn("right", ((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("int"))
    g = c.groupBy("label", "source_group", "group_id").agg(F.avg("right").alias("r"), F.count(F.lit(1)).alias("n"), F.sum("right").alias("k"))
    e = c.groupBy("source_group").agg(F.count_distinct("component_id").alias("components"))
    return g.groupBy("label", "source_group").agg(six(ratio(F.sum("k"), F.sum("n")), "recording_rate"), six(F.avg("r"), "group_rate")).join(e, "source_group")


@R(f"""with {C}, g as (select role, label, source_group, group_id, avg(case when (score >= 0.5) = (label = 1) then 1.0 else 0 end) r from c group by 1, 2, 3, 4), s as (select role, label, source_group, avg(r) r from g group by 1, 2, 3), l as (select role, label, avg(r) r from s group by 1, 2)
  select role, round(avg(r), 6) as macro_balanced_accuracy from l group by 1""")
def agg_12_three_level_macro(spark: SparkSession, d: str) -> DataFrame:
    right = ((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("double")
    return m.nested_mean(cohort(spark, d), right, [["role", "label", "source_group", "group_id"], ["role", "label", "source_group"], ["role", "label"], ["role"]], "r").select("role", six("r", "macro_balanced_accuracy"))


FOLD = "(('0x' || substr(sha256('20260907|' || group_id), 1, 16))::ubigint % 5)::int"


def with_fold(c: DataFrame) -> DataFrame:
    from cadenza.functions.hashing import hash_fold

    return c.withColumn("fold", hash_fold(F.col("group_id")))


@R(f"""with {C}, f as (select *, {FOLD} as fold from c), a as (select fold, source_group, avg(score) s, count(*) n from f group by 1, 2)
  select source_group, round(avg(s), 6) as mean_of_folds, sum(n)::bigint as rows, count(distinct fold) as folds from a group by 1""")
def agg_13_fold_means(spark: SparkSession, d: str) -> DataFrame:
    a = with_fold(cohort(spark, d)).groupBy("fold", "source_group").agg(F.avg("score").alias("s"), F.count(F.lit(1)).alias("n"))
    return a.groupBy("source_group").agg(six(F.avg("s"), "mean_of_folds"), F.sum("n").alias("rows"), F.count_distinct("fold").alias("folds"))


@R(f"""with {C}, f as (select *, {FOLD} as fold from c), a as (select source_group, fold, avg(f2) filter (k % 2 = 0 and fold <> 3) v from f group by 1, 2)
  select source_group, round(avg(v), 6) as macro, count(v) as defined, count(*) as cells from a group by 1""")
def agg_14_macro_with_undefined(spark: SparkSession, d: str) -> DataFrame:
    a = with_fold(cohort(spark, d)).groupBy("source_group", "fold").agg(F.avg(F.when((F.col("k") % 2 == 0) & (F.col("fold") != 3), F.col("f2"))).alias("v"))
    return a.groupBy("source_group").agg(six(F.avg("v"), "macro"), F.count("v").alias("defined"), F.count(F.lit(1)).alias("cells"))


@R(f"""with {C}, f as (select *, {FOLD} as fold from c), a as (select role, source_group, fold, count(*) n from f group by 1, 2, 3)
  select role, source_group, count(*) as cells, sum(n)::bigint as rows, sha256(string_agg(fold::varchar || ':' || n::varchar, ',' order by fold)) as coverage_key from a group by 1, 2""")
def agg_15_report_summary(spark: SparkSession, d: str) -> DataFrame:
    a = with_fold(cohort(spark, d)).groupBy("role", "source_group", "fold").agg(F.count(F.lit(1)).alias("n"))
    cells = F.array_sort(F.collect_list(F.struct("fold", "n")))
    key = F.sha2(F.array_join(F.transform(cells, lambda x: F.concat_ws(":", x["fold"].cast("string"), x["n"].cast("string"))), ","), 256)
    return a.groupBy("role", "source_group").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows"), key.alias("coverage_key"))


@R(f"""with {C} select source_group, case when grouping(role) = 1 then 'all_eligible' else role end as role, count(*) as rows, sum(case when score >= 0.5 then 1 else 0 end)::bigint as predicted from c group by grouping sets ((source_group), (source_group, role))""")
def agg_16_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    g = cohort(spark, d).groupingSets([["source_group"], ["source_group", "role"]], "source_group", "role")
    return g.agg(F.grouping("role").alias("g"), F.count(F.lit(1)).alias("rows"), F.sum((F.col("score") >= 0.5).cast("int")).alias("predicted")).select("source_group", F.when(F.col("g") == 1, "all_eligible").otherwise(F.col("role")).alias("role"), "rows", "predicted")


@R(f"""with {C}, f as (select source_group, {FOLD} as fold, avg(case when score >= 0.5 then 1.0 else 0 end) s from c where label = 1 group by 1, 2)
  select source_group, round(avg(s), 6) as mean, round(min(s), 6) as lowest, round(max(s), 6) as highest from f group by 1 having count(*) = 5""")
def agg_17_five_fold_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    f = with_fold(cohort(spark, d).where("label = 1")).groupBy("source_group", "fold").agg(F.avg((F.col("score") >= 0.5).cast("double")).alias("s"))
    return f.groupBy("source_group").agg(six(F.avg("s"), "mean"), six(F.min("s"), "lowest"), six(F.max("s"), "highest"), F.count(F.lit(1)).alias("n")).where("n = 5").drop("n")


@R(f"with {C} select source_group, round(avg(case when score >= 0.5 then 1.0 else 0 end), 6) as sensitivity, round(avg(case when score < 0.5 then 1.0 else 0 end), 6) as false_negative_rate, null::double as balanced_accuracy, null::double as auc from c where label = 1 group by 1")
def agg_18_positive_only(spark: SparkSession, d: str) -> DataFrame:
    hit = (F.col("score") >= 0.5).cast("double")
    return cohort(spark, d).where("label = 1").groupBy("source_group").agg(six(F.avg(hit), "sensitivity"), six(F.avg(1 - hit), "false_negative_rate")).withColumns({"balanced_accuracy": F.lit(None).cast("double"), "auc": F.lit(None).cast("double")})


@R(f"""with {C}, f as (select source_group, {FOLD} as fold, k % 3 as repeat, avg(score) s from c group by 1, 2, 3), g as (select source_group, repeat, avg(s) s from f group by 1, 2)
  select source_group, round(avg(s), 6) as mean, round(stddev_samp(s), 6) as sd, round(min(s), 6) as lowest, round(max(s), 6) as highest from g group by 1""")
def agg_19_fold_repeat_summary(spark: SparkSession, d: str) -> DataFrame:
    x = m.nested_mean(with_fold(cohort(spark, d)).withColumn("repeat", F.col("k") % 3), F.col("score"), [["source_group", "fold", "repeat"], ["source_group", "repeat"]], "s")
    return x.groupBy("source_group").agg(six(F.avg("s"), "mean"), six(F.stddev_samp("s"), "sd"), six(F.min("s"), "lowest"), six(F.max("s"), "highest"))


@R(f"""with {C}, l as (select source_group, 'base' as family, [f1, f2] as v from c union all select source_group, 'extra', [f3, f5] from c)
  select source_group, family, round(avg(case when len(list_filter(v, lambda x: x is not null)) > 0 then 1.0 else 0 end), 6) as any_observed, round(avg(case when len(list_filter(v, lambda x: x is not null)) = 2 then 1.0 else 0 end), 6) as complete from l group by 1, 2""")
def agg_20_family_coverage(spark: SparkSession, d: str) -> DataFrame:
    fam = F.explode(F.array(*[F.struct(F.lit(n).alias("family"), F.array(*v).alias("v")) for n, v in (("base", ("f1", "f2")), ("extra", ("f3", "f5")))])).alias("f")
    x = cohort(spark, d).select("source_group", fam).select("source_group", "f.family", "f.v")
    return x.groupBy("source_group", "family").agg(six(F.avg(F.exists("v", lambda e: e.isNotNull()).cast("double")), "any_observed"), six(F.avg(F.forall("v", lambda e: e.isNotNull()).cast("double")), "complete"))


STATUS = "case when f2 is not null then 'ok' when k % 2 = 0 then 'unavailable' else 'failed' end"


@R(f"""with {C}, s as (select source_group, {STATUS} as status, count(*) n from c group by 1, 2)
  select source_group, round(coalesce(sum(n) filter (status = 'unavailable'), 0)::double / sum(n), 6) as unobservable, round(coalesce(sum(n) filter (status = 'failed'), 0)::double / sum(n), 6) as failed, string_agg(status || ':' || n::varchar, '|' order by status) as histogram from s group by 1""")
def agg_21_availability_and_failure(spark: SparkSession, d: str) -> DataFrame:
    s = cohort(spark, d).groupBy("source_group", F.expr(STATUS).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    part = lambda x: F.coalesce(F.sum(F.when(F.col("status") == x, F.col("n"))), F.lit(0))
    hist = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "status", F.col("n").cast("string")))), "|")
    return s.groupBy("source_group").agg(six(ratio(part("unavailable"), F.sum("n")), "unobservable"), six(ratio(part("failed"), F.sum("n")), "failed"), hist.alias("histogram"))


@R(f"with {C} select a.attribute, a.value, count(*) as n from c, lateral (select unnest(['source_group', 'role', 'label']) as attribute, unnest([source_group, role, label::varchar]) as value) a group by 1, 2")
def agg_22_frequency_tables(spark: SparkSession, d: str) -> DataFrame:
    x = cohort(spark, d).select(F.explode(F.create_map(*[e for c in ("source_group", "role", "label") for e in (F.lit(c), F.col(c).cast("string"))])).alias("attribute", "value"))
    return x.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))


@R(f"""with {C} select role, count(*) as rows, count(distinct group_id) as groups, count(distinct component_id) as components, count(*) filter (label = 0) as humans, count(*) filter (label = 1) as generated,
  {SET_DIGEST.format("lpad(id::varchar, 12, '0')")} as id_hash from c group by role""")
def agg_23_population_digest(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).withColumn("pid", F.lpad(F.col("id").cast("string"), 12, "0"))
    n = c.groupBy("role").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("group_id").alias("groups"), F.count_distinct("component_id").alias("components"), F.count(F.when(F.col("label") == 0, 1)).alias("humans"), F.count(F.when(F.col("label") == 1, 1)).alias("generated"))
    return n.join(set_digest(c, ["role"], "pid", "id_hash", "ids").drop("ids"), "role")


@R(f"""with {C}, g as (select group_id, count(*) n, count(distinct source_group) s, count(distinct label) l from c group by 1) select count(*) as groups, count(*) filter (n > 1) as shared, count(*) filter (s > 1) as cross_source, count(*) filter (l > 1) as cross_label from g""")
def agg_24_shared_groups(spark: SparkSession, d: str) -> DataFrame:
    g = cohort(spark, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_group").alias("s"), F.count_distinct("label").alias("l"))
    return g.agg(F.count(F.lit(1)).alias("groups"), *[F.count(F.when(F.col(c) > 1, 1)).alias(n) for c, n in (("n", "shared"), ("s", "cross_source"), ("l", "cross_label"))])


@R(f"""with {C}, g as (select source_group, group_id, avg(f5) v, count(f5) n, count(*) m from c group by 1, 2) select source_group, round(avg(v), 6) as equal_group_mean, count(v) as groups, sum(n)::bigint as observed, round(sum(n)::double / sum(m), 6) as coverage from g group by 1""")
def agg_25_equal_group_mean(spark: SparkSession, d: str) -> DataFrame:
    g = cohort(spark, d).groupBy("source_group", "group_id").agg(F.avg("f5").alias("v"), F.count("f5").alias("n"), F.count(F.lit(1)).alias("m"))
    return g.groupBy("source_group").agg(six(F.avg("v"), "equal_group_mean"), F.count("v").alias("groups"), F.sum("n").alias("observed"), six(ratio(F.sum("n"), F.sum("m")), "coverage"))


@R(f"""with {C} select source_group, count(*) as rows, count(f5 - f1) as known, round(avg(f5 - f1), 6) as mean_delta, round(median(abs(f5 - f1)), 6) as median_abs, round(quantile_cont(abs(f5 - f1), 0.95), 6) as p95_abs, count(*) filter (f5 is null) as null_second from c group by 1""")
def agg_26_delta_summary(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("f5") - F.col("f1")
    return cohort(spark, d).groupBy("source_group").agg(F.count(F.lit(1)).alias("rows"), F.count(e).alias("known"), six(F.avg(e), "mean_delta"), six(F.median(F.abs(e)), "median_abs"), six(F.percentile(F.abs(e), F.lit(0.95)), "p95_abs"), F.count(F.when(F.col("f5").isNull(), 1)).alias("null_second"))


@R(f"with {C} select source_group, count(*) filter (f2 is not null and f5 is not null) as both, count(*) filter (f2 is not null and f5 is null) as lost, count(*) filter (f2 is null and f5 is not null) as gained, count(*) filter (f2 is null and f5 is null) as neither from c group by 1")
def agg_27_mask_transitions(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("f2").isNotNull(), F.col("f5").isNotNull()
    return cohort(spark, d).groupBy("source_group").agg(*[F.count_if(x).alias(n) for n, x in (("both", a & b), ("lost", a & ~b), ("gained", ~a & b), ("neither", ~a & ~b))])


@R(f"with {C} select source_group, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as sd, round(quantile_cont(score, 0.05), 6) as q05, round(median(score), 6) as q50, round(quantile_cont(score, 0.95), 6) as q95 from c group by 1")
def agg_28_score_summary(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).groupBy("source_group").agg(six(F.avg("score"), "mean"), six(F.stddev_pop("score"), "sd"), *[six(F.percentile("score", F.lit(q)), n) for q, n in ((0.05, "q05"), (0.5, "q50"), (0.95, "q95"))])


@R(f"""with {C} select source_group, count(*) as n, round(avg(f5 - f1), 6) as bias, round(avg(abs(f5 - f1)), 6) as mae, round(median(abs(f5 - f1)), 6) as median_ae, round(quantile_cont(abs(f5 - f1), 0.9), 6) as p90_ae, round(sqrt(avg((f5 - f1) * (f5 - f1))), 6) as rmse, round(corr(f1, f5), 6) as pearson from c where f5 is not null group by 1""")
def agg_29_error_summary(spark: SparkSession, d: str) -> DataFrame:
    return m.error_summary(cohort(spark, d), ["source_group"], "f1", "f5").select("source_group", "n", *[six(c, c) for c in ("bias", "mae", "median_ae", "p90_ae", "rmse", "pearson")])


@R(f"""with {C}, t as (select source_group, count(*) filter (f2 is not null and f5 is not null)::double tp, count(*) filter (f2 is null and f5 is not null) fp, count(*) filter (f2 is not null and f5 is null) fn from c group by 1)
  select source_group, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from t""")
def agg_30_observability(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("f2").isNotNull(), F.col("f5").isNotNull()
    t = cohort(spark, d).groupBy("source_group").agg(F.count_if(a & b).alias("tp"), F.count_if(~a & b).alias("fp"), F.count_if(a & ~b).alias("fn"))
    return t.select("source_group", *event_scores())


def event_scores() -> list:
    """Precision, recall and F1 from tp, fp, fn; null where nothing is there to divide by."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return [six(ratio(tp, tp + fp), "precision"), six(ratio(tp, tp + fn), "recall"), six(ratio(2 * tp, 2 * tp + fp + fn), "f1")]


PITCH = "t as (select source_group, 100 + value as ref, (100 + value) * case when k % 5 = 0 then 2 else 1 + (k % 9 - 4) / 100.0::double end as est, k % 4 <> 0 as voiced, k % 6 <> 0 as est_voiced from c), e as (select *, 1200 * log2(est / ref) as cents from t), f as (select *, abs(cents) as err, abs(((cents + 600) - 1200 * floor((cents + 600) / 1200)) - 600) as chroma from e)"


@R(f"""with {C}, {PITCH} select source_group, round(count(*) filter (voiced and est_voiced and err <= 50)::double / count(*) filter (voiced), 6) as raw_pitch_accuracy, round(count(*) filter (voiced and est_voiced and chroma <= 50)::double / count(*) filter (voiced), 6) as raw_chroma_accuracy,
  round(count(*) filter (voiced and est_voiced)::double / count(*) filter (est_voiced), 6) as voicing_precision, round(count(*) filter (voiced and est_voiced)::double / count(*) filter (voiced), 6) as voicing_recall, round(median(err) filter (voiced and est_voiced), 6) as median_cents from f group by 1""")
def agg_31_pitch_metrics(spark: SparkSession, d: str) -> DataFrame:
    from cadenza.functions.scalar import cents_between, fold_octave

    ref = 100 + F.col("value")
    est = ref * F.when(F.col("k") % 5 == 0, F.lit(2.0)).otherwise(1 + (F.col("k") % 9 - 4) / F.lit(100.0))
    c = cents_between(ref, est)
    f = cohort(spark, d).select("source_group", F.abs(c).alias("err"), fold_octave(c).alias("chroma"), (F.col("k") % 4 != 0).alias("voiced"), (F.col("k") % 6 != 0).alias("est_voiced"))
    v, e = F.col("voiced"), F.col("est_voiced")
    n = F.count_if
    return f.groupBy("source_group").agg(six(ratio(n(v & e & (F.col("err") <= 50)), n(v)), "raw_pitch_accuracy"), six(ratio(n(v & e & (F.col("chroma") <= 50)), n(v)), "raw_chroma_accuracy"), six(ratio(n(v & e), n(e)), "voicing_precision"), six(ratio(n(v & e), n(v)), "voicing_recall"), six(F.median(F.when(v & e, F.col("err"))), "median_cents"))


@R(f"""with {C}, g as (select source_group, group_id, count(*) filter (label = 1 and score >= 0.5) tp, count(*) filter (label = 0 and score >= 0.5) fp, count(*) n from c group by 1, 2) select source_group, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(n)::bigint as n, round((sum(tp) + sum(fp))::double / sum(n), 6) as rate from g group by 1""")
def agg_32_partial_then_final(spark: SparkSession, d: str) -> DataFrame:
    g = m.confusion(cohort(spark, d), ["source_group", "group_id"]).withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return g.groupBy("source_group").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("n").alias("n")).withColumn("rate", F.round(ratio(F.col("tp") + F.col("fp"), F.col("n")), 6))


@R(f"""with {C}, t as (select source_group, count(*) filter (k < 30 and score >= 0.5)::double tp, count(*) filter (k >= 30 and score >= 0.5) fp, count(*) filter (k < 30 and score < 0.5) fn from c group by 1)
  select source_group, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from t""")
def agg_33_event_scores(spark: SparkSession, d: str) -> DataFrame:
    y, p = F.col("k") < 30, F.col("score") >= 0.5
    return cohort(spark, d).groupBy("source_group").agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn")).select("source_group", *event_scores())


EFFECT = """select {by} median(v) filter (label = 0) as median0, median(v) filter (label = 1) as median1, avg(v) filter (label = 1) - avg(v) filter (label = 0) as diff,
  (avg(v) filter (label = 1) - avg(v) filter (label = 0)) / sqrt(((count(v) filter (label = 0) - 1) * var_samp(v) filter (label = 0) + (count(v) filter (label = 1) - 1) * var_samp(v) filter (label = 1)) / (count(v) - 2)) as d, {auc} as auc from r group by {group}"""
LONG = "l as (select id, label, source_group, role, metric, v from (select id, label, source_group, role, unnest(['f1', 'f2', 'f3', 'f5']) as metric, unnest([f1, f2, f3, f5]) as v from c) where v is not null)"


def long_features(c: DataFrame) -> DataFrame:
    x = c.select("id", "label", "source_group", "role", F.explode(F.create_map(*[e for n in ("f1", "f2", "f3", "f5") for e in (F.lit(n), F.col(n))])).alias("metric", "v"))
    return x.where("v is not null")


@R(f"with {C}, {LONG}, r as (select *, rank() over (partition by metric order by v) + (count(*) over (partition by metric, v) - 1) / 2.0 as rk from l), e as ({EFFECT.format(by='metric,', auc=AUC, group='metric')}) select metric, round(median0, 6) as median0, round(median1, 6) as median1, round(diff, 6) as mean_difference, round(d, 6) as cohens_d, round(auc, 6) as auc from e")
def agg_34_effect_sizes(spark: SparkSession, d: str) -> DataFrame:
    return m.effect_sizes(long_features(cohort(spark, d)), ["metric"], "v").select("metric", *[six(c, c) for c in ("median0", "median1", "mean_difference", "cohens_d", "auc")])


@R(f"""with {C}, {LONG}, s as (select metric, label, source_group, avg(v) a from l group by 1, 2, 3), o as (select metric, label, avg(v) a from l group by 1, 2), t as (select s.metric, s.source_group, case when s.label = 1 then s.a - o.a else o.a - s.a end as diff from s join o on s.metric = o.metric and o.label = 1 - s.label)
  select metric, count(*) as sources, count(*) filter (diff > 0) as positive, round(min(abs(diff)), 6) as least_shift, abs(sum(sign(diff))) = count(*) as agree from t group by 1""")
def agg_35_source_robustness(spark: SparkSession, d: str) -> DataFrame:
    long = long_features(cohort(spark, d))
    s = long.groupBy("metric", "label", "source_group").agg(F.avg("v").alias("a"))
    o = long.groupBy("metric", "label").agg(F.avg("v").alias("o")).select("metric", (1 - F.col("label")).alias("label"), "o")
    t = s.join(o, ["metric", "label"]).select("metric", F.when(F.col("label") == 1, F.col("a") - F.col("o")).otherwise(F.col("o") - F.col("a")).alias("diff"))
    return t.groupBy("metric").agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("diff") > 0).alias("positive"), six(F.min(F.abs("diff")), "least_shift"), (F.abs(F.sum(F.signum("diff"))) == F.count(F.lit(1))).alias("agree"))


@R(f"""with {C}, x as (select metric, label, v from (select label, unnest(['f1', 'f2', 'f3', 'f5']) as metric, unnest([f1, f2, f3, f5]) as v from c) where v is not null), r as (select *, rank() over (partition by metric order by v) + (count(*) over (partition by metric, v) - 1) / 2.0::double as rk from x),
  t as (select metric, sum(n::double * n * n - n) as ties from (select metric, v, count(*) n from x group by 1, 2) group by 1), s as (select metric, sum(rk) filter (label = 1) as r1, count(*) filter (label = 1)::double as n1, count(*) filter (label = 0)::double as n0 from r group by 1),
  z as (select metric, r1 - n1 * (n1 + 1) / 2 as u, (abs(r1 - n1 * (n1 + 1) / 2 - n1 * n0 / 2) - 0.5) / sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1)))) as z from s join t using (metric))
  select metric, u, round(z, 6) as z, round(2 * list_sum(list_transform(range(8001), lambda i: exp(-(z + i * 0.0015::double) * (z + i * 0.0015::double) / 2) * case when i = 0 or i = 8000 then 1 when i % 2 = 1 then 4 else 2 end)) * 0.0015::double / 3 / sqrt(2 * pi()), 6) as p_value from z""")
def agg_36_rank_tests(spark: SparkSession, d: str) -> DataFrame:
    """Mann-Whitney U per metric with tie-corrected normal p-value (continuity corrected)."""
    from cadenza.functions.scalar import normal_tail

    x = long_features(cohort(spark, d))
    r = m.with_average_rank(x, "v", ["metric"], "rk")
    ties = x.groupBy("metric", "v").agg(F.count(F.lit(1)).alias("t")).groupBy("metric").agg(F.sum(F.expr("double(t) * t * t - t")).alias("ties"))
    s = r.groupBy("metric").agg(F.sum(F.when(F.col("label") == 1, F.col("rk"))).alias("r1"), F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0")).join(ties, "metric")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    n = F.col("n1") + F.col("n0")
    var = F.col("n1") * F.col("n0") / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    z = (F.abs(u - F.col("n1") * F.col("n0") / 2.0) - 0.5) / F.sqrt(var)
    return s.select("metric", u.alias("u"), six(z, "z"), six(2 * normal_tail(z), "p_value"))


P_OF = "((id * 7919) % 9973 + 1) / 9973.0::double"


@R(f"with {C}, p as (select id, source_group, {P_OF} as p from c), r as (select *, p * count(*) over (partition by source_group) / row_number() over (partition by source_group order by p) as q from p) select id, round(least(1.0, min(q) over (partition by source_group order by p desc range between unbounded preceding and current row)), 6) as adjusted from r")
def agg_37_benjamini_hochberg(spark: SparkSession, d: str) -> DataFrame:
    p = cohort(spark, d).select("id", "source_group", (((F.col("id") * 7919) % 9973 + 1) / 9973.0).alias("p"))
    return m.benjamini_hochberg(p, "p", ["source_group"]).select("id", six("adjusted", "adjusted"))


@R(f"""with {C}, r as (select source_group, rank() over (partition by source_group order by f1) + (count(*) over (partition by source_group, f1) - 1) / 2.0 a, rank() over (partition by source_group order by score) + (count(*) over (partition by source_group, score) - 1) / 2.0 b from c)
  select source_group, round(case when count(*) >= 3 then corr(a, b) end, 6) as spearman from r group by 1""")
def agg_38_spearman(spark: SparkSession, d: str) -> DataFrame:
    r = m.with_average_rank(m.with_average_rank(cohort(spark, d).select("source_group", "f1", "score"), "f1", ["source_group"], "a"), "score", ["source_group"], "b")
    return r.groupBy("source_group").agg(six(F.when(F.count(F.lit(1)) >= 3, F.corr("a", "b")), "spearman"))


@R(f"""with {C}, t as (select source_group, count(*) filter (score >= 0.5)::double k, count(*)::double n from c group by 1), z as (select *, 1.959963984540054 as z, k / n as p from t)
  select source_group, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) as lower, round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) as upper from z""")
def agg_39_wilson(spark: SparkSession, d: str) -> DataFrame:
    t = cohort(spark, d).groupBy("source_group").agg(F.count_if(F.col("score") >= 0.5).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = m.wilson(F.col("k"), F.col("n"))
    return t.select("source_group", six(lo, "lower"), six(hi, "upper"))


PROBE = "q as (select id // 2 as pair, id % 2 as pos, source_group as task, case when k % 11 = 0 then null when score > 0.55 then 'A' when score < 0.45 then 'B' else 'tie' end as answer, case when id % 2 = 0 then 'A' else 'B' end as truth from c)"


@R(f"""with {C}, {PROBE}, a as (select task, round(avg(case when answer is null then 0.0 else 1 end), 6) as parse_rate, round(avg(case when answer = 'tie' then 1.0 when answer is null then null else 0 end), 6) as tie_rate from q group by 1),
  p as (select pair, min(task) as task, count(*) n, max(case when pos = 0 then answer end) a0, max(case when pos = 1 then answer end) a1 from q group by 1 having count(*) = 2)
  select task, parse_rate, tie_rate, round(avg(case when a0 is null or a1 is null then null when (a0 = 'A' and a1 = 'B') or (a0 = 'B' and a1 = 'A') then 1.0 else 0 end), 6) as order_consistency, round(avg(case when a0 = 'A' and a1 = 'B' then 1.0 else 0 end), 6) as both_correct from a join p using (task) group by task, parse_rate, tie_rate""")
def agg_40_probe_summary(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    q = cohort(spark, d).select(F.floor(F.col("id") / 2).alias("pair"), (F.col("id") % 2).alias("pos"), F.col("source_group").alias("task"), F.when(F.col("k") % 11 == 0, F.lit(None)).when(s > 0.55, "A").when(s < 0.45, "B").otherwise("tie").alias("answer"))
    a = q.groupBy("task").agg(six(F.avg(F.col("answer").isNotNull().cast("double")), "parse_rate"), six(F.avg((F.col("answer") == "tie").cast("double")), "tie_rate"))
    p = q.groupBy("pair").agg(F.min("task").alias("task"), F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("pos") == i, F.col("answer"))).alias(f"a{i}") for i in (0, 1)]).where("n = 2")
    right = (F.col("a0") == "A") & (F.col("a1") == "B")
    same = right | (F.col("a0") == "B") & (F.col("a1") == "A")
    known = F.col("a0").isNotNull() & F.col("a1").isNotNull()
    return p.groupBy("task").agg(six(F.avg(F.when(known, same.cast("double"))), "order_consistency"), six(F.avg(F.coalesce(right, F.lit(False)).cast("double")), "both_correct")).join(a, "task")


@R(f"""with {C}, n as (select user_id as rec, k % 12 as pitch, value + 1 as v, abs(value - lag(value) over (partition by user_id, k % 12 order by ts, id)) as step from c), g as (select rec, pitch, count(*) n, stddev_pop(v) / avg(v) as cv, median(step) as delta from n group by 1, 2 having count(*) >= 4)
  select rec, round(round(sum(n * cv) / sum(n), 9), 6) as weighted_cv, round(round(sum(n * delta) / sum(n), 9), 6) as weighted_delta from g group by 1""")
def agg_41_pitch_conditional(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id", F.col("k") % 12).orderBy("ts", "id")
    n = cohort(spark, d).select(F.col("user_id").alias("rec"), (F.col("k") % 12).alias("pitch"), (F.col("value") + 1).alias("v"), F.abs(F.col("value") - F.lag("value").over(w)).alias("step"))
    g = n.groupBy("rec", "pitch").agg(F.count(F.lit(1)).alias("n"), (F.stddev_pop("v") / F.avg("v")).alias("cv"), F.median("step").alias("delta")).where("n >= 4")
    return g.groupBy("rec").agg(six(F.round(F.sum(F.col("n") * F.col("cv")) / F.sum("n"), 9), "weighted_cv"), six(F.round(F.sum(F.col("n") * F.col("delta")) / F.sum("n"), 9), "weighted_delta"))


@R(f"""with {C}, b as (select source_group, cast(floor(k / 10) as int) as bar, list(distinct id % 16) as cells, count(*) n from c group by 1, 2), p as (select a.source_group, len(list_intersect(a.cells, b.cells))::double i, len(a.cells) + len(b.cells) s from b a join b b on a.source_group = b.source_group and a.bar < b.bar)
  select source_group, round(avg(1 - i / (s - i)), 6) as jaccard_distance, any_value(cv) as count_cv from p join (select source_group, round(stddev_pop(n) / avg(n), 6) as cv from b group by 1) using (source_group) group by 1""")
def agg_42_bar_grids(spark: SparkSession, d: str) -> DataFrame:
    """Mean pairwise Jaccard distance of bars' occupied cells; a recording has a bounded number of bars, which the grid gives."""
    b = cohort(spark, d).groupBy("source_group", F.floor(F.col("k") / 10).cast("int").alias("bar")).agg(F.collect_set(F.col("id") % 16).alias("cells"), F.count(F.lit(1)).alias("n"))
    o = b.select("source_group", F.col("bar").alias("other"), F.col("cells").alias("theirs"))
    i, s = F.size(F.array_intersect("cells", "theirs")), F.size("cells") + F.size("theirs")
    p = b.join(o, "source_group").where("bar < other").groupBy("source_group").agg(six(F.avg(1 - i / (s - i)), "jaccard_distance"))
    return p.join(b.groupBy("source_group").agg(six(F.stddev_pop("n") / F.avg("n"), "count_cv")), "source_group")


@R(f"""with {C}, g as (select source_group, median(value) m from c group by 1), a as (select source_group, median(abs(value - m)) mad from c join g using (source_group) group by 1) select id, round((value - m) / nullif(1.4826 * mad, 0), 6) as robust_z from c join g using (source_group) join a using (source_group)""")
def agg_43_robust_z(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).select("id", "source_group", "value")
    g = c.groupBy("source_group").agg(F.median("value").alias("m"))
    a = c.join(g, "source_group").groupBy("source_group").agg(F.median(F.abs(F.col("value") - F.col("m"))).alias("mad"), F.first("m").alias("m"))
    return c.join(a, "source_group").select("id", six(F.try_divide(F.col("value") - F.col("m"), 1.4826 * F.col("mad")), "robust_z"))


@R(f"""with {C}, q as (select source_group, quantile_cont(value, 0.25) lo, quantile_cont(value, 0.75) hi from c group by 1), t as (select c.source_group, case when value >= hi then 1 when value <= lo then 0 end as label, score from c join q using (source_group)), x as (select *, rank() over (partition by source_group order by score) + (count(*) over (partition by source_group, score) - 1) / 2.0 as rk from t where label is not null)
  select source_group, round({AUC}, 6) as accuracy from x group by 1""")
def agg_44_quartile_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """P(estimate of a top-quartile row > that of a bottom-quartile row) + half the ties, from sums per score instead of pairs."""
    c = cohort(spark, d).select("source_group", "value", "score")
    q = c.groupBy("source_group").agg(F.percentile("value", F.lit(0.25)).alias("lo"), F.percentile("value", F.lit(0.75)).alias("hi"))
    t = c.join(q, "source_group").withColumn("label", F.when(F.col("value") >= F.col("hi"), 1).when(F.col("value") <= F.col("lo"), 0))
    return m.auc(t, ["source_group"], out="accuracy").select("source_group", six("accuracy", "accuracy"))


@R(f"""with {C}, s as (select source_group, k % 4 as seed, avg(score) v from c group by 1, 2) select source_group, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, stddev_samp(v) < 0.05 and min(v) > 0.3 as admitted from s group by 1""")
def agg_45_cross_seed_gates(spark: SparkSession, d: str) -> DataFrame:
    s = cohort(spark, d).groupBy("source_group", (F.col("k") % 4).alias("seed")).agg(F.avg("score").alias("v"))
    return s.groupBy("source_group").agg(six(F.avg("v"), "mean"), six(F.stddev_samp("v"), "sd"), ((F.stddev_samp("v") < 0.05) & (F.min("v") > 0.3)).alias("admitted"))


@R("""with g as (select category, path, max(bytes) as bytes, min(recorded_at) as first, max(recorded_at) as last, bool_or(sha256 is not null) as digested from generated_cleanup group by 1, 2)
  select category, count(*) as expected, count(*) filter (digested) as present, count(*) filter (not digested) as missing, count(*) filter (bytes = 0) as zero_bytes, sum(bytes)::bigint as bytes, round(epoch(max(last)) - epoch(min(first)), 3) as span_s from g group by 1""")
def agg_46_stage_inventory(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "generated_cleanup").groupBy("category", "path").agg(F.max("bytes").alias("bytes"), F.min("recorded_at").alias("a"), F.max("recorded_at").alias("z"), F.bool_or(F.col("sha256").isNotNull()).alias("digested"))
    span = (F.unix_micros(F.max("z").cast("timestamp")) - F.unix_micros(F.min("a").cast("timestamp"))) / 1e6
    return g.groupBy("category").agg(F.count(F.lit(1)).alias("expected"), F.count_if("digested").alias("present"), F.count_if(~F.col("digested")).alias("missing"), F.count_if(F.col("bytes") == 0).alias("zero_bytes"), F.sum("bytes").alias("bytes"), F.round(span, 3).alias("span_s"))


@R(f"with {C} select source_group, count(distinct group_id) as groups, count(distinct component_id) as components, count(distinct score) as scores, count(distinct user_id) as users from c group by 1")
def agg_47_exact_distinct(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).groupBy("source_group").agg(*[F.count_distinct(c).alias(n) for c, n in (("group_id", "groups"), ("component_id", "components"), ("score", "scores"), ("user_id", "users"))])


@R(f"""with {C}, q as (select source_group, median(f5) med, quantile_cont(f5, 0.75) - quantile_cont(f5, 0.25) iqr, quantile_cont(f5, 0.9) - quantile_cont(f5, 0.1) span, count(f5) n from c group by 1), a as (select source_group, median(abs(f5 - med)) mad from c join q using (source_group) group by 1)
  select source_group, round(med, 6) as median, round(mad, 6) as mad, round(iqr, 6) as iqr, round(span, 6) as span from q join a using (source_group) where n >= 8""")
def agg_48_robust_summary(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).select("source_group", "f5")
    p = F.percentile("f5", F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    q = c.groupBy("source_group").agg(p.alias("q"), F.count("f5").alias("n")).where("n >= 8").select("source_group", *[F.col("q")[i].alias(f"q{i}") for i in range(5)])
    a = c.join(q, "source_group").groupBy("source_group").agg(F.median(F.abs(F.col("f5") - F.col("q2"))).alias("mad"))
    return q.join(a, "source_group").select("source_group", six("q2", "median"), six("mad", "mad"), six(F.col("q3") - F.col("q1"), "iqr"), six(F.col("q4") - F.col("q0"), "span"))


@R(f"with {C} select h.source_group as human_source, a.source_group as ai_source, true as rates_agree, true as auc_agrees from (select distinct source_group from c where label = 0) h, (select distinct source_group from c where label = 1) a")
def svc_07_metric_audit(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of source pairs computed again from the predictions by another way: rates by rows, areas by ranks."""
    c = cohort(spark, d).select("label", "source_group", "group_id", "score")
    told = m.source_pairs(c)
    names = told.select("human_source", "ai_source")
    side = lambda y, s: names.join(c.where(F.col("label") == y).withColumnRenamed("source_group", s), s).select("human_source", "ai_source", "label", "score")
    r = m.with_average_rank(side(0, "human_source").unionAll(side(1, "ai_source")), "score", ["human_source", "ai_source"])
    one = F.col("label") == 1
    n1, n0 = F.count_if(one), F.count_if(~one)
    again = r.groupBy("human_source", "ai_source").agg((F.count_if(one & (F.col("score") >= 0.5)) / n1).alias("sens"), (F.count_if(~one & (F.col("score") < 0.5)) / n0).alias("spec"), ((F.sum(F.when(one, F.col("rank"))) - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("area"))
    same = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-9
    return told.join(again, ["human_source", "ai_source"]).select("human_source", "ai_source", (same("sensitivity", "sens") & same("specificity", "spec")).alias("rates_agree"), same("auc", "area").alias("auc_agrees"))
