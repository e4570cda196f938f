"""Queries of supplementary operators (SUP) and of stream-like behaviour in batch (STR)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import kernels as k
from cadenza.functions.hashing import SET_DIGEST, hash_fold, rank_key, set_digest, stable_fraction
from cadenza.operators import graph
from cadenza.operators import relational as r
from cadenza.operators import sequences as q
from cadenza.operators import signals as s
from cadenza.operators.metrics import ratio, six
from cadenza.queries._cohort import C, cohort
from cadenza.queries.aggregates import FOLD, with_fold
from cadenza.queries.signals import recordings
from cadenza.registry import Registry
from cadenza.session import cut, table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
H = "sha256('{}|' || {})"


@R(f"""with {C}, f as (select source_group, role, {FOLD} as fold, count(*) n, count(distinct group_id) g from c group by 1, 2, 3) select coalesce(source_group, '__total__') as source_group, coalesce(role, '__all_arms__') as role, min(n) as least_rows, max(n) as most_rows, min(g) as least_groups, max(g) as most_groups from f group by cube (source_group, role)""")
def sup_01_training_ranges(spark: SparkSession, d: str) -> DataFrame:
    f = with_fold(cohort(spark, d)).groupBy("source_group", "role", "fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("group_id").alias("g"))
    x = f.cube("source_group", "role").agg(F.min("n").alias("least_rows"), F.max("n").alias("most_rows"), F.min("g").alias("least_groups"), F.max("g").alias("most_groups"))
    return x.withColumns({"source_group": F.coalesce("source_group", F.lit("__total__")), "role": F.coalesce("role", F.lit("__all_arms__"))})


@R(f"""with {C}, f as (select source_group, {FOLD} as fold, k % 2 as arm, avg(score) v, count(*) n from c group by 1, 2, 3), h as (select source_group, arm, avg(v) v, count(*) cells from f group by 1, 2) select 'source' as level, source_group, round(avg(v), 6) as value, sum(cells)::bigint as cells from h group by 2 union all select 'macro', null, round(avg(v), 6), sum(cells)::bigint from (select arm, avg(v) v, sum(cells) cells from h group by 1)""")
def sup_02_two_summary_levels(spark: SparkSession, d: str) -> DataFrame:
    f = with_fold(cohort(spark, d)).groupBy("source_group", "fold", (F.col("k") % 2).alias("arm")).agg(F.avg("score").alias("v"))
    h = f.groupBy("source_group", "arm").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("cells"))
    a = h.groupBy("source_group").agg(six(F.avg("v"), "value"), F.sum("cells").alias("cells")).withColumn("level", F.lit("source"))
    b = h.groupBy("arm").agg(F.avg("v").alias("v"), F.sum("cells").alias("cells")).agg(six(F.avg("v"), "value"), F.sum("cells").alias("cells")).withColumn("level", F.lit("macro"))
    return a.unionByName(b, allowMissingColumns=True)


@R(f"""with {C}, f as (select source_group, {FOLD} as fold, avg(score) filter (k % 2 = 0) a, avg(score) filter (k % 2 = 1) b from c group by 1, 2) select source_group, round(avg(b - a), 6) as increment, sum(sign(round(b - a, 9)))::bigint as direction, count(*) filter (b > a) as up from f where a is not null and b is not null group by 1""")
def sup_03_increments(spark: SparkSession, d: str) -> DataFrame:
    arm = lambda v: F.avg(F.when(F.col("k") % 2 == v, F.col("score")))
    f = with_fold(cohort(spark, d)).groupBy("source_group", "fold").agg(arm(0).alias("a"), arm(1).alias("b")).where("a is not null and b is not null")
    e = F.col("b") - F.col("a")
    return f.groupBy("source_group").agg(six(F.avg(e), "increment"), F.sum(F.signum(F.round(e, 9))).cast("bigint").alias("direction"), F.count_if(e > 0).alias("up"))


@R(f"with {C}, g as (select k % 3 as model, source_group, group_id, sum(case when (score >= 0.5) = (label = 1) then 1 else 0 end) hit, count(*) n from c group by 1, 2, 3) select model, source_group, sum(hit)::bigint as pooled, round(sum(hit::double / n), 6) as group_rates, count(*) as groups from g group by 1, 2")
def sup_04_sorted_aggregation(spark: SparkSession, d: str) -> DataFrame:
    hit = ((F.col("score") >= 0.5) == (F.col("label") == 1)).cast("int")
    g = cohort(spark, d).groupBy((F.col("k") % 3).alias("model"), "source_group", "group_id").agg(F.sum(hit).alias("hit"), F.count(F.lit(1)).alias("n"))
    return g.groupBy("model", "source_group").agg(F.sum("hit").alias("pooled"), six(F.sum(ratio(F.col("hit"), F.col("n"))), "group_rates"), F.count(F.lit(1)).alias("groups"))


@R(f"with {C} select k % 10 as model, count(*) filter (label = 1 and score >= 0.5) as tp, count(*) filter (label = 1 and score < 0.5) as fn, count(*) filter (label = 0 and score >= 0.5) as fp, count(*) filter (label = 0 and score < 0.5) as tn from c where source_group in ('error', 'view') group by 1")
def sup_05_endpoint_matching(spark: SparkSession, d: str) -> DataFrame:
    from cadenza.operators.metrics import confusion

    return confusion(cohort(spark, d).where("source_group in ('error', 'view')").withColumn("model", F.col("k") % 10), ["model"]).select("model", "tp", "fn", "fp", "tn")


@R(f"with {C}, s as (select source_group, k % 2 as arm, avg(score) v from c where role = 'locked' group by 1, 2) select a.source_group, round(b.v - a.v, 6) as delta_v from s a join s b using (source_group) where a.arm = 0 and b.arm = 1")
def sup_06_historical_deltas(spark: SparkSession, d: str) -> DataFrame:
    x = cohort(spark, d).where("role = 'locked'").groupBy("source_group", (F.col("k") % 2).alias("arm")).agg(F.avg("score").alias("v"))
    return r.matched_deltas(x, ["source_group"], "arm", 0, 1, ["v"]).select("source_group", six("delta_v", "delta_v"))


@R(f"with {C}, f as (select *, {FOLD} as fold from c), p as (select source_group, fold, count(*) n from f where not (source_group = 'click' and fold = 1) group by 1, 2) select s.source_group, x.fold, 'no_rows' as reason from (select distinct source_group from c) s, (select unnest(range(5))::int as fold) x except select source_group, fold, 'no_rows' from p")
def sup_07_omitted_folds(spark: SparkSession, d: str) -> DataFrame:
    c = with_fold(cohort(spark, d))
    want = c.select("source_group").distinct().select("source_group", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"))
    return want.join(c.where("not (source_group = 'click' and fold = 1)").select("source_group", "fold").distinct(), ["source_group", "fold"], "left_anti").withColumn("reason", F.lit("no_rows"))


@R(f"with {C} select source_group, count(*) as candidates, count(*) filter (k >= 10) as attempted, count(*) filter (k >= 10 and value >= 2) as eligible, count(*) filter (k >= 10 and value < 2) as short, round(count(*) filter (k >= 10 and value >= 2)::double / count(*), 6) as fraction from c group by 1")
def sup_08_attrition(spark: SparkSession, d: str) -> DataFrame:
    a, e = F.col("k") >= 10, F.col("value") >= 2
    return cohort(spark, d).groupBy("source_group").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(a).alias("attempted"), F.count_if(a & e).alias("eligible"), F.count_if(a & ~e).alias("short"), six(ratio(F.count_if(a & e), F.count(F.lit(1))), "fraction"))


@R(f"with {C}, p as (select distinct user_id, {H.format('player', 'user_id::varchar')} h from c), pr as (select user_id, row_number() over (order by h) r from p), s as (select distinct k, {H.format('score', 'k::varchar')} h from c), sr as (select k, row_number() over (order by h) r from s) select id, case when pr.r <= 3 and sr.r <= 15 then 'dev' when pr.r > 3 and sr.r > 15 then 'reserved' else 'unused' end as part from c join pr using (user_id) join sr using (k)")
def sup_09_crossed_split(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).select("id", "user_id", "k")
    first = lambda col, seed, n: c.select(col).distinct().orderBy(rank_key(F.col(col).cast("string"), seed)).limit(n).withColumn(f"in_{col}", F.lit(True))
    x = c.join(first("user_id", "player", 3), "user_id", "left").join(first("k", "score", 15), "k", "left")
    p, sc = F.coalesce("in_user_id", F.lit(False)), F.coalesce("in_k", F.lit(False))
    return x.select("id", F.when(p & sc, "dev").when(~p & ~sc, "reserved").otherwise("unused").alias("part"))


@R(f"with {C}, x as (select user_id, id, k, value, row_number() over (partition by user_id, value order by id) v from c), y as (select *, row_number() over (partition by user_id order by abs(k - 60), {H.format('20260907', 'id::varchar')}) r from x where v = 1) select user_id, id from y where r <= 2")
def sup_10_roster(spark: SparkSession, d: str) -> DataFrame:
    x = r.top_per_group(cohort(spark, d).select("user_id", "id", "k", "value"), ["user_id", "value"], [F.col("id")], 1)
    return r.top_per_group(x, ["user_id"], [F.abs(F.col("k") - 60), rank_key(F.col("id").cast("string"))], 2).select("user_id", "id")


@R(f"with {C}, g as (select source_group, group_id, avg(f5 - f1) v from c group by 1, 2) select source_group, round(avg(v), 6) as mean, count(*) filter (round(v, 9) > 0) as positive, count(*) filter (round(v, 9) = 0) as zero, count(*) filter (round(v, 9) < 0) as negative, count(v) as groups from g group by 1")
def sup_11_sign_counts(spark: SparkSession, d: str) -> DataFrame:
    g = cohort(spark, d).groupBy("source_group", "group_id").agg(F.avg(F.col("f5") - F.col("f1")).alias("v"))
    v = F.round("v", 9)
    return g.groupBy("source_group").agg(six(F.avg("v"), "mean"), F.count_if(v > 0).alias("positive"), F.count_if(v == 0).alias("zero"), F.count_if(v < 0).alias("negative"), F.count("v").alias("groups"))


@R("with e as (select a.vec_id, unnest(range(64)) as i, unnest(a.embedding)::double as x, unnest(b.embedding)::double as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0), m as (select vec_id, x, y, abs(x) > 0.05 as mx, abs(y) > 0.05 as my from e) select vec_id, round(avg(case when mx = my then 1.0 else 0 end), 6) as mask_agreement, round(max(abs(x - y)) filter (mx and my), 6) as largest from m group by 1")
def sup_12_nuisance_comparison(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 2).alias("p")).agg(F.max(F.when(F.col("vec_id") % 2 == 0, F.col("embedding"))).alias("a"), F.max(F.when(F.col("vec_id") % 2 == 1, F.col("embedding"))).alias("b")).where("a is not null and b is not null")
    z = F.zip_with("a", "b", lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    on = lambda v: F.abs(v) > 0.05
    same = F.aggregate(z, F.lit(0), lambda a, t: a + (on(t["x"]) == on(t["y"])).cast("int"))
    gap = F.array_max(F.transform(F.filter(z, lambda t: on(t["x"]) & on(t["y"])), lambda t: F.abs(t["x"] - t["y"])))
    return e.select((F.col("p") * 2).alias("vec_id"), six(same / 64.0, "mask_agreement"), six(gap, "largest"))


@R(f"with {C}, g as (select source_group, role, group_id, avg(f5 - f1) v from c group by 1, 2, 3) select source_group, role, round(avg(v), 6) as mean, count(*) filter (round(v, 9) > 0) as positive, count(*) filter (round(v, 9) < 0) as negative from g group by grouping sets ((source_group), (role))")
def sup_13_two_keys(spark: SparkSession, d: str) -> DataFrame:
    g = cohort(spark, d).groupBy("source_group", "role", "group_id").agg(F.avg(F.col("f5") - F.col("f1")).alias("v"))
    v = F.round("v", 9)
    return g.groupingSets([["source_group"], ["role"]], "source_group", "role").agg(six(F.avg("v"), "mean"), F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"))


@R(f"with {C}, t as (select source_group, avg(score) m, count(distinct role) roles, count(distinct group_id) g from c group by 1) select source_group, m < 0.55 as margin, roles = 2 and g >= 10 as coverage, case when m < 0.55 and roles = 2 and g >= 10 then 'accept' when roles < 2 then 'missing_stratum' else 'hold' end as decision from t")
def sup_14_gate_decisions(spark: SparkSession, d: str) -> DataFrame:
    t = cohort(spark, d).groupBy("source_group").agg(F.avg("score").alias("m"), F.count_distinct("role").alias("roles"), F.count_distinct("group_id").alias("g"))
    a, b = F.col("m") < 0.55, (F.col("roles") == 2) & (F.col("g") >= 10)
    return t.select("source_group", a.alias("margin"), b.alias("coverage"), F.when(a & b, "accept").when(F.col("roles") < 2, "missing_stratum").otherwise("hold").alias("decision"))


@R(r"""with p as (select distinct path, string_split(replace(path, chr(92), '/'), '/')[-1] as base from generated_cleanup where path is not null), a as (select path, [lower(base), lower(regexp_replace(base, '\.[^.]*$', '')), trim(regexp_replace(lower(regexp_replace(base, '\.[^.]*$', '')), '[^a-z0-9]+', '_', 'g'), '_')] as al from p) select path, array_to_string(list_sort(list_distinct(list_filter(al, lambda x: length(x) >= 6))), '|') as aliases from a""")
def sup_15_alias_sets(spark: SparkSession, d: str) -> DataFrame:
    base = F.lower(F.element_at(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/"), -1))
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    al = F.array(base, stem, F.regexp_replace(F.regexp_replace(stem, "[^a-z0-9]+", "_"), "^_+|_+$", ""))
    return table(spark, d, "generated_cleanup").where("path is not null").select("path").distinct().select("path", F.array_join(F.array_sort(F.array_distinct(F.filter(al, lambda x: F.length(x) >= 6))), "|").alias("aliases"))


@R(f"with recursive {C}, n as (select id, 'u:' || user_id::varchar as node from c where id % 3 <> 0 union select id, 'k:' || (id // 7)::varchar from c where id % 5 = 0), e as (select distinct a.node as u, b.node as v from n a join n b using (id)), reach(u, v) as (select u, v from e union select r.u, e.v from reach r join e on e.u = r.v), roots as (select u as node, min(v) as root from reach group by 1) select (select count(distinct root) from roots) + (select count(*) from c where id % 3 = 0 and id % 5 <> 0) as entities")
def sup_16_entity_count(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).select("id", F.when(F.col("id") % 3 != 0, F.col("user_id")).alias("u"), F.when(F.col("id") % 5 == 0, F.floor(F.col("id") / 7)).alias("k"))
    roots = graph.components(graph.closure_edges(c, {"u": "u", "k": "k"}))
    node = F.coalesce(F.concat(F.lit("u:"), F.col("u").cast("string")), F.concat(F.lit("k:"), F.col("k").cast("string")), F.concat(F.lit("id:"), F.col("id").cast("string")))
    return c.select(node.alias("node")).distinct().join(roots, "node", "left").agg(F.count_distinct(F.coalesce("root", "node")).alias("entities"))


@R("select id, 'drive' as origin, source_group as source, canonical.duration_s as seconds from drive_sources union all select sample_id, 'text', source, n_chars::double from documents where sample_id is not null")
def sup_17_schema_adapters(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "drive_sources").select("id", F.lit("drive").alias("origin"), F.col("source_group").alias("source"), F.col("canonical.duration_s").alias("seconds"))
    b = table(spark, d, "documents").where("sample_id is not null").select(F.col("sample_id").alias("id"), F.lit("text").alias("origin"), "source", F.col("n_chars").cast("double").alias("seconds"))
    return a.unionByName(b)


@R(f"""with recursive k as (select distinct id, provenance.artist as a, provenance.title as t from drive_sources where provenance.artist is not null or provenance.title is not null), n as (select id, 'a:' || a as node from k where a is not null union select id, 't:' || t from k where t is not null), e as (select distinct 'a:' || a as u, 't:' || t as v from k where a is not null and t is not null),
  e2 as (select u, v from e union select v, u from e), reach(u, v) as (select u, v from e2 union select r.u, e2.v from reach r join e2 on e2.u = r.v), roots as (select node, coalesce(min(v), node) as root from (select distinct node from n) z left join reach on reach.u = z.node group by node) select {SET_DIGEST.format('node')} as group_id, count(*) as keys from roots group by root""")
def sup_18_group_identity(spark: SparkSession, d: str) -> DataFrame:
    """Every component of artists and titles, named by the digest of its keys; no task has to hold a component's keys."""
    k_ = table(spark, d, "drive_sources").select("id", F.col("provenance.artist").alias("a"), F.col("provenance.title").alias("t")).distinct()
    both = graph.components(graph.closure_edges(k_, {"a": "a", "t": "t"}))
    nodes = k_.select(F.explode(F.array_compact(F.array(F.concat(F.lit("a:"), "a"), F.concat(F.lit("t:"), "t")))).alias("node")).distinct()
    x = nodes.join(both, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return set_digest(x, ["root"], "node", "group_id", "keys").select("group_id", "keys")


@R(f"""with {C}, x as (select user_id, count(*) as n, {H.format('20260907', 'user_id::varchar')} as h from c group by 1), l as (select max(l) as l from (select unnest(range(1001)) as l) z where (select sum(least(n, z.l)) from x) <= 1000),
  y as (select *, sum((n > l)::int) over (order by h, user_id rows unbounded preceding) - (n > l)::int as place, (select 1000 - sum(least(n, l)) from x) as rest from x, l) select user_id, (least(n, l) + (n > l and place < rest)::int)::bigint as target from y""")
def sup_19_proportional_targets(spark: SparkSession, d: str) -> DataFrame:
    x = cohort(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("order", rank_key(F.col("user_id").cast("string")))
    return q.proportional_targets(x, "user_id", "n", 1000, "order")


@R(f"with {C}, x as (select id, source_group, k, row_number() over (partition by source_group, k order by {H.format('20260907', 'id::varchar')}) r from c), y as (select *, row_number() over (partition by source_group order by r, {H.format('20260907', 'k::varchar')}) o from x) select source_group, id from y where o <= 30")
def sup_20_round_robin(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("source_group", "k").orderBy(rank_key(F.col("id").cast("string")))
    x = cohort(spark, d).select("id", "source_group", "k", F.row_number().over(w).alias("r"))
    return r.top_per_group(x, ["source_group"], [F.col("r"), rank_key(F.col("k").cast("string"))], 30).select("source_group", "id")


@R("with u as (select id, 'manifest' as origin, 1 as p from drive_sources union all select id, 'measured', 2 from sample_reference_features union all select id, 'scored', 3 from native30_replay) select id, arg_min(origin, p) as first_origin, count(distinct origin) as origins from u where id is not null group by 1")
def sup_21_origin_ledger(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, o, p: table(spark, d, t).select("id", F.lit(o).alias("origin"), F.lit(p).alias("p"))
    u = one("drive_sources", "manifest", 1).unionAll(one("sample_reference_features", "measured", 2)).unionAll(one("native30_replay", "scored", 3)).where("id is not null")
    return u.groupBy("id").agg(F.min_by("origin", "p").alias("first_origin"), F.count_distinct("origin").alias("origins"))


@R("with d as (select distinct id, label, source_group from drive_sources), f as (select id, count(*) m from sample_reference_features where features is not null group by 1), n as (select id, count(*) r, count(distinct combination) combos from native30_replay where features is not null group by 1) select d.id, d.label, m as measured, r as receipts, combos from d join f using (id) join n using (id)")
def sup_22_row_assembly(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "drive_sources").select("id", "label", "source_group").distinct()
    f = table(spark, d, "sample_reference_features").where("features is not null").groupBy("id").agg(F.count(F.lit(1)).alias("measured"))
    n = table(spark, d, "native30_replay").where("features is not null").groupBy("id").agg(F.count(F.lit(1)).alias("receipts"), F.count_distinct("combination").alias("combos"))
    return a.join(f, "id").join(n, "id").select("id", "label", "measured", "receipts", "combos")


@R("with x as (select id, load_id, list_filter(map_keys(features), lambda k: starts_with(k, 'F_')) as f, features from sample_reference_features where features is not null) select load_id, count(*) as rows, count(*) filter (len(f) = 15 and len(list_filter(f, lambda k: features[k] is null or not isfinite(features[k]))) = 0) as complete from x group by 1")
def sup_23_family_completeness(spark: SparkSession, d: str) -> DataFrame:
    f = F.map_filter("features", lambda k_, v: k_.startswith("F_") & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return table(spark, d, "sample_reference_features").where("features is not null").groupBy("load_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size(f) == 15).alias("complete"))


@R(f"with {C} select source_group, count(*) filter (f2 is not null and f5 is not null) as common, round(avg(abs(f5 - f2)), 6) as mean_delta, round(max(abs((f5 - f2 + pi()) - 2 * pi() * floor((f5 - f2 + pi()) / (2 * pi())) - pi())), 6) as largest_phase from c group by 1")
def sup_24_perturbation(spark: SparkSession, d: str) -> DataFrame:
    from cadenza.functions.scalar import wrap_phase

    e = F.col("f5") - F.col("f2")
    return cohort(spark, d).groupBy("source_group").agg(F.count(e).alias("common"), six(F.avg(F.abs(e)), "mean_delta"), six(F.max(F.abs(wrap_phase(e))), "largest_phase"))


@R()
def sup_25_lag_estimation(spark: SparkSession, d: str) -> DataFrame:
    return s.long(s.measure(recordings(spark, d), "recording", ["x", "y"], lambda x, y: dict(zip(("lag", "peak", "runner_up"), map(float, k.best_lag(x, y))))), "recording")


@R("with e as (select label::varchar || '-' || (vec_id // 500)::varchar as recording, count(*) * 64 as n from embeddings group by 1) select recording, unnest(['start', 'error']) as name, unnest([case when n > 164 then 100.0 else 0.0 end, 0.0])::double as value from e")
def sup_26_template_search(spark: SparkSession, d: str) -> DataFrame:
    return s.long(s.measure(recordings(spark, d), "recording", ["x"], lambda x: dict(zip(("start", "error"), map(float, k.template_search(x, x[100:164] if len(x) > 164 else x))))), "recording")


@R("select vec_id, round(list_max(list_transform(embedding, lambda x: abs(x)))::double, 6) as peak, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / 64), 6) as rms, len(list_filter(embedding, lambda x: abs(x) >= 0.3))::int as loud from embeddings")
def sup_27_signal_statistics(spark: SparkSession, d: str) -> DataFrame:
    from cadenza.functions.scalar import norm

    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(F.transform(e, lambda x: F.abs(x))).cast("double"), 6).alias("peak"), six(norm(e) / 8.0, "rms"), F.size(F.filter(e, lambda x: F.abs(x) >= F.lit(0.3).cast("float"))).alias("loud"))


@R("with e as (select a.vec_id, unnest(a.embedding)::double as x, unnest(b.embedding)::double as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 where a.vec_id % 2 = 0) select vec_id, round(sqrt(avg((x - y) * (x - y))), 6) as rmse, round(max(abs(x - y)), 6) as largest, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) as cosine from e group by 1")
def sup_28_waveform_comparison(spark: SparkSession, d: str) -> DataFrame:
    from cadenza.functions.scalar import cosine

    e = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 2).alias("p")).agg(F.max(F.when(F.col("vec_id") % 2 == 0, F.col("embedding"))).alias("a"), F.max(F.when(F.col("vec_id") % 2 == 1, F.col("embedding"))).alias("b")).where("a is not null and b is not null")
    gap = F.zip_with("a", "b", lambda x, y: x.cast("double") - y.cast("double"))
    return e.select((F.col("p") * 2).alias("vec_id"), six(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda t, v: t + v * v) / 64), "rmse"), six(F.array_max(F.transform(gap, lambda v: F.abs(v))), "largest"), six(cosine(F.col("a"), F.col("b")), "cosine"))


@R(f"with {C}, x as (select {FOLD} as shard, lpad(id::varchar, 12, '0') as pid from c) select shard, count(*) as rows, {SET_DIGEST.format('pid')} as id_hash from x group by 1")
def sup_29_hashed_shards(spark: SparkSession, d: str) -> DataFrame:
    x = cohort(spark, d).select(hash_fold(F.col("group_id")).alias("shard"), F.lpad(F.col("id").cast("string"), 12, "0").alias("pid"))
    return set_digest(x, ["shard"], "pid", "id_hash", "rows")


@R("select role, count(*) as rows, count(distinct group_id) filter (n > 1) as leaked_groups from (select role, group_id, id from drive_sources) d join (select group_id as g, count(distinct role) n from drive_sources group by 1) x on x.g is not distinct from d.group_id group by 1")
def sup_30_role_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Groups are summed first; a missing group is no group, so its rows are counted and can't leak."""
    g = table(spark, d, "drive_sources").groupBy("role", "group_id").agg(F.count(F.lit(1)).alias("m"))
    n = g.where("group_id is not null").groupBy("group_id").agg(F.count(F.lit(1)).alias("all_roles"), F.count("role").alias("n"))
    one = lambda x: x.groupBy("role").agg(F.sum("m").alias("m"), F.sum("leak").alias("leak"))
    known = one(g.where("group_id is not null").join(n, "group_id").withColumn("leak", (F.col("n") > 1).cast("bigint")))
    return known.unionAll(one(g.where("group_id is null").withColumn("leak", F.lit(0).cast("bigint")))).groupBy("role").agg(F.sum("m").alias("rows"), F.sum("leak").alias("leaked_groups"))


IV = "iv as (select user_id, source_group, value * 20 as s, value * 20 + k + 1 as e from c)"


@R(f"with {C}, {IV}, x as (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) m from iv), g as (select *, sum(case when s < m then 0 else 1 end) over (partition by user_id order by s, e rows unbounded preceding) g from x), z as (select user_id, g, min(s) s, max(e) e, count(*) n from g group by 1, 2) select user_id, count(*) as merged, sum(n)::bigint as events, round(sum(e - s), 6) as covered from z group by 1")
def sup_31_merged_events(spark: SparkSession, d: str) -> DataFrame:
    iv = cohort(spark, d).select("user_id", (F.col("value") * 20).alias("s"), (F.col("value") * 20 + F.col("k") + 1).alias("e"))
    z = q.merge_intervals(iv, ["user_id"], "s", "e")
    return z.groupBy("user_id").agg(F.count(F.lit(1)).alias("merged"), F.sum("parts").alias("events"), six(F.sum(F.col("end") - F.col("start")), "covered"))


@R("select id, f as name, f is not null as ok from (select id, unnest(verification.mismatched_feature_names) as f from drive_sources where verification is not null)")
def sup_32_nested_flattening(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "drive_sources").where("verification is not null").select("id", F.explode("verification.mismatched_feature_names").alias("name"))
    return t.select("id", "name", F.col("name").isNotNull().alias("ok"))


@R("select id, coalesce(nullif(trim(provenance.title), ''), nullif(trim(provenance.source_archive_member), ''), id) as title, coalesce(provenance.artist, source_group) as artist from drive_sources")
def sup_33_first_present(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(spark, d, "drive_sources").select("id", F.coalesce(text("provenance.title"), text("provenance.source_archive_member"), "id").alias("title"), F.coalesce("provenance.artist", "source_group").alias("artist"))


@R(f"with {C}, f as (select {FOLD} as fold, source_group, count(*) n from c group by 1, 2) select source_group, min(n) as least, max(n) as most from f group by 1")
def sup_34_quantity_ranges(spark: SparkSession, d: str) -> DataFrame:
    return with_fold(cohort(spark, d)).groupBy("fold", "source_group").agg(F.count(F.lit(1)).alias("n")).groupBy("source_group").agg(F.min("n").alias("least"), F.max("n").alias("most"))


@R(f"select split, count(*) as rows, ids, count(distinct group_id) as groups, count(distinct component_id) as components, id_hash from drive_sources join (select split as s, count(*) as ids, {SET_DIGEST.format('id')} as id_hash from (select distinct split, id from drive_sources where id is not null) group by 1) x on x.s is not distinct from split group by 1, 3, 6")
def sup_35_split_record(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "drive_sources")
    n = t.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("group_id").alias("groups"), F.count_distinct("component_id").alias("components"))
    h = set_digest(t.select(F.col("split").alias("s"), "id"), ["s"], "id", "id_hash", "ids")
    return n.join(h, F.col("split").eqNullSafe(F.col("s"))).select("split", "rows", "ids", "groups", "components", "id_hash")  # a row per split on both sides


@R("select distinct id, round(('0x' || substr(sha256(id), 1, 16))::ubigint::double / 18446744073709551615.0 * greatest(canonical.native_frames::double / canonical.native_sample_rate_hz - 30, 0), 3) as start_s from drive_sources where canonical.native_frames is not null and canonical.native_sample_rate_hz is not null")
def sup_36_crop_start(spark: SparkSession, d: str) -> DataFrame:
    length = F.col("canonical.native_frames") / F.col("canonical.native_sample_rate_hz")
    return table(spark, d, "drive_sources").where("canonical.native_frames is not null and canonical.native_sample_rate_hz is not null").select("id", F.round(stable_fraction(F.col("id")) * F.greatest(length - 30, F.lit(0.0)), 3).alias("start_s")).distinct()


FR = "fr as (select user_id, id, value, k, row_number() over (partition by user_id order by ts, id) - 1 as n, k % 11 <> 0 as v from c)"


def _frames(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "id")) - 1
    return cohort(spark, d).select("user_id", "id", "value", "k", n.cast("bigint").alias("n"), (F.col("k") % 11 != 0).alias("v"))


@R()
def str_01_running_decode(spark: SparkSession, d: str) -> DataFrame:
    """Blocks in order to the end, per recording of bounded length: frames, digest of all and a bounded capture."""
    import hashlib

    def kernel(x: np.ndarray) -> list[dict]:
        h, frames, cap = hashlib.sha256(), 0, []
        for b in np.split(x, range(64, len(x), 64)):
            h.update(b.astype("<f8").tobytes())
            cap += b[max(0, 100 - frames) : max(0, 200 - frames)].tolist() if frames < 200 else []
            frames += len(b)
        return [{"frames": frames, "digest": h.hexdigest(), "captured": len(cap)}]

    return s.produce(recordings(spark, d), "recording", ["x"], kernel, "frames bigint, digest string, captured int")


@R("select label::varchar || '-' || (vec_id // 500)::varchar as recording, true as same from embeddings group by 1")
def str_02_two_pass_equality(spark: SparkSession, d: str) -> DataFrame:
    a, b = str_01_running_decode(spark, d), str_01_running_decode(spark, d).select("recording", F.col("digest").alias("again"))
    return a.join(b, "recording").select("recording", (F.col("digest") == F.col("again")).alias("same"))


@R(f"with {C}, {FR} select user_id, (n // 16)::bigint as block, round(sum(value), 6) as total from fr group by 1, 2 having count(*) = 16")
def str_03_whole_blocks(spark: SparkSession, d: str) -> DataFrame:
    x = _frames(spark, d).groupBy("user_id", F.floor(F.col("n") / 16).alias("block")).agg(six(F.sum("value"), "total"), F.count(F.lit(1)).alias("m"))
    return x.where("m = 16").drop("m")


@R(f"with {C}, {FR}, w as (select user_id, value, unnest([n // 4, n // 4 - 1]) as hop from fr) select user_id, hop::bigint as hop, round(avg(value), 6) as mean from w where hop >= 0 group by 1, 2 having count(*) = 8")
def str_04_hopping_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of eight every four: each row is in two of them."""
    h = F.floor(F.col("n") / 4)
    x = _frames(spark, d).select("user_id", "value", F.explode(F.array(h, h - 1)).alias("hop")).where("hop >= 0")
    return x.groupBy("user_id", "hop").agg(six(F.avg("value"), "mean"), F.count(F.lit(1)).alias("m")).where("m = 8").drop("m")


@R(f"with {C}, {FR}, s as (select user_id, n, v, lag(v) over w as pv, value - lag(value) over w as step from fr window w as (partition by user_id order by n)) select user_id, count(*) filter (v and pv) as steps, round(sum(abs(step)) filter (v and pv), 6) as path from s group by 1")
def str_05_no_bridging(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("n")
    x = _frames(spark, d).select("user_id", (F.col("v") & F.lag("v").over(w)).alias("ok"), F.abs(F.col("value") - F.lag("value").over(w)).alias("step"))
    return x.groupBy("user_id").agg(F.count_if("ok").alias("steps"), six(F.sum(F.when(F.col("ok"), F.col("step"))), "path"))


@R("with done as (select id, bool_or(validation_status = 'verified') as ok from drive_sources group by 1), m as (select distinct id from sample_reference_features) select m.id from m left join done using (id) where not coalesce(ok, false)")
def str_06_resume(spark: SparkSession, d: str) -> DataFrame:
    """What is still to do: items without a verified receipt; failures stay."""
    done = table(spark, d, "drive_sources").where("validation_status = 'verified'").select("id")
    return table(spark, d, "sample_reference_features").select("id").distinct().join(done, "id", "left_anti")


@R("with r as (select *, row_number() over (partition by id order by loaded_at desc, measured_at desc, load_id desc, feature_file_sha256 desc) o from sample_reference_features where id is not null) select id, load_id from r where o = 1")
def str_07_latest_state(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "sample_reference_features").where("id is not null")
    return t.groupBy("id").agg(F.max(F.struct("loaded_at", "measured_at", "load_id", "feature_file_sha256")).alias("s")).select("id", F.col("s.load_id").alias("load_id"))


@R(f"""with {C}, j as (select user_id, id, epoch_us(ts) / 1e6::double as t, value as sec from c), l as (select user_id, list({{'ends': []::double[], 'out': []::struct(id bigint, outcome varchar)[], 't': t, 'sec': sec, 'id': id}} order by t, id) as e from j group by 1),
  r as (select user_id, list_reduce(list_concat([{{'ends': []::double[], 'out': []::struct(id bigint, outcome varchar)[], 't': 0.0::double, 'sec': 0.0::double, 'id': 0::bigint}}], e), lambda a, x: {{'ends': case when len(list_filter(a.ends, lambda v: v > x.t)) >= 2 then list_filter(a.ends, lambda v: v > x.t) else list_append(list_filter(a.ends, lambda v: v > x.t), x.t + least(x.sec * 60, 3600)) end,
    'out': list_append(a.out, {{'id': x.id, 'outcome': case when len(list_filter(a.ends, lambda v: v > x.t)) >= 2 then 'rejected' else 'admitted' end}}), 't': x.t, 'sec': x.sec, 'id': x.id}}).out as o from l)
  select user_id, u.id as id, u.outcome as outcome from (select user_id, unnest(o) as u from r)""")
def str_09_job_registry(spark: SparkSession, d: str) -> DataFrame:
    """Jobs with expiry and bounded admission, replayed in order of time per user."""
    from cadenza.streaming.jobs import replay_jobs

    return replay_jobs(cohort(spark, d).select("user_id", "id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("value").alias("seconds")), slots=2, ttl=3600.0)


@R("""with r as (select id, source_group, min(recorded_at) as r, min(ingested_at) as i, bool_or(validation_status = 'verified') as ok from drive_sources where id is not null group by 1, 2), n as (select source_group, strftime(i, '%Y-%m-%d') as day, count(*) as ingested, count(*) filter (ok) as verified from r where i is not null group by 1, 2), t as (select source_group, count(*) as expected from r group by 1)
  select source_group, day, expected, (sum(ingested) over w)::bigint as ingested, (sum(verified) over w)::bigint as verified, round(sum(ingested) over w / expected::double, 6) as share from n join t using (source_group) window w as (partition by source_group order by day rows unbounded preceding)""")
def str_10_progress(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of a staged materialisation at the end of each day: what of each source had come in and been verified. The window runs over days, not records."""
    x = table(spark, d, "drive_sources").where("id is not null").groupBy("id", "source_group").agg(F.min("ingested_at").alias("i"), F.bool_or(F.col("validation_status") == "verified").alias("ok"))
    n = x.where("i is not null").groupBy("source_group", F.date_format("i", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("v"))
    w = W.partitionBy("source_group").orderBy("day")
    y = n.join(x.groupBy("source_group").agg(F.count(F.lit(1)).alias("expected")), "source_group").withColumns({"ingested": F.sum("n").over(w), "verified": F.sum("v").over(w)})
    return y.select("source_group", "day", "expected", "ingested", "verified", six(F.col("ingested") / F.col("expected"), "share"))
