"""Queries of joins (JN)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.operators import relational as r
from cadenza.operators.metrics import six
from cadenza.queries._cohort import C, cohort
from cadenza.queries.aggregates import FOLD, with_fold
from cadenza.registry import Registry
from cadenza.session import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


@R("select id, max(load_id)::int as load_id, count(f.fid) as measured from (select distinct id, role from drive_sources where role = 'locked') d left join (select distinct id as fid, load_id from sample_reference_features) f on f.fid = d.id group by 1")
def jn_01_left_join(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "drive_sources").where("role = 'locked'").select("id").distinct()
    f = table(spark, d, "sample_reference_features").select("id", "load_id").distinct()
    return a.join(f, "id", "left").groupBy("id").agg(F.max("load_id").alias("load_id"), F.count("load_id").alias("measured"))


@R("""with o as (select o_custkey as k, round(sum(o_totalprice), 2) as v, count(*)::double as n from orders where o_orderkey % 2 = 0 group by 1), p as (select o_custkey as k, round(sum(o_totalprice), 2) as v, count(*)::double as n from orders where o_orderkey % 2 = 1 or o_orderkey % 3 = 0 group by 1)
  select k, round(coalesce(o.v, p.v), 2) as v, coalesce(o.n, p.n) as n, (case when abs(o.v - p.v) > 1e-6 + 1e-9 * abs(p.v) then 1 else 0 end + case when abs(o.n - p.n) > 1e-6 + 1e-9 * abs(p.n) then 1 else 0 end)::int as conflicts from o full join p using (k)""")
def jn_02_coalescing_full_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders of even keys against those of odd keys or keys divisible by three."""
    o = table(spark, d, "orders")
    side = lambda rows: o.where(rows).groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"), F.count(F.lit(1)).cast("double").alias("n"))
    return r.coalescing_join(side("o_orderkey % 2 = 0"), side("o_orderkey % 2 = 1 or o_orderkey % 3 = 0"), "k", ["v", "n"], atol=1e-6)


@R(f"with {C} select group_id, round(h.m, 6) as human_mean, round(a.m, 6) as ai_mean from (select group_id, avg(score) m from c where label = 0 group by 1) h join (select group_id, avg(score) m from c where label = 1 group by 1) a using (group_id)")
def jn_03_two_arms(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).groupBy("group_id").agg(F.avg(F.when(F.col("label") == 0, F.col("score"))).alias("h"), F.avg(F.when(F.col("label") == 1, F.col("score"))).alias("a"))
    return c.where("h is not null and a is not null").select("group_id", six("h", "human_mean"), six("a", "ai_mean"))


@R("select s_suppkey, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def jn_04_many_to_one(spark: SparkSession, d: str) -> DataFrame:
    n = r.require_unique(table(spark, d, "nation"), ["n_nationkey"])
    g = r.require_unique(table(spark, d, "region"), ["r_regionkey"])
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@R(f"""with {C}, f as (select source_group, {FOLD} as fold, role, k % 2 as arm, avg(score) s, avg(f1) v from c group by 1, 2, 3, 4) select b.source_group, b.fold, b.role, round(a.s - b.s, 6) as delta_s, round(a.v - b.v, 6) as delta_v from f b join f a using (source_group, fold, role) where b.arm = 0 and a.arm = 1""")
def jn_05_matched_deltas(spark: SparkSession, d: str) -> DataFrame:
    f = with_fold(cohort(spark, d)).groupBy("source_group", "fold", "role", (F.col("k") % 2).alias("arm")).agg(F.avg("score").alias("s"), F.avg("f1").alias("v"))
    return r.matched_deltas(f, ["source_group", "fold", "role"], "arm", 0, 1, ["s", "v"]).select("source_group", "fold", "role", six("delta_s", "delta_s"), six("delta_v", "delta_v"))


@R(f"""with {C}, s as (select source_group, {FOLD} as fold, avg(score) filter (k < 50) prior, avg(score) allv from c where role = 'development' group by 1, 2) select source_group, count(*) as folds, round(avg(allv - prior), 6) as mean_gain, count(*) filter (allv > prior) as better from s where prior is not null group by 1""")
def jn_06_training_scopes(spark: SparkSession, d: str) -> DataFrame:
    s = with_fold(cohort(spark, d).where("role = 'development'")).groupBy("source_group", "fold").agg(F.avg(F.when(F.col("k") < 50, F.col("score"))).alias("p"), F.avg("score").alias("a")).where("p is not null")
    return s.groupBy("source_group").agg(F.count(F.lit(1)).alias("folds"), six(F.avg(F.col("a") - F.col("p")), "mean_gain"), F.count_if(F.col("a") > F.col("p")).alias("better"))


@R("select l_orderkey, count(*) as lines, any_value(o_custkey) as custkey from lineitem join orders on l_orderkey = o_orderkey where l_shipdate >= timestamp '1998-01-01' group by 1")
def jn_07_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary lookup that fails on a missing key."""
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    x = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines")).join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return x.select("l_orderkey", "lines", F.when(F.col("o_orderkey").isNotNull(), F.col("o_custkey")).otherwise(F.raise_error(F.lit("unknown order")).cast("bigint")).alias("custkey"))


@R("select c_custkey, c_mktsegment from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P') and c_custkey not in (select o_custkey from orders where o_totalprice > 450000)")
def jn_08_semi_and_anti(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    key = lambda x: x.select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(key(o.where("o_orderstatus = 'P'")), "c_custkey", "left_semi").join(key(o.where("o_totalprice > 450000")), "c_custkey", "left_anti")


@R(f"""with {C}, f as (select *, {FOLD} as fold from c), t as (select * from f where fold = 0), h as (select distinct component_id from f where source_group = 'click' or fold = 0)
  select source_group, count(*) as train_rows, count(distinct group_id) as train_groups from f where fold <> 0 and source_group <> 'click' and group_id not in (select group_id from t) and component_id not in (select component_id from h) group by 1""")
def jn_09_leakage_purge(spark: SparkSession, d: str) -> DataFrame:
    f = with_fold(cohort(spark, d))
    test = f.where("fold = 0")
    held = f.where("source_group = 'click' or fold = 0").select("component_id")
    train = f.where("fold <> 0 and source_group <> 'click'").join(test.select("group_id"), "group_id", "left_anti").join(held, "component_id", "left_anti")
    return train.groupBy("source_group").agg(F.count(F.lit(1)).alias("train_rows"), F.count_distinct("group_id").alias("train_groups"))


@R(f"with {C}, h as (select source_group as human_source, count(*) hn from c where label = 0 group by 1), a as (select source_group as ai_source, count(*) an from c where label = 1 group by 1) select human_source, ai_source, hn as human_rows, an as ai_rows from h, a where hn >= an / 4")
def jn_10_source_pair_theta(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of sources (a handful) under a theta condition."""
    side = lambda y, s, n: cohort(spark, d).where(F.col("label") == y).groupBy(F.col("source_group").alias(s)).agg(F.count(F.lit(1)).alias(n))
    return side(0, "human_source", "human_rows").join(side(1, "ai_source", "ai_rows"), F.col("human_rows") >= F.col("ai_rows") / 4)


@R(f"""with {C}, s as (select distinct source_group, {FOLD} as fold, unnest(['25', '100', 'all']) as cap from c), m as (select unnest(['S', 'S+D', 'S+D+R']) as combination), o as (select unnest(['values_plus_missing', 'median_only', 'missingness_only']) as mode)
  select source_group, fold, cap, combination, mode from s, m, o where mode = 'values_plus_missing' or cap = 'all'""")
def jn_11_schedule_cells(spark: SparkSession, d: str) -> DataFrame:
    """Schedule cells by combinations and modes; diagnostics only where all rows train. Fixed lists are expanded in place."""
    x = with_fold(cohort(spark, d)).select("source_group", "fold").distinct()
    wide = lambda n, v: F.explode(F.array(*[F.lit(e) for e in v])).alias(n)
    x = x.select("*", wide("cap", ["25", "100", "all"])).select("*", wide("combination", ["S", "S+D", "S+D+R"])).select("*", wide("mode", ["values_plus_missing", "median_only", "missingness_only"]))
    return x.where("mode = 'values_plus_missing' or cap = 'all'")


SHA = "regexp_replace(lower(trim(sha256, ' ' || chr(10))), '^sha256:', '')"


@R(f"""with g as (select distinct path, {SHA} as sha from generated_cleanup where sha256 is not null), x as (select sha, count(*) n, string_agg(path, '|' order by path) as paths from g group by 1) select sha, n as copies, paths, n > 1 as matched from x""")
def jn_12_byte_identity(spark: SparkSession, d: str) -> DataFrame:
    sha = F.regexp_replace(F.lower(F.trim(F.regexp_replace("sha256", "\n", ""))), "^sha256:", "")
    g = table(spark, d, "generated_cleanup").where("sha256 is not null").select("path", sha.alias("sha")).distinct()
    # A digest's list of paths is the result asked for; the empty file's is as long as there are empty files.
    return g.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.array_join(F.array_sort(F.collect_list("path")), "|").alias("paths"), (F.count(F.lit(1)) > 1).alias("matched"))


@R("""with t as (select doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as norm from documents where text is not null), b as (select doc_id as item, norm from t where doc_id % 100 = 0 and length(norm) >= 32)
  select t.doc_id, b.item, t.norm = b.norm as exact from t join b on (t.norm = b.norm or contains(t.norm, b.norm)) and t.doc_id <> b.item""")
def jn_13_text_containment(spark: SparkSession, d: str) -> DataFrame:
    """Every row against the stated queries (ids divisible by 100): equal or containing the query's text of 32 characters or more."""
    norm = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    t = table(spark, d, "documents").where("text is not null").select("doc_id", norm.alias("norm"))
    q = t.where("doc_id % 100 = 0").select(F.col("doc_id").alias("item"), F.col("norm").alias("query"))
    return r.containing(t, q, "doc_id", "norm").where("doc_id <> item")


SEG = "seg as (select user_id, value * 10 as s, value * 10 + k as e, id from c where k > 0), pt as (select user_id, (value * 10) + (id % 7) as t, id as pid from c)"


@R(f"with {C}, {SEG} select pid, seg.id as segment from pt join seg on pt.user_id = seg.user_id and t >= s and t < e")
def jn_14_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Every row as a point, every row of k > 0 as an interval."""
    c = cohort(spark, d)
    seg = c.where("k > 0").select("user_id", (F.col("value") * 10).alias("s"), (F.col("value") * 10 + F.col("k")).alias("e"), F.col("id").alias("segment"))
    pt = c.select("user_id", (F.col("value") * 10 + F.col("id") % 7).alias("t"), F.col("id").alias("pid"))
    return r.interval_join(pt, seg, ["user_id"], "t", "s", "e", 64.0).select("pid", "segment")


@R(f"""with {C}, x as (select user_id, epoch_us(ts) / 1e6::double / 60 as t, id from c), r as (select user_id, t, row_number() over (partition by user_id order by t) as i from x where id % 2 = 0), p as (select user_id, t, row_number() over (partition by user_id order by t) as j from x where id % 2 = 1),
  m as (select r.user_id, i, j, r.t as a, p.t as b from r join p on p.user_id = r.user_id and abs(r.t - p.t) <= 10 + 1e-12), l as (select user_id, list({{'ri': []::bigint[], 'pj': []::bigint[], 'out': []::struct(a double, b double)[], 'i': i, 'j': j, 'a': a, 'b': b}} order by abs(a - b), i, j) as e from m group by 1),
  z as (select user_id, list_reduce(list_concat([{{'ri': []::bigint[], 'pj': []::bigint[], 'out': []::struct(a double, b double)[], 'i': 0::bigint, 'j': 0::bigint, 'a': 0.0::double, 'b': 0.0::double}}], e), lambda s, x: case when list_contains(s.ri, x.i) or list_contains(s.pj, x.j) then s
    else {{'ri': list_append(s.ri, x.i), 'pj': list_append(s.pj, x.j), 'out': list_append(s.out, {{'a': x.a, 'b': x.b}}), 'i': x.i, 'j': x.j, 'a': x.a, 'b': x.b}} end).out as o from l)
  select user_id, u.a as t_reference, u.b as t_predicted from (select user_id, unnest(o) as u from z)""")
def jn_15_event_matching(spark: SparkSession, d: str) -> DataFrame:
    """Even against odd rows of a recording, nearest pairs first."""
    c = cohort(spark, d).select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 60).alias("t"), "id")
    return r.match_events(c.where("id % 2 = 0"), c.where("id % 2 = 1"), "user_id", "t", 10.0)


@R()
def jn_16_overlap_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Events matched one to one, as many as possible, among pairs that overlap and begin within a tolerance."""
    c = cohort(spark, d).select("user_id", "id", F.col("f4").alias("s"), (F.col("f4") + F.col("k") / 20).alias("e"))
    a, b = c.where("id % 2 = 0"), c.where("id % 2 = 1").select("user_id", F.col("id").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    near = a.withColumn("w", F.explode(F.sequence(F.floor(F.col("s") / 2) - 1, F.floor(F.col("s") / 2) + 1))).join(b.withColumn("w", F.floor(F.col("s2") / 2)), ["user_id", "w"])
    near = near.where("abs(s - s2) <= 1.0 and s < e2 and s2 < e").select("user_id", F.col("id").alias("a"), "b").distinct()
    return r.quota_matching(near, "user_id")


@R()
def jn_17_quota_matching(spark: SparkSession, d: str) -> DataFrame:
    """Each human row of a group gets at most one generated row of its k within ten, each used once."""
    c = cohort(spark, d).select("user_id", "id", "label", F.floor(F.col("k") / 10).alias("b"))
    near = c.where("label = 0").select("user_id", "b", F.col("id").alias("a")).join(c.where("label = 1").select("user_id", "b", F.col("id").alias("b_id")), ["user_id", "b"])
    return r.quota_matching(near.select("user_id", "a", F.col("b_id").alias("b")), "user_id")


@R(f"""with {C}, s as (select user_id, t, avg(v) as v, bool_and(ok) as ok from (select user_id, (id % 500)::double as t, 100 + value as v, k % 4 <> 0 as ok from c) group by 1, 2), n as (select *, lead(t) over w as t2, lead(v) over w as v2, lead(ok) over w as ok2 from s window w as (partition by user_id order by t)),
  g as (select distinct user_id, (id % 250 * 2 + 0.5)::double as t from c)
  select g.user_id, g.t, round(case when n.ok and n.ok2 then n.v + (n.v2 - n.v) * (g.t - n.t) / (n.t2 - n.t) end, 6) as v from g left join n on n.user_id = g.user_id and n.t < g.t and n.t2 > g.t""")
def jn_18_asof_interpolation(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d)
    s = c.groupBy("user_id", (F.col("id") % 500).cast("double").alias("t")).agg(F.avg(100 + F.col("value")).alias("v"), F.bool_and(F.col("k") % 4 != 0).alias("ok"))
    g = c.select("user_id", (F.col("id") % 250 * 2 + 0.5).cast("double").alias("t")).distinct()
    return r.asof_interpolate(g, s, "user_id", "t", "v", "ok").select("user_id", "t", six("v", "v"))


@R(f"""with {C}, b as (select distinct user_id, value as t from c), m as (select user_id, t, row_number() over (partition by user_id order by t) - 1 as i from (select distinct user_id, (k * 1.5)::double as t from c)), x as (select b.user_id, b.t, m.i, row_number() over (partition by b.user_id, b.t order by abs(b.t - m.t), m.i) as r from b join m using (user_id))
  select user_id, t, i from x where r = 1""")
def jn_19_nearest_snap(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d)
    b = c.select("user_id", F.col("value").alias("t")).distinct()
    m = c.select("user_id", (F.col("k") * 1.5).cast("double").alias("t")).distinct().withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy("t")) - 1)
    return r.nearest(b, m, "user_id", "t", "i")


@R(f"with {C} select a.id as id, count(*) as partners, min(b.id) as first_partner from c a join c b on a.user_id = b.user_id and a.id < b.id and b.k - a.k >= 20 and b.score - a.score >= 0.1 group by 1")
def jn_20_pairs_within_source(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within a recording under gap conditions: a row per record with the number of its later partners and the first; pairs are counted where they are met."""
    p = cohort(spark, d).select("user_id", "id", "k", "score")
    b = p.select("user_id", F.col("id").alias("b"), F.col("k").alias("k2"), F.col("score").alias("s2"))
    return p.join(b, "user_id").where("id < b and k2 - k >= 20 and s2 - score >= 0.1").groupBy("id").agg(F.count(F.lit(1)).alias("partners"), F.min("b").alias("first_partner"))


@R(f"""with {C}, a as (select user_id, value as s, row_number() over (partition by user_id order by ts, id) as n from c where id % 2 = 0), b as (select user_id, value as s, row_number() over (partition by user_id order by ts, id) as n from c where id % 2 = 1)
  select user_id, count(*) as rows, count(*) filter (abs(a.s - b.s) <= 5) as close, (max(abs(a.s - b.s)) <= 5) as same from a join b using (user_id, n) group by 1""")
def jn_21_row_zip(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "id"))
    side = lambda k: cohort(spark, d).where(F.col("id") % 2 == k).select("user_id", F.col("value").alias(f"s{k}"), n.alias("n"))
    gap = F.abs(F.col("s0") - F.col("s1"))
    return side(0).join(side(1), ["user_id", "n"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(gap <= 5).alias("close"), (F.max(gap) <= 5).alias("same"))


@R(f"""with g as (select distinct path, bytes, {SHA} as sha from generated_cleanup where sha256 is not null and bytes > 0), n as (select sha, bytes, count(*) n, min(path) as path from g group by 1, 2) select sha, bytes, case when n = 1 then path end as resolved, n as candidates from n""")
def jn_22_checksum_resolution(spark: SparkSession, d: str) -> DataFrame:
    sha = F.regexp_replace(F.lower(F.trim(F.regexp_replace("sha256", "\n", ""))), "^sha256:", "")
    g = table(spark, d, "generated_cleanup").where("sha256 is not null and bytes > 0").select("path", "bytes", sha.alias("sha")).distinct()
    n = g.groupBy("sha", "bytes").agg(F.count(F.lit(1)).alias("candidates"), F.min("path").alias("path"))
    return n.select("sha", "bytes", F.when(F.col("candidates") == 1, F.col("path")).alias("resolved"), "candidates")


@R("""with m as (select distinct id from drive_sources), f as (select distinct id from sample_reference_features), j as (select coalesce(m.id, f.id) as id, m.id is not null as media, f.id is not null as measured from m full join f on m.id = f.id)
  select split_part(id, '_', 1) as kind, media, measured, count(*) as n from j group by 1, 2, 3""")
def jn_23_identity_join(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "drive_sources").select("id", F.lit(True).alias("media")).distinct()
    f = table(spark, d, "sample_reference_features").select("id", F.lit(True).alias("measured")).distinct()
    j = m.join(f, "id", "full").select(F.substring_index("id", "_", 1).alias("kind"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("media", "measured")])
    return j.groupBy("kind", "media", "measured").agg(F.count(F.lit(1)).alias("n"))


@R("""with p as (select doc_id, sample_id, kind from documents where sample_id is not null), s as (select distinct id, source_group, 'human_' || source_group || '_' || right(id, 16) as h, 'ai_' || source_group || '_' || right(id, 16) as a from drive_sources)
  select p.doc_id, s.source_group, p.sample_id = s.a as generated from p join s on p.sample_id in (s.h, s.a) and s.id = p.sample_id""")
def jn_24_constructed_keys(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "drive_sources").select("id", "source_group").distinct()
    tail = F.concat_ws("_", "source_group", F.substring("id", -16, 16))
    s = s.select("source_group", F.col("id").alias("sample_id"), F.concat(F.lit("ai_"), tail).alias("a"), F.concat(F.lit("human_"), tail).alias("h")).where("sample_id in (a, h)")
    p = table(spark, d, "documents").where("sample_id is not null").select("doc_id", "sample_id")
    return p.join(s, "sample_id").select("doc_id", "source_group", (F.col("sample_id") == F.col("a")).alias("generated"))


@R("""with f as (select distinct id from sample_reference_features where features is not null), s as (select distinct id, role from drive_sources), o as (select distinct sample_id as id from documents where sample_id is not null)
  select s.role, f.id is not null as measured, o.id is not null as described, count(*) as n from s left join f on f.id = s.id left join o on o.id = s.id group by 1, 2, 3""")
def jn_25_status_counts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "sample_reference_features").where("features is not null").select("id", F.lit(True).alias("measured")).distinct()
    o = table(spark, d, "documents").where("sample_id is not null").select(F.col("sample_id").alias("id"), F.lit(True).alias("described")).distinct()
    s = table(spark, d, "drive_sources").select("id", "role").distinct().join(f, "id", "left").join(o, "id", "left")
    return s.groupBy("role", F.coalesce("measured", F.lit(False)).alias("measured"), F.coalesce("described", F.lit(False)).alias("described")).agg(F.count(F.lit(1)).alias("n"))
