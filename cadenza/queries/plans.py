"""Queries of sets, graphs, folds and schedules (SET, GRF, FLD)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.hashing import hash_fold, rank_key, stable_fraction
from cadenza.operators import graph, relational
from cadenza.operators.metrics import six
from cadenza.plans import schedule
from cadenza.queries._cohort import C, cohort
from cadenza.queries.aggregates import FOLD, with_fold
from cadenza.registry import Registry
from cadenza.session import cut, table, with_running_total

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
FAMILIES = ["S", "D", "R", "P", "F", "H", "SC"]
#: Components over group and component ids: the reach of each node, for DuckDB.
ROOTS = """n as (select id, 'group:' || group_id as node from c union select id, 'component:' || component_id from c), e as (select distinct a.node as u, b.node as v from n a join n b using (id)),
  reach(u, v) as (select u, v from e union select r.u, e.v from reach r join e on e.u = r.v), roots as (select u as node, min(v) as root from reach group by 1)"""


@R(f"with {C} select id, 'events' as origin, score, f2 as extra from c union all select vec_id, 'embeddings', null, label::double from embeddings")
def set_01_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = cohort(spark, d).select("id", F.lit("events").alias("origin"), "score", F.col("f2").alias("extra"))
    b = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("embeddings").alias("origin"), F.col("label").cast("double").alias("extra"))
    return a.unionByName(b, allowMissingColumns=True)


@R(f"with {C} select id, 'first' as origin, score from c where k < 30 union all select id, 'second', 1 - score from c where k >= 20 and id not in (select id from c where k < 30)")
def set_02_union_with_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Two tables that overlap and together are all rows: the first one's rows, then what only the second has."""
    c = cohort(spark, d)
    a = c.where("k < 30").select("id", F.lit("first").alias("origin"), "score")
    b = c.where("k >= 20").select("id", F.lit("second").alias("origin"), (1 - F.col("score")).alias("score"))
    return a.unionAll(b.join(a.select("id"), "id", "left_anti"))


@R("select id, string_agg(distinct scope, ',' order by scope) as scopes from (select id, 'manifest' as scope from drive_sources union all select id, 'measured' from sample_reference_features union all select sample_id, 'described' from documents where sample_id is not null) group by 1")
def set_03_membership_union(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, c, s: table(spark, d, t).select(F.col(c).alias("id"), F.lit(s).alias("scope"))
    u = one("drive_sources", "id", "manifest").unionAll(one("sample_reference_features", "id", "measured")).unionAll(one("documents", "sample_id", "described").where("id is not null"))
    return u.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("scope")), ",").alias("scopes"))


@R("with a as (select distinct id from drive_sources), b as (select distinct id from sample_reference_features), c as (select distinct sample_id as id from documents where sample_id is not null) select (select count(*) from (select id from a intersect select id from b)) as measured, (select count(*) from (select id from a except select id from b)) as unmeasured, (select count(*) from (select id from b except select id from a)) as unknown, (select count(*) from (select id from a intersect select id from c)) as described")
def set_04_overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of intersections and differences of id sets, from one aggregation of memberships."""
    one = lambda t, c, s: table(spark, d, t).select(F.col(c).alias("id"), F.lit(s).alias("s"))
    u = one("drive_sources", "id", 1).unionAll(one("sample_reference_features", "id", 2)).unionAll(one("documents", "sample_id", 4)).where("id is not null")
    m = u.groupBy("id").agg(F.bit_or("s").alias("m"))
    bit = lambda b: F.col("m").bitwiseAND(b) > 0
    return m.agg(F.count_if(bit(1) & bit(2)).alias("measured"), F.count_if(bit(1) & ~bit(2)).alias("unmeasured"), F.count_if(bit(2) & ~bit(1)).alias("unknown"), F.count_if(bit(1) & bit(4)).alias("described"))


@R("with a as (select distinct id from drive_sources where role = 'locked'), b as (select distinct id from drive_sources where split = 'test') select coalesce(a.id, b.id) as id, case when b.id is null then 'missing' else 'extra' end as status from a full join b on a.id = b.id where a.id is null or b.id is null")
def set_05_missing_and_extra(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "drive_sources")
    a, b = t.where("role = 'locked'").select("id", F.lit(1).alias("a")).distinct(), t.where("split = 'test'").select("id", F.lit(1).alias("b")).distinct()
    return a.join(b, "id", "full").where("a is null or b is null").select("id", F.when(F.col("b").isNull(), "missing").otherwise("extra").alias("status"))


@R(f"with {C}, f as (select *, {FOLD} as fold from c) select 'id' as key, count(*) as shared from (select id from f group by 1 having count(distinct fold) > 1) union all select 'group_id', count(*) from (select group_id from f group by 1 having count(distinct fold) > 1) union all select 'component_id', count(*) from (select component_id from f group by 1 having count(distinct fold) > 1)")
def set_06_disjointness(spark: SparkSession, d: str) -> DataFrame:
    f = with_fold(cohort(spark, d))
    out = None
    for k in ("id", "group_id", "component_id"):
        x = f.groupBy(k).agg(F.count_distinct("fold").alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared")).select(F.lit(k).alias("key"), "shared")
        out = x if out is None else out.unionAll(x)
    return out


@R(f"""with {C}, f as (select *, {FOLD} as fold from c), t as (select distinct group_id from f where fold = 0) select case when fold = 0 then 'test' when source_group = 'view' then 'held_source' when group_id in (select group_id from t) then 'test_group' when role = 'locked' then 'locked' else 'train' end as part, count(*) as n from f group by 1""")
def set_07_partition_accounting(spark: SparkSession, d: str) -> DataFrame:
    f = with_fold(cohort(spark, d))
    t = f.where("fold = 0").select("group_id", F.lit(True).alias("hit")).distinct()
    part = F.when(F.col("fold") == 0, "test").when(F.col("source_group") == "view", "held_source").when(F.col("hit"), "test_group").when(F.col("role") == "locked", "locked").otherwise("train")
    return f.join(t, "group_id", "left").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


@R("select id, count(*) as deliveries, max(ingested_at) - min(ingested_at) > interval 1 day as late from drive_sources group by 1 having count(*) > 1")
def set_08_repeated_deliveries(spark: SparkSession, d: str) -> DataFrame:
    us = lambda f: F.unix_micros(f("ingested_at").cast("timestamp"))
    return table(spark, d, "drive_sources").groupBy("id").agg(F.count(F.lit(1)).alias("deliveries"), ((us(F.max) - us(F.min)) > 86_400_000_000).alias("late")).where("deliveries > 1")


@R(f"with {C}, f as (select distinct source_group, {FOLD} as fold, k % 4 as repeat from c where k % 13 <> 0 or value < 20) select s.source_group, fo.fold, r.repeat from (select distinct source_group from c) s, (select unnest(range(5))::int as fold) fo, (select unnest(range(4))::int as repeat) r except select source_group, fold, repeat from f where source_group <> 'click' or fold <> 2")
def set_09_catalogue_completeness(spark: SparkSession, d: str) -> DataFrame:
    c = with_fold(cohort(spark, d))
    f = c.where("(k % 13 <> 0 or value < 20) and (source_group <> 'click' or fold <> 2)").select("source_group", "fold", (F.col("k") % 4).alias("repeat")).distinct()
    want = c.select("source_group").distinct().select("source_group", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("repeat"))
    return want.join(f, ["source_group", "fold", "repeat"], "left_anti")


POWER = "p as (select m, list_filter([case when m & (1 << i) > 0 then f[i + 1] end for i in range(len(f))], lambda x: x is not null) as fam from (select unnest(range(1, 1 << len(f))) as m, f from (select {} as f)))"


@R(f"with {POWER.format(FAMILIES)} select array_to_string(fam, '+') as combination, len(fam)::int as size from p")
def set_10_power_set(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(f) for f in FAMILIES])
    m = spark.range(1, 1 << len(FAMILIES)).select(F.filter(names, lambda _, i: F.pmod(F.floor(F.col("id") / F.pow(F.lit(2.0), i)), F.lit(2)) == 1).alias("f"))
    return m.select(F.array_join("f", "+").alias("combination"), F.size("f").alias("size"))


@R("""with o as (select unnest(['S', 'D', 'S+D']) as old), n as (select unnest(['F', 'H', 'F+H']) as new), a as (select unnest(['baseline', 'added']) as arm) select old, new, arm, case when arm = 'baseline' then old else old || '+' || new end as combination from o, n, a""")
def set_11_comparison_lattice(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(schedule.comparison_lattice(["S", "D"], ["F", "H"]), "old string, new string, arm string, combination string")


@R("""with s as (select id, max(validation_status) as status, bool_or(canonical.input_sha256 is null) as nohash from drive_sources group by 1), m as (select distinct id from sample_reference_features where features is not null)
  select case when m.id is null and nohash then 'no_digest_no_features' when m.id is null then 'not_measured' when status is null then 'not_validated' when status = 'verified' then 'done' else 'pending' end as backlog, count(*) as n from s left join m using (id) group by 1""")
def set_12_backlog(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "drive_sources").groupBy("id").agg(F.max("validation_status").alias("status"), F.bool_or(F.col("canonical.input_sha256").isNull()).alias("nohash"))
    m = table(spark, d, "sample_reference_features").where("features is not null").select("id", F.lit(True).alias("m")).distinct()
    gone = F.col("m").isNull()
    kind = F.when(gone & F.col("nohash"), "no_digest_no_features").when(gone, "not_measured").when(F.col("status").isNull(), "not_validated").when(F.col("status") == "verified", "done").otherwise("pending")
    return s.join(m, "id", "left").groupBy(kind.alias("backlog")).agg(F.count(F.lit(1)).alias("n"))


def roots(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(graph.closure_edges(cohort(spark, d), {"component": "component_id", "group": "group_id"}))


@R(f"with recursive {C}, {ROOTS} select node, root from roots")
def grf_01_closure(spark: SparkSession, d: str) -> DataFrame:
    return roots(spark, d)


@R(f"with recursive {C}, {ROOTS} select r.root, count(*) as rows, count(*) filter (role = 'locked') as locked from c join roots r on r.node = 'group:' || c.group_id group by 1 having bool_or(role = 'locked')")
def grf_02_protected_closure(spark: SparkSession, d: str) -> DataFrame:
    x = cohort(spark, d).withColumn("node", F.concat(F.lit("group:"), "group_id")).join(roots(spark, d), "node")
    return x.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("role") == "locked").alias("locked")).where("locked > 0")


SHA = "case when regexp_full_match(regexp_replace(lower(trim({}, ' ' || chr(10))), '^sha256:', ''), '[0-9a-f]{{64}}') and regexp_replace(lower(trim({}, ' ' || chr(10))), '^sha256:', '') not in ('e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855', repeat('0', 64)) then regexp_replace(lower(trim({}, ' ' || chr(10))), '^sha256:', '') end"


def digest(c) -> F.Column:
    x = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, "\n", ""))), "^sha256:", "")
    return F.when(x.rlike("^[0-9a-f]{64}$") & ~x.isin("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "0" * 64), x)


@R(f"""with recursive k as (select distinct id, {SHA.format(*['canonical.input_sha256'] * 3)} as i, {SHA.format(*['canonical.waveform_float32_sha256'] * 3)} as w from drive_sources), n as (select id, 'i:' || i as t from k where i is not null union select id, 'w:' || w from k where w is not null),
  m as (select t, min(id) as least from n group by 1), e as (select distinct n.id as u, m.least as v from n join m using (t) where n.id <> m.least), e2 as (select u, v from e union select v, u from e), reach(u, v) as (select u, v from e2 union select r.u, e2.v from reach r join e2 on e2.u = r.v)
  select u as node, min(least(u, v)) as root from reach group by 1""")
def grf_03_candidate_components(spark: SparkSession, d: str) -> DataFrame:
    """Recordings that share a file's or a waveform's digest; each digest ties its bearers to the least of them."""
    k = table(spark, d, "drive_sources").select("id", F.explode(F.array_compact(F.array(F.concat(F.lit("i:"), digest("canonical.input_sha256")), F.concat(F.lit("w:"), digest("canonical.waveform_float32_sha256"))))).alias("t")).distinct()
    m = k.groupBy("t").agg(F.min("id").alias("least"))
    return graph.components(k.join(m, "t").where("id <> least").select(F.col("id").alias("src"), F.col("least").alias("dst")))


@R(f"""with k as (select {SHA.format(*['canonical.input_sha256'] * 3)} as i, id, label, role from drive_sources) select i as digest, count(distinct id) as ids, count(distinct label) > 1 as conflicting_label, count(distinct role) > 1 as crosses_roles from k where i is not null group by 1 having count(distinct id) > 1""")
def grf_04_duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "drive_sources").select(digest("canonical.input_sha256").alias("digest"), "id", "label", "role").where("digest is not null")
    return k.groupBy("digest").agg(F.count_distinct("id").alias("ids"), (F.count_distinct("label") > 1).alias("conflicting_label"), (F.count_distinct("role") > 1).alias("crosses_roles")).where("ids > 1")


@R(f"with {C} select group_id, {FOLD} as fold from c group by 1, 2")
def fld_01_hash_fold(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).select("group_id").distinct().select("group_id", hash_fold(F.col("group_id")).alias("fold"))


@R(f"with {C} select id, round(('0x' || substr(sha256(id::varchar), 1, 16))::ubigint::double / 18446744073709551615.0, 6) as fraction, floor(('0x' || substr(sha256(id::varchar), 1, 16))::ubigint::double / 18446744073709551615.0 * greatest(value - 10, 0))::bigint as start from c")
def fld_02_stable_fraction(spark: SparkSession, d: str) -> DataFrame:
    f = stable_fraction(F.col("id").cast("string"))
    return cohort(spark, d).select("id", six(f, "fraction"), F.floor(f * F.greatest(F.col("value") - 10, F.lit(0.0))).alias("start"))


HELD = """f as (select *, {fold} as fold from c), cell as (select distinct {key} as held, label as held_label, b.bucket from c, (select unnest(range(5))::int as bucket) b),
  x as (select cell.*, f.group_id, f.label, f.fold = bucket and (f.{key} = held or f.label <> held_label) as test, f.fold <> bucket and not (f.{key} = held and f.label = held_label) as train from cell, f),
  g as (select held, held_label, bucket, group_id, count(*) filter (test) t, count(*) filter (test and label = 1) t1, count(*) filter (train and label = 0) n0, count(*) filter (train and label = 1) n1 from x group by 1, 2, 3, 4),
  y as (select held, held_label, bucket, sum(t)::bigint test_rows, sum(t1)::bigint test1, coalesce(sum(n0) filter (t = 0), 0)::bigint n0, coalesce(sum(n1) filter (t = 0), 0)::bigint n1, count(*) filter (t = 0 and n0 > 0) g0, count(*) filter (t = 0 and n1 > 0) g1 from g group by 1, 2, 3)
  select held as held_source, held_label as label, bucket, test_rows, n0 + n1 as train_rows, g0 as human_groups, g1 as generated_groups, case when test1 = 0 or test1 = test_rows then 'test_single_class' when n0 = 0 or n1 = 0 then 'train_single_class' when least(g0, g1) < 2 then 'few_groups' else 'eligible' end as status from y"""


@R(f"with {C}, {HELD.format(fold=FOLD, key='source_group')}")
def fld_03_source_held_out(spark: SparkSession, d: str) -> DataFrame:
    return schedule.held_source_cells(schedule.with_buckets(cohort(spark, d)))


C_FAMILY = C.replace("c as (select *,", "c as (select * replace (case when label = 1 then case when k % 2 = 0 then 'fam_a' else 'fam_b' end else 'human' end as source_group),")


@R(f"with {C_FAMILY}, {HELD.format(fold=FOLD, key='source_group')}")
def fld_04_family_held_out(spark: SparkSession, d: str) -> DataFrame:
    fam = F.when(F.col("label") == 1, F.when(F.col("k") % 2 == 0, "fam_a").otherwise("fam_b")).otherwise("human")
    return schedule.held_source_cells(schedule.with_buckets(cohort(spark, d).withColumn("source_group", fam)))


@R(f"with {C}, f as (select *, {FOLD} as fold from c) select fold, count(*) as rows, count(distinct group_id) as groups, count(*) filter (label = 1) as generated from f group by 1")
def fld_05_group_k_fold(spark: SparkSession, d: str) -> DataFrame:
    return schedule.with_buckets(cohort(spark, d)).groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("group_id").alias("groups"), F.count_if(F.col("label") == 1).alias("generated"))


@R(f"""with recursive {C}, {ROOTS}, x0 as (select c.* exclude (group_id), coalesce(r.root, 'group:' || c.group_id) as group_id from c left join roots r on r.node = 'group:' || c.group_id), c2 as (select * from x0 where group_id not in (select group_id from x0 where role = 'locked')),
  {HELD.format(fold=FOLD, key='source_group').replace('from c)', 'from c2)').replace('from c,', 'from c2,').replace('select held as held_source', 'h as (select held as held_source').replace(' from y', ' from y)').replace('from g group by 1, 2, 3)', 'from g group by 1, 2, 3),', 1)}
  select h.*, cap, sha256(concat_ws('|', held_source, label::varchar, bucket::varchar, cap)) as uid from h, (select unnest(['25', '50', '100', '200', 'all']) as cap)""")
def fld_06_full_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Held-source cells over unprotected closures, with caps and an id of each cell."""
    c = schedule.with_buckets(cohort(spark, d))
    r = cut(roots(spark, d))
    x = c.withColumn("node", F.concat(F.lit("group:"), "group_id")).join(r, "node", "left").withColumn("root", F.coalesce("root", "node"))
    protected = x.where("role = 'locked'").select("root").distinct()
    x = cut(x.join(protected, "root", "left_anti").withColumn("group_id", F.col("root")).withColumn("fold", hash_fold(F.col("root"))))
    cells = schedule.held_source_cells(x)
    caps = F.explode(F.array(*[F.lit(k) for k in ("25", "50", "100", "200", "all")]))
    uid = F.sha2(F.concat_ws("|", "held_source", F.col("label").cast("string"), F.col("bucket").cast("string"), "cap"), 256)
    return cells.select("*", caps.alias("cap")).withColumn("uid", uid)


@R(f"with {POWER.format([*FAMILIES, 'BC'])} select array_to_string(fam, '+') as combination, list_contains(fam, 'BC') as is_new from p")
def fld_07_eight_families(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(c, "BC" in c.split("+")) for c in relational.power_set([*FAMILIES, "BC"])], "combination string, is_new boolean")


@R(f"""with recursive {C}, {ROOTS}, x as (select coalesce(r.root, 'group:' || c.group_id) as root, c.label::varchar || ':' || c.source_group as source, count(*) as n from c left join roots r on r.node = 'group:' || c.group_id group by 1, 2),
  m as (select source, count(*) as m from x group by 1), y as (select root, arg_min(source, (m, source)) as stratum, sum(n)::bigint as n, sha256('20260907|' || root) as h from x join m using (source) group by root),
  z as (select *, row_number() over (partition by stratum order by h, root) - 1 as drawn from y), w as (select *, row_number() over (partition by stratum, drawn >= 3 order by floor(log2(n) + 1e-9) desc, h, root) - 1 as place from z), v as (select *, (place + 0.5::double) * 0.6180339887498949::double as a from w)
  select root, case when drawn = 0 then 'train' when drawn = 1 then 'calibration' when drawn = 2 then 'test' when a - floor(a) < 0.6 then 'train' when a - floor(a) < 0.8 then 'calibration' else 'test' end as part from v""")
def fld_08_closure_partition(spark: SparkSession, d: str) -> DataFrame:
    """Closures to train, calibration and test: one of each for every rare source, the others spread by size within their rarest source."""
    x = cohort(spark, d).withColumn("node", F.concat(F.lit("group:"), "group_id")).join(roots(spark, d), "node", "left").withColumn("root", F.coalesce("root", "node"))
    c = x.groupBy("root", F.concat_ws(":", F.col("label").cast("string"), "source_group").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return schedule.partition_closures(c)


@R(f"with {C}, x as (select id, label, row_number() over (partition by label order by sha256('cv|' || id::varchar)) as n from c) select id, (n % 5)::int as fold from x")
def fld_09_stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    """Stratified folds in a seeded hash order (the generator of another language's numbers is not imitated); places come from ranges of the hash."""
    x = cohort(spark, d).select("id", "label", rank_key(F.col("id").cast("string"), "cv").alias("h"))
    y = with_running_total(x, ["label"], F.conv(F.substring("h", 1, 3), 16, 10).cast("int"), [F.col("h"), F.col("id")], F.lit(1), "before")
    return y.select("id", ((F.col("before") + 1) % 5).cast("int").alias("fold"))


@R(f"with {C}, {HELD.format(fold=FOLD, key='source_group').replace('select held as held_source', 'h as (select held as held_source').replace(' from y', ' from y)').replace('from g group by 1, 2, 3)', 'from g group by 1, 2, 3),', 1)} select status, count(*) as cells, sum(test_rows)::bigint as test_rows, sum(train_rows)::bigint as train_rows from h group by 1")
def fld_10_cell_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Intended, eligible and omitted cells with their rows, per reason."""
    h = schedule.held_source_cells(schedule.with_buckets(cohort(spark, d)))
    return h.groupBy("status").agg(F.count(F.lit(1)).alias("cells"), F.sum("test_rows").alias("test_rows"), F.sum("train_rows").alias("train_rows"))


@R(f"with {C}, n as (select count(*) n from c) select s.shard, count(*) as rows from (select unnest(range((select (n + 999) // 1000 from n))) as shard) s join (select row_number() over (order by id) - 1 as i from c) on i // 1000 = s.shard group by 1")
def fld_11_shards(spark: SparkSession, d: str) -> DataFrame:
    return schedule.shards(cohort(spark, d), "id", 1000).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
