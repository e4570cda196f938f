"""Queries of filters, projections and scalar functions (FLT, PRJ, FN)."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import scalar as s
from cadenza.functions.hashing import stable_seed
from cadenza.operators import relational
from cadenza.operators.metrics import ratio, six
from cadenza.queries._cohort import C, cohort
from cadenza.registry import Registry
from cadenza.session import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
E_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::double * {b}[i]::double))"


@R(f"with {C} select id from c where (k >= 90 or source_group in ('error', 'view')) and value <= 40 and role = 'development' and f2 >= 0.1")
def flt_01_declarative_eligibility(spark: SparkSession, d: str) -> DataFrame:
    rules = {"any": [{"min": {"k": 90}}, {"in": {"source_group": ["error", "view"]}}], "max": {"value": 40}, "equals": {"role": "development"}, "min": {"f2": 0.1}}
    return cohort(spark, d).where(relational.eligibility(rules)).select("id")


@R(f"with {C} select id, f2 is not null and f2 >= 0.2 as base, f5 is not null and f5 <= 50 as extra from c where value >= 1 and k < 95")
def flt_02_contracts(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).where(relational.eligibility({"min": {"value": 1}, "max": {"k": 94}}))
    return c.select("id", relational.eligibility({"min": {"f2": 0.2}}).alias("base"), relational.eligibility({"max": {"f5": 50}}).alias("extra"))


@R(f"with {C} select id from c where source_group in ('click', 'view') and role not in ('locked') and id not in (select event_id from events where event_id % 13 = 0)")
def flt_03_include_exclude(spark: SparkSession, d: str) -> DataFrame:
    out = cohort(spark, d).where("id % 13 = 0").select("id")
    return cohort(spark, d).where(F.col("source_group").isin("click", "view") & ~F.col("role").isin("locked")).select("id").join(out, "id", "left_anti")


@R("select doc_id, flagged from content_labels where flagged is not null and rater is not null")
def flt_04_known_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "content_labels").where("flagged is not null and rater is not null").select("doc_id", "flagged")


@R("select id, lower(trim(coalesce(validation_status, ''))) in ('verified', 'available', '1', 'true', 'yes') as available from drive_sources")
def flt_05_truthiness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "drive_sources").select("id", F.lower(F.trim(F.coalesce("validation_status", F.lit("")))).isin("verified", "available", "1", "true", "yes").alias("available"))


@R(f"with {C} select source_group, count(*) as eligible, count(*) filter (f2 is not null and f5 is not null) as complete, count(*) filter (f2 is not null or f5 is not null) as observed from c where value >= 2 group by 1")
def flt_06_completeness(spark: SparkSession, d: str) -> DataFrame:
    v = F.array("f2", "f5")
    return cohort(spark, d).where("value >= 2").groupBy("source_group").agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.forall(v, lambda x: x.isNotNull())).alias("complete"), F.count_if(F.exists(v, lambda x: x.isNotNull())).alias("observed"))


@R(f"with {C} select id, array_to_string(list_filter([case when value < 1 then 'short' end, case when f2 is null then 'no_f2' end, case when role = 'locked' then 'locked' end], lambda x: x is not null), ',') as reasons, value >= 1 and f2 is not null and role <> 'locked' as candidate from c")
def flt_07_exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    r = F.array_compact(F.array(F.when(F.col("value") < 1, "short"), F.when(F.col("f2").isNull(), "no_f2"), F.when(F.col("role") == "locked", "locked")))
    return cohort(spark, d).select("id", F.array_join(r, ",").alias("reasons"), (F.size(r) == 0).alias("candidate"))


@R(r"""with x as (select distinct combination from native30_replay where combination is not null), y as (select combination, string_split_regex(combination, '\+') as f from x)
  select combination, len(f) > 0 and len(list_distinct(f)) = len(f) and list_bool_and(list_transform(f, lambda e: e in ('S', 'D', 'R', 'P', 'F', 'H', 'SC', 'BC'))) and list_sort(list_transform(f, lambda e: list_position(['S', 'D', 'R', 'P', 'F', 'H', 'SC', 'BC'], e))) = list_transform(f, lambda e: list_position(['S', 'D', 'R', 'P', 'F', 'H', 'SC', 'BC'], e)) as valid from y""")
def flt_08_canonical_selection(spark: SparkSession, d: str) -> DataFrame:
    known = F.array(*[F.lit(x) for x in ("S", "D", "R", "P", "F", "H", "SC", "BC")])
    f = F.split("combination", r"\+")
    place = F.transform(f, lambda e: F.array_position(known, e))
    ok = (F.size(F.array_distinct(f)) == F.size(f)) & F.forall(place, lambda p: p > 0) & (F.array_sort(place) == place)
    return table(spark, d, "native30_replay").where("combination is not null").select("combination").distinct().select("combination", ok.alias("valid"))


@R(f"with {C} select id, case when value < 1 then 'below_floor' when k % 7 = 0 then 'unavailable' when k < 10 then 'low_coverage' else 'ok' end as status from c")
def flt_09_quality_status(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).select("id", F.when(F.col("value") < 1, "below_floor").when(F.col("k") % 7 == 0, "unavailable").when(F.col("k") < 10, "low_coverage").otherwise("ok").alias("status"))


@R(f"with {C}, t as (select source_group, avg(value) v, avg(score) s, count(f2)::double / count(*) c from c group by 1) select source_group, v between 1 and 30 as level, s < 0.6 as bias, c > 0.8 as coverage, v between 1 and 30 and s < 0.6 and c > 0.8 as passed from t")
def flt_10_measurement_gate(spark: SparkSession, d: str) -> DataFrame:
    t = cohort(spark, d).groupBy("source_group").agg(F.avg("value").alias("v"), F.avg("score").alias("s"), ratio(F.count("f2"), F.count(F.lit(1))).alias("c"))
    gates = {"level": F.col("v").between(1, 30), "bias": F.col("s") < 0.6, "coverage": F.col("c") > 0.8}
    return t.select("source_group", *[g.alias(n) for n, g in gates.items()], (gates["level"] & gates["bias"] & gates["coverage"]).alias("passed"))


@R("select event_id as id, event_type as source, value as score from events")
def prj_01_alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events")
    first = lambda *names: next(n for n in names if n in t.columns)
    return t.select(F.col(first("id", "sample_id", "event_id")).alias("id"), F.col(first("source", "source_group", "event_type")).alias("source"), F.col(first("score", "value")).alias("score"))


@R("select id, label, case when split_part(id, '_', 1) in ('human', 'real', '0') then 0 when split_part(id, '_', 1) in ('ai', 'generated', 'synthetic', '1') then 1 end as normal_label from drive_sources")
def prj_02_label_normalisation(spark: SparkSession, d: str) -> DataFrame:
    word = F.lower(F.substring_index("id", "_", 1))
    return table(spark, d, "drive_sources").select("id", "label", F.when(word.isin("human", "real", "0"), 0).when(word.isin("ai", "generated", "synthetic", "1"), 1).alias("normal_label"))


@R("select id, label::varchar || ':' || source_group as source_key from drive_sources")
def prj_03_source_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "drive_sources").select("id", F.concat_ws(":", F.col("label").cast("string"), "source_group").alias("source_key"))


@R("select id, load_id, features['F_phase_residual_cvar_all'] as f_all, features['H_pc_path_step_median'] as h_step, null::double as s_tilt from sample_reference_features where features is not null and isfinite(coalesce(features['F_phase_residual_cvar_all'], 0)) and isfinite(coalesce(features['H_pc_path_step_median'], 0))")
def prj_04_blank_row(spark: SparkSession, d: str) -> DataFrame:
    """A wide row with every family's columns, null where a family is absent."""
    t = table(spark, d, "sample_reference_features").where("features is not null")
    g = lambda n: F.try_element_at("features", F.lit(n))
    x = t.select("id", "load_id", g("F_phase_residual_cvar_all").alias("f_all"), g("H_pc_path_step_median").alias("h_step"), F.lit(None).cast("double").alias("s_tilt"))
    ok = lambda c: c.isNull() | (~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return x.where(ok(F.col("f_all")) & ok(F.col("h_step")))


@R("select id, canonical.native_sample_rate_hz >= 16000 as eligible_16k, canonical.native_sample_rate_hz >= 40000 as eligible_40k, case when label = 1 then source_group end as generator from drive_sources")
def prj_05_eligibility_flags(spark: SparkSession, d: str) -> DataFrame:
    hz = F.col("canonical.native_sample_rate_hz")
    return table(spark, d, "drive_sources").select("id", (hz >= 16000).alias("eligible_16k"), (hz >= 40000).alias("eligible_40k"), F.when(F.col("label") == 1, F.col("source_group")).alias("generator"))


@R("with x as (select unnest(map_keys(features)) k, unnest(map_values(features)) v from sample_reference_features) select k as name, count(*) as rows, count(*) filter (v is null or isnan(v)) as unavailable, count(*) filter (isinf(v)) as rejected from x group by 1")
def prj_06_nan_to_null(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "sample_reference_features").select(F.explode("features").alias("name", "v"))
    v = F.when(~F.isnan("v"), F.col("v"))
    return x.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.count_if(v.isNull()).alias("unavailable"), F.count_if(F.abs(v) == F.lit(float("inf"))).alias("rejected"))


@R("with x as (select distinct unnest(map_keys(features)) k from native30_replay) select k as name, case when k like '%\\_db' escape '\\' or k like '%\\_db\\_%' escape '\\' then 'dB' when k like '%\\_hz' escape '\\' then 'Hz' when k like '%\\_ms\\_%' escape '\\' then 'ms' when k like '%fraction%' or k like '%share%' or k like '%entropy%' then 'ratio' else 'unit' end as unit from x")
def prj_07_metric_units(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("name")
    unit = F.when(k.endswith("_db") | k.contains("_db_"), "dB").when(k.endswith("_hz"), "Hz").when(k.contains("_ms_"), "ms").when(k.rlike("fraction|share|entropy"), "ratio").otherwise("unit")
    return table(spark, d, "native30_replay").select(F.explode(F.map_keys("features")).alias("name")).distinct().select("name", unit.alias("unit"))


@R(f"with {C} select id, name, kind, round(v, 6) + 0.0 as contribution from (select id, unnest(['f2', 'f2', 'f5', 'f5']) as name, unnest(['value', 'missing', 'value', 'missing']) as kind, unnest([coalesce(f2, 0.5) * 0.7, case when f2 is null then 0.2 else 0 end, coalesce(f5, 10.0) * -0.01, case when f5 is null then -0.1 else 0 end]) as v from c)")
def prj_08_contribution_list(spark: SparkSession, d: str) -> DataFrame:
    part = lambda n, mid, w, m: [F.struct(F.lit(n).alias("name"), F.lit("value").alias("kind"), (F.coalesce(F.col(n), F.lit(mid)) * w).alias("v")), F.struct(F.lit(n).alias("name"), F.lit("missing").alias("kind"), F.when(F.col(n).isNull(), m).otherwise(0.0).alias("v"))]
    return cohort(spark, d).select("id", F.explode(F.array(*part("f2", 0.5, 0.7, 0.2), *part("f5", 10.0, -0.01, -0.1))).alias("e")).select("id", "e.name", "e.kind", (F.round("e.v", 6) + 0.0).alias("contribution"))


@R()
def fn_01_normal_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(s.normal_text("text"), 256).alias("digest"))


@R(r"""select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')) as digest from documents where text is not null""")
def fn_02_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(s.clean_text(F.col("text")), 256).alias("digest"))


@R("select doc_id, case when contains(lower(text), 'pre-chorus') then 'pre_chorus' when contains(lower(text), 'chorus') then 'chorus' when contains(lower(text), 'verse') then 'verse' when contains(lower(text), 'intro') then 'intro' when contains(lower(text), 'outro') then 'outro' else 'other' end as section from documents where text is not null")
def fn_03_section_names(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("text")
    c = F
    for word, name in (("pre-chorus", "pre_chorus"), ("chorus", "chorus"), ("verse", "verse"), ("intro", "intro"), ("outro", "outro")):
        c = c.when(t.contains(word), name)
    return table(spark, d, "documents").where("text is not null").select("doc_id", c.otherwise("other").alias("section"))


@R("select doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> ''), '; ') as tags from documents where kind = 'prompt' and text is not null")
def fn_04_comma_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("kind = 'prompt' and text is not null").select("doc_id", F.array_join(s.comma_tags(F.col("text")), "; ").alias("tags"))


@R(f"with {C}, s as (select user_id, list(k::varchar order by value, id) filter (value < 10) as parts from c group by 1) select user_id, coalesce(array_to_string(parts, chr(10)), '') as lyrics from s")
def fn_05_windowed_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Sections that begin before the window's end, in order."""
    sections = F.array_sort(F.collect_list(F.struct("value", "id", "k")))
    x = cohort(spark, d).groupBy("user_id").agg(sections.alias("s"))
    return x.select("user_id", F.array_join(F.transform(F.filter("s", lambda e: e["value"] < 10), lambda e: e["k"].cast("string")), "\n").alias("lyrics"))


@R(f"with {C} select user_id, max(try_cast(case when k % 10 = 0 then 'bad' else value::varchar end as double)) as duration from c group by 1")
def fn_06_max_with_bad_values(spark: SparkSession, d: str) -> DataFrame:
    s_ = F.collect_list(F.struct(F.when(F.col("k") % 10 == 0, "bad").otherwise(F.col("value").cast("string")).alias("end")))
    return cohort(spark, d).groupBy("user_id").agg(F.array_max(F.transform(s_, lambda e: e["end"].try_cast("double"))).alias("duration"))


@R(f"with {C}, t as (select id, case k % 4 when 0 then k::varchar || 's' when 1 then k::varchar || '.5s' when 2 then k::varchar else 's' || k::varchar end as token from c) select id, case when regexp_full_match(token, '[0-9]+(\\.[0-9]+)?s') then rtrim(token, 's')::double end as seconds from t")
def fn_07_duration_tokens(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k").cast("string")
    t = F.when(F.col("k") % 4 == 0, F.concat(k, F.lit("s"))).when(F.col("k") % 4 == 1, F.concat(k, F.lit(".5s"))).when(F.col("k") % 4 == 2, k).otherwise(F.concat(F.lit("s"), k))
    return cohort(spark, d).select("id", s.duration_token(t).alias("seconds"))


@R("select id, round(coalesce(canonical.native_frames::double / canonical.native_sample_rate_hz, canonical.duration_s, verification.decoded_frames / 44100.0), 6) as seconds, case when canonical.native_frames::double / canonical.native_sample_rate_hz is not null then 'native' when canonical.duration_s is not null then 'declared' when verification.decoded_frames is not null then 'decoded' else 'none' end as basis from drive_sources")
def fn_08_evidence_with_basis(spark: SparkSession, d: str) -> DataFrame:
    native, declared, decoded = F.col("canonical.native_frames") / F.col("canonical.native_sample_rate_hz"), F.col("canonical.duration_s"), F.col("verification.decoded_frames") / 44100.0
    basis = F.when(native.isNotNull(), "native").when(declared.isNotNull(), "declared").when(decoded.isNotNull(), "decoded").otherwise("none")
    return table(spark, d, "drive_sources").select("id", six(F.coalesce(native, declared, decoded), "seconds"), basis.alias("basis"))


@R(f"with {C} select id, sha256(id::varchar || chr(31) || source_group) as key, (('0x' || substr(sha256(id::varchar || chr(31) || source_group), 1, 8))::bigint & 2147483647)::bigint as seed from c")
def fn_09_stable_hex(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.col("id").cast("string"), F.col("source_group")]
    return cohort(spark, d).select("id", F.sha2(F.concat_ws("\x1f", *parts), 256).alias("key"), stable_seed(*parts).alias("seed"))


@R()
def fn_10_content_digest(spark: SparkSession, d: str) -> DataFrame:
    from cadenza.functions.signal import float_digest

    return table(spark, d, "embeddings").select("vec_id", float_digest(F.transform("embedding", lambda x: x.cast("double"))).alias("digest"))


@R(f"with {C} select id, round(10 * log10(value + 1e-12), 6) as db, round(10 * log10((value + 1e-12) / (k + 1 + 1e-12)), 6) as ratio_db from c")
def fn_11_decibels(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).select("id", six(s.db(F.col("value")), "db"), six(s.db_ratio(F.col("value"), F.col("k") + 1), "ratio_db"))


@R(f"with {C} select id, round((value + pi()) - 2 * pi() * floor((value + pi()) / (2 * pi())) - pi(), 6) as phase from c")
def fn_12_phase_wrap(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).select("id", six(s.wrap_phase(F.col("value")), "phase"))


@R(f"with {C} select source_group, round(1 - sqrt(pow(sum((k + 1) * cos(value)), 2) + pow(sum((k + 1) * sin(value)), 2)) / sum(k + 1), 6) as circular_variance from c group by 1")
def fn_13_circular_variance(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).groupBy("source_group").agg(six(s.circular_variance(F.col("value"), (F.col("k") + 1).cast("double")), "circular_variance"))


@R(f"with {C}, h as (select source_group, least(floor(value / 5), 9) b, count(*)::double n from c group by 1, 2), p as (select source_group, n / sum(n) over (partition by source_group) p from h) select source_group, round(-sum(p * ln(p)) / ln(10), 6) as entropy from p group by 1")
def fn_14_normal_entropy(spark: SparkSession, d: str) -> DataFrame:
    h = cohort(spark, d).groupBy("source_group", F.least(F.floor(F.col("value") / 5), F.lit(9)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    a = h.groupBy("source_group").agg(F.collect_list(F.col("n").cast("double")).alias("n"), F.sum("n").alias("t"))
    return a.select("source_group", six(s.entropy(F.transform("n", lambda x: x / F.col("t")), 10), "entropy"))


@R(f"with {C} select source_group, case when value = 50 then 9 else floor(value / 5)::int end as bin, count(*) as n from c where value between 0 and 50 group by 1, 2")
def fn_15_fixed_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Bins of 5 from 0 to 50, the last closed on the right."""
    b = F.when(F.col("value") == 50, 9).otherwise(F.floor(F.col("value") / 5)).cast("int")
    return cohort(spark, d).where("value between 0 and 50").groupBy("source_group", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@R(f"with {C}, h as (select source_group, k, count(*) n, sum(count(*)) over (partition by source_group) t from c group by 1, 2), r as (select *, row_number() over (partition by source_group order by n desc, k) o from h) select source_group, k as mode, round(1 - n::double / t, 6) as off_mode from r where o = 1")
def fn_16_mode(spark: SparkSession, d: str) -> DataFrame:
    h = cohort(spark, d).groupBy("source_group", "k").agg(F.count(F.lit(1)).alias("n"))
    m = h.groupBy("source_group").agg(F.min(F.struct((-F.col("n")).alias("m"), "k")).alias("b"), F.sum("n").alias("t"))
    return m.select("source_group", F.col("b.k").alias("mode"), six(1 + ratio(F.col("b.m"), F.col("t")), "off_mode"))


@R(f"with {C} select source_group, round(quantile_cont(value, 0.1), 6) as q10, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.9), 6) as q90 from c group by 1")
def fn_17_linear_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).groupBy("source_group").agg(*[six(F.percentile("value", F.lit(q)), n) for q, n in ((0.1, "q10"), (0.25, "q25"), (0.5, "q50"), (0.9, "q90"))])


@R(f"with {C} select id, round(440 * pow(2, (k - 69) / 12.0::double), 6) as hz, round(1200 * log2(440 * pow(2, (k - 69) / 12.0::double)), 6) as cents, round(1200 * log2((value + 100) / (k + 100)), 6) as difference from c")
def fn_18_pitch_units(spark: SparkSession, d: str) -> DataFrame:
    hz = s.midi_to_hz(F.col("k"))
    return cohort(spark, d).select("id", six(hz, "hz"), six(s.hz_to_cents(hz), "cents"), six(s.cents_between((F.col("k") + 100).cast("double"), F.col("value") + 100), "difference"))


@R(f"with {C} select id, round(1 / (1 + exp(-greatest(least((value - 10) / 2, 40), -40))), 6) as p from c")
def fn_19_sigmoid(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).select("id", six(s.sigmoid(F.greatest(F.least((F.col("value") - 10) / 2, F.lit(40.0)), F.lit(-40.0))), "p"))


@R(f"select vec_id, round({E_DOT.format(a='embedding', b='list_transform(range(1, 65), lambda j: j / 64.0::double)')}, 6) as score from embeddings")
def fn_20_dot_product(spark: SparkSession, d: str) -> DataFrame:
    w = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i / F.lit(64.0))
    return table(spark, d, "embeddings").select("vec_id", six(s.dot(F.col("embedding"), w), "score"))


@R(f"with a as (select embedding q from embeddings where vec_id = 0) select vec_id, round({E_DOT.format(a='embedding', b='q')} / sqrt({E_DOT.format(a='embedding', b='embedding')} * {E_DOT.format(a='q', b='q')}), 6) as cosine, round(embedding[64 - 3 + 1], 6) as first_of_rotated from embeddings, a")
def fn_21_cosine_and_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Similarity to one query vector and circular rotation by three."""
    t = table(spark, d, "embeddings")
    q = t.where("vec_id = 0").select(F.col("embedding").alias("q"))
    x = t.join(F.broadcast(q), F.lit(True))  # one row
    return x.select("vec_id", six(s.cosine(F.col("embedding"), F.col("q")), "cosine"), F.round(s.rotate(F.col("embedding"), F.lit(3))[0], 6).alias("first_of_rotated"))


@R("select vec_id, list_position(embedding, list_max(embedding))::bigint - 1 as place from embeddings")
def fn_22_argmax(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", s.argmax(F.col("embedding")).alias("place"))


@R(f"with {C} select id, round(least((k - id % 12 + 144) % 12, 12 - (k - id % 12 + 144) % 12) / 6.0, 6) as step from c")
def fn_23_pitch_class_step(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).select("id", six(s.pitch_class_step(F.col("k"), F.col("id") % 12), "step"))


@R(f"with {C} select id, case when k % 12 <= 6 then k % 12 else k % 12 - 12 end as shift from c")
def fn_24_signed_shift(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).select("id", s.signed_shift(F.col("k") % 12).alias("shift"))


@R(f"with {C} select id, round(value / pow(2, floor(log2(value)) + 1), 9) as mantissa, (floor(log2(value)) + 1)::int as exponent from c where value > 0")
def fn_25_frexp(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).where("value > 0").select("id", s.frexp(F.col("value")).alias("f")).select("id", F.round("f.mantissa", 9).alias("mantissa"), "f.exponent")


@R(f"with {C} select source_group, round(regr_slope(10 * log10(value + 0.001), log2(k + 1)), 6) as db_per_octave, round(regr_slope(value, k), 6) as trend from c group by 1")
def fn_26_slopes(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).groupBy("source_group").agg(six(F.regr_slope(10 * F.log10(F.col("value") + 0.001), F.log2(F.col("k") + 1)), "db_per_octave"), six(F.regr_slope("value", F.col("k").cast("double")), "trend"))


@R("select event_id as id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso from events")
def fn_27_utc_iso(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@R("with u as (select distinct archive, member_name, 'hf://datasets/' || archive || '@main/' || member_name as locator from drive_sources where archive is not null and member_name is not null) select locator, 'https://host.invalid/datasets/' || archive || '/resolve/main/' || member_name as url, regexp_extract(member_name, '\\.([a-z0-9]+)$', 1) as extension from u")
def fn_28_locator_parsing(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "drive_sources").where("archive is not null and member_name is not null").select(F.concat(F.lit("hf://datasets/"), "archive", F.lit("@main/"), "member_name").alias("locator")).distinct()
    g = lambda i: F.regexp_extract("locator", r"^hf://([a-z]+)/([^@]+)@([^/]+)/(.+)$", i)
    return u.select("locator", F.concat(F.lit("https://host.invalid/"), g(1), F.lit("/"), g(2), F.lit("/resolve/"), g(3), F.lit("/"), g(4)).alias("url"), F.regexp_extract("locator", r"\.([a-z0-9]+)$", 1).alias("extension"))


@R("select event_id as id, case when regexp_full_match(props, '\\{\"k\": [0-9]+\\}') then cast(json_extract(props, '$.k') as int) end as choice from events")
def fn_29_exact_json_choice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("props").rlike(r'^\{"k": [0-9]+\}$'), F.get_json_object("props", "$.k").cast("int")).alias("choice"))


@R("select distinct path, path <> '' and path not like '/%' and not contains(path, chr(92)) and len(list_filter(string_split(path, '/'), lambda p: p in ('', '.', '..'))) = 0 as safe from generated_cleanup where path is not null")
def fn_30_safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "generated_cleanup").where("path is not null").select("path", s.safe_name(F.col("path")).alias("safe")).distinct()


