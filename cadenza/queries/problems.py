"""The general problems' queries over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import nested, quality
from cadenza.session import cut, table

#: Fields that are lists, and the field of a receipt that wraps a record.
LISTS, WRAPPERS = ("segments", "beats", "samples", "differences", "limitations"), ("payload",)


def _values(spark: SparkSession, d: str, *under: str) -> DataFrame:
    return nested.path_values(table(spark, d, "neural_records"), "record_id", "body", "received_at", ["record_kind"], LISTS, WRAPPERS, under)


def _table(v: DataFrame, group: str, columns: dict[str, str]) -> DataFrame:
    return nested.pivot_group(v, group, columns, ["record_kind"]).withColumnRenamed("id", "record_id")


def _child(v: DataFrame, group: str, columns: dict[str, str], parent: str, pos: str) -> DataFrame:
    return _table(v, group, columns).where("is_object").select("record_id", "record_kind", F.col("parent")[0].cast("int").alias(parent), F.col("pos").cast("int").alias(pos), *columns)


def _number(*names: str):
    return {c: F.expr(f"try_cast(`{c}` as double)") for c in names}


BEAT, DIFFERENCE = "structure.segments[].beats[]", "samples[].differences[]"
#: The columns that a table has even where no record does; what else is found is added.
RECORD = [
    "scope", "sample_id", "receipt_sha256", "historical_features_sha256", *[f"audio.{x}" for x in ("name", "duration", "sample_rate", "channels", "sha256")], *[f"audio_provenance.{x}" for x in ("status", "native_rate_hz", "approved_region_float64_sha256")],
    *[f"audio_provenance.coordinates.{x}" for x in ("region_start_frame", "region_frames", "crop_frames")], *[f"audio_provenance.runtime.{x}" for x in ("python", "numpy")], *[f"audio_provenance.configuration.{x}" for x in ("version", "duration_s", "output_rate_hz", "channels", "crop_rule", "limiting")],
    "structure.folds", *[f"product_sha256.{x}" for x in ("mix", "vocals", "drums", "bass")], *[f"provenance.{x}" for x in ("backend", "device", "elapsed_seconds")], *[f"quality.{x}" for x in "DSRP"],
]
SAMPLE = ["sample_id", "fresh_report_sha256", "new_deployment_score_on_fresh_cpu_features.raw_score", "new_deployment_score_on_fresh_cpu_features.decision", *[f"quality.{x}" for x in "DSRP"]]


def column_name(path: str) -> str:
    return path.replace(".", "__")


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """A row per readable record with every scalar it holds outside lists; the measurements are in p1_features."""
    v = cut(_values(spark, d).where(~F.col("path").startswith("features.")))
    paths = dict.fromkeys([*RECORD, *nested.found_columns(v).get("", [])])
    t = _table(v, "", {column_name(p): p for p in paths if p}).where("is_object")
    return t.select("record_id", "record_kind", *[column_name(p) for p in paths if p])


def p1_features(spark: SparkSession, d: str) -> DataFrame:
    """The measurements of a record, a row each: their names are data."""
    v = _values(spark, d, "features").where("path like 'features.%' and kind not in ('object', 'list', 'null')")
    return v.select(F.col("id").alias("record_id"), F.expr("substr(path, 10)").alias("feature"), F.expr("try_cast(value as double)").alias("value"))


def p1_lists(spark: SparkSession, d: str) -> DataFrame:
    """Elements that are values themselves, of every list of the records (limitations, windows): list, position, value."""
    v = _values(spark, d).where("path like '%[]' and kind not in ('object', 'list', 'null')")
    return v.select(F.col("id").alias("record_id"), F.expr("left(path, length(path) - 2)").alias("list"), F.array_join(F.col("ordinals").cast("array<string>"), ".").alias("place"), "value")


def p1_samples(spark: SparkSession, d: str) -> DataFrame:
    v = cut(_values(spark, d, "samples").where(~F.col("path").startswith(DIFFERENCE)))
    paths = dict.fromkeys([*SAMPLE, *nested.found_columns(v).get("samples[]", [])])
    t = _table(v, "samples[]", {column_name(p): p for p in paths if p}).where("is_object")
    return t.select("record_id", F.col("pos").cast("int").alias("sample_pos"), *[column_name(p) for p in paths if p])


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    t = _table(_values(spark, d, "structure.segments"), "structure.segments[]", {x: x for x in ("start", "end", "label")}).where("is_object")
    return t.select("record_id", F.col("pos").cast("int").alias("segment_pos"), "start", "end", "label").withColumns(_number("start", "end"))


def p1_beats(spark: SparkSession, d: str) -> DataFrame:
    t = _child(_values(spark, d, BEAT), BEAT, {"time": "time", "number": "number"}, "segment_pos", "beat_pos")
    return t.withColumns(_number("time", "number")).drop("record_kind")


def p1_differences(spark: SparkSession, d: str) -> DataFrame:
    t = _child(_values(spark, d, DIFFERENCE), DIFFERENCE, {x: x for x in ("feature", "archived", "fresh_cpu", "absolute_difference", "missingness_same")}, "sample_pos", "difference_pos")
    return t.withColumns(_number("archived", "fresh_cpu", "absolute_difference")).drop("record_kind")


def p1_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality entries of records (sample_pos null) and of the samples of comparisons."""
    v = _values(spark, d, "quality", "samples[].quality").where("path like 'quality.%' or path like 'samples[].quality.%'").where("kind not in ('object', 'list', 'null')")
    return v.select(F.col("id").alias("record_id"), F.try_element_at("ordinals", F.lit(1)).alias("sample_pos"), F.substring_index("path", ".", -1).alias("family"), F.col("value").alias("quality"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    v = cut(_values(spark, d, BEAT, DIFFERENCE).where(f"path in ('{BEAT}', '{DIFFERENCE}')"))
    one = lambda group, child, kind: _child(v, group, {}, "parent_pos", "child_pos").where(F.col("record_kind").startswith(kind)).select("record_id", F.lit(child).alias("child"), "parent_pos", "child_pos")
    return one(BEAT, "beat", "real_sample").unionAll(one(DIFFERENCE, "difference", "historical_comparison"))


#: Families of a combination and the columns' prefixes.
FAMILY_OF = {"s8": "S", "d": "D", "r": "R", "p": "P", "F": "F", "H": "H", "SC": "SC", "BC": "BC"}
#: The measurements by family.
S_NAMES = [f"s8__{x}" for x in ("tilt_1_5k_db_oct", "hf_tilt_5_7p5k_db_oct", "hf_ratio_5_7p5_db", "sibilance_ratio_5_7p5_db", "hf_flatness_5_7p5", "hf_entropy_5_7p5", "hf_crest_5_7p5_db", "hf_power_sd_5_7p5_db", "hf_flux_5_7p5", "hf_frame_similarity_5_7p5", "sibilance_burst_rate_5_7p5_hz", "sibilance_contrast_5_7p5_db", "hf_mod_4_12_share_5_7p5", "fakeprint_peak_density_5_7p5_per_khz", "fakeprint_periodicity_5_7p5")]
DRP_NAMES = ["d__dynamics_span", "d__dynamics_iqr", "d__dynamics_adjacent_change", "r__ibi_cv", "r__tempo_tv", "r__tempo_entropy", *[f"p__section_{x}" for x in ("duration_cv", "duration_entropy", "duration_median", "bars_cv", "bars_offmode_fraction", "bars_median")]]
FHSC_NAMES = [
    *[f"F_{m}_{p}" for m in ("phase_residual_cvar", "group_delay_iqr_ms", "group_delay_cross_band_iqr_ms") for p in ("all", "attack", "sustain", "decay", "decay_minus_sustain")],
    *[f"H_{x}" for x in ("pitch_class_entropy_norm", "pc_token_entropy_norm", "chroma_path_change_median", "chroma_path_change_iqr", "pc_path_step_median", "pc_path_large_step_rate")],
    *[f"SC_{b}hz_{m}_median" for b in ("80_500", "500_2000", "2000_6000") for m in ("abs_iid_db", "side_energy_fraction")],
]
BC_NAMES = ["BC_b2_500_750_1250hz_center8s_median"]
#: Usual forms of an id and a digest.
ID_FORM, SHA_FORM = "^(human|ai)_[a-z_]+_[0-9a-f]{16}$", "^[0-9a-f]{64}$"


def family_of(name: str) -> str:
    return FAMILY_OF.get(name.split("_")[0], "")


def families(c):
    """The families that a combination names, however written, in order of the alphabet: array<string>; null for none."""
    parts = F.array_sort(F.array_distinct(F.filter(F.split(F.upper(F.regexp_replace(c, r"\s+", "")), r"[^A-Z]+"), lambda x: x != "")))
    return F.when(F.size(parts) > 0, parts)


def quality_specs() -> dict[str, quality.Spec]:
    replay = quality.Spec("load_id", {"id": ID_FORM, "sha256": SHA_FORM, "feature_file_sha256": SHA_FORM}, "features", [*S_NAMES, *DRP_NAMES, *FHSC_NAMES, *BC_NAMES], family_of, F.coalesce(families(F.col("combination")), F.array().cast("array<string>")))
    reference = quality.Spec("load_id", {"id": ID_FORM, "feature_file_sha256": SHA_FORM}, "features", FHSC_NAMES)
    return {"native30_replay": replay, "sample_reference_features": reference}


def _both(spark: SparkSession, d: str, f) -> DataFrame:
    a, b = [f(table(spark, d, n), s).withColumn("table_name", F.lit(n)) for n, s in quality_specs().items()]
    return a.unionByName(b)


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    p = _both(spark, d, quality.profile)
    return p.select("table_name", "load_id", "column_name", "rows", "missing", "distinct_values", "violations", "lowest", "highest", F.format_string("%.6e", "average").alias("average"), "top").withColumn("average", F.when(F.col("lowest").isNotNull(), F.col("average")))


def p5_changes(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, quality.changed_columns)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_changes(spark, d).select("table_name", "load_id", "column_name")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


def _decoded(x: str) -> str:
    """A JSON value, read in place where it is a text that holds JSON."""
    return f"case when json_type({x}) = 'VARCHAR' then try_cast(({x}) ->> '$' as json) else {x} end"


def _listed(x: str) -> str:
    return f"case json_type({x}) when 'OBJECT' then json_array({x}) when 'ARRAY' then {x} end"


def _children(name: str, records: str, outer: str, inner: str, child: str) -> str:
    return f"""{name}1 as (select record_id, {_decoded(outer)} as o from {records}), {name}2 as (select record_id, {_listed('o')} as o from {name}1), {name}3 as (select record_id, o, unnest(range(json_array_length(o)::bigint)) as pp from {name}2 where o is not null),
    {name}4 as (select record_id, pp, {_decoded('(o -> pp)')} as el from {name}3), {name}5 as (select record_id, pp, {_decoded(f"(el -> '{inner}')")} as i from {name}4 where json_type(el) = 'OBJECT'), {name}6 as (select record_id, pp, {_listed('i')} as i from {name}5),
    {name}7 as (select record_id, pp, i, unnest(range(json_array_length(i)::bigint)) as cp from {name}6 where i is not null), {name}8 as (select record_id, '{child}' as child, pp::int as parent_pos, cp::int as child_pos, {_decoded('(i -> cp)')} as c from {name}7), {name} as (select * from {name}8 where json_type(c) = 'OBJECT')"""


#: One readable delivery of each record, the last, without its wrapper.
_B3 = f"""b0 as (select record_id, record_kind, received_at, body, try_cast(ltrim(body, chr(65279)) as json) as v from neural_records where record_id is not null), b1 as (select * replace ({_decoded('v')} as v) from b0), b2 as (select * replace ({_decoded('v')} as v) from b1 where v is not null),
  bn as (select *, row_number() over (partition by record_id order by received_at desc nulls last, body desc) as rn from b2 where json_type(v) = 'OBJECT'), b3 as (select record_id, record_kind, v as whole, case when json_type(v -> 'payload') = 'OBJECT' then v -> 'payload' else v end as v from bn where rn = 1)"""
_P1 = f"""with {_B3}, st as (select record_id, record_kind, {_decoded("(v -> 'structure')")} as s from b3), hc as (select record_id, record_kind, v from b3),
  {_children('bt', 'st', "(s -> 'segments')", 'beats', 'beat')}, {_children('df', 'hc', "(v -> 'samples')", 'differences', 'difference')}"""


def _at(record: str, path: str) -> str:
    """The text of the scalar at a path of objects, each of which may be encoded again; null for objects, lists and null."""
    x, parts = record, path.split(".")
    for part in parts[:-1]:
        x = _decoded(f"({x} -> '{part}')")
    x = f"({x} -> '{parts[-1]}')"
    return f"case when json_type({x}) not in ('OBJECT', 'ARRAY', 'NULL') and coalesce(json_type({_decoded(x)}), '') not in ('OBJECT', 'ARRAY') then {x} ->> '$' end"


def _fields(record: str, *paths: str) -> str:
    return ", ".join(f'{_at(record, p)} as "{column_name(p)}"' for p in paths)


def _numbers(record: str, *paths: str) -> str:
    return ", ".join(f'try_cast({_at(record, p)} as double) as "{column_name(p)}"' for p in paths)


_P1_SQL = {
    "p1_found": f"{_P1} select record_id, child, parent_pos, child_pos from bt join b3 using (record_id) where record_kind like 'real_sample%' union all select record_id, child, parent_pos, child_pos from df join b3 using (record_id) where record_kind like 'historical_comparison%'",
    "p1_records": f"with {_B3} select record_id, record_kind, {_fields('v', *[p for p in RECORD if p != 'receipt_sha256'])}, {_fields('whole', 'receipt_sha256')} from b3",
    "p1_beats": f"{_P1} select record_id, parent_pos as segment_pos, child_pos as beat_pos, {_numbers('c', 'time', 'number')} from bt",
    "p1_differences": f"{_P1} select record_id, parent_pos as sample_pos, child_pos as difference_pos, {_fields('c', 'feature', 'missingness_same')}, {_numbers('c', 'archived', 'fresh_cpu', 'absolute_difference')} from df",
    "p1_segments": f"{_P1} select record_id, pp::int as segment_pos, {_numbers('el', 'start', 'end')}, {_fields('el', 'label')} from bt4 where json_type(el) = 'OBJECT'",
    "p1_samples": f"{_P1} select record_id, pp::int as sample_pos, {_fields('el', *SAMPLE)} from df4 where json_type(el) = 'OBJECT'",
    "p1_quality": f"{_P1}, q as (select record_id, null::int as sample_pos, {_fields('v', 'quality.D', 'quality.S', 'quality.R', 'quality.P')} from b3 union all select record_id, pp::int, {_fields('el', 'quality.D', 'quality.S', 'quality.R', 'quality.P')} from df4 where json_type(el) = 'OBJECT') select * from (select record_id, sample_pos, unnest(['D', 'S', 'R', 'P']) as family, unnest([quality__D, quality__S, quality__R, quality__P]) as quality from q) where quality is not null",
    "p1_lists": f"""with {_B3}, x as (select record_id, 'limitations' as list, {_decoded("(v -> 'limitations')")} as l from b3 union all select record_id, 'provenance.limitations', {_decoded("(p -> 'limitations')")} from (select record_id, {_decoded("(v -> 'provenance')")} as p from b3)
        union all select record_id, 'audio_provenance.configuration.window', {_decoded("(c -> 'window')")} from (select record_id, {_decoded("(p -> 'configuration')")} as c from (select record_id, {_decoded("(v -> 'audio_provenance')")} as p from b3))),
      e as (select record_id, list, unnest(range(json_array_length(l)::bigint)) as i, l from x where json_type(l) = 'ARRAY'), f as (select record_id, list, i::varchar as place, (l -> i) as c from e)
      select record_id, list, place, c ->> '$' as value from f where json_type(c) not in ('OBJECT', 'ARRAY', 'NULL')""",
    "p1_features": f"with {_B3}, f as (select record_id, {_decoded("(v -> 'features')")} as f from b3), k as (select record_id, f, unnest(json_keys(f)) as feature from f where json_type(f) = 'OBJECT'), x as (select record_id, feature, {_decoded("json_extract(f, '$.\"' || feature || '\"')")} as v from k) select record_id, feature, try_cast(v ->> '$' as double) as value from x where json_type(v) not in ('NULL', 'OBJECT', 'ARRAY')",
}

_FORMS = {"native30_replay": {"id": ID_FORM, "sha256": SHA_FORM, "feature_file_sha256": SHA_FORM}, "sample_reference_features": {"id": ID_FORM, "feature_file_sha256": SHA_FORM}}


def _profile_sql(t: str) -> str:
    names = ", ".join(repr(n) for n in quality_specs_names(t))
    family = "case split_part(k, '_', 1) when 's8' then 'S' when 'd' then 'D' when 'r' then 'R' when 'p' then 'P' else split_part(k, '_', 1) end"
    expected = (
        "list_distinct(list_filter(string_split_regex(upper(regexp_replace(coalesce(combination, ''), '\\s+', '', 'g')), '[^A-Z]+'), lambda e: e <> ''))" if t == "native30_replay" else "['F', 'H', 'SC']"
    )
    texts = " union all ".join(
        f"""select '{t}' as table_name, load_id, '{c}' as column_name, count(*) as rows, count(*) filter (trim(coalesce({c}, '')) = '') as missing, count(distinct {c}) filter (trim({c}) <> '') as distinct_values,
        count(*) filter (trim({c}) <> '' and not regexp_matches({c}, '{form}')) as violations, null::double as lowest, null::double as highest, null::double as average, null::double as deviation, coalesce((select max(n) from (select count(*) n from {t} z where z.load_id = {t}.load_id and trim(z.{c}) <> '' group by z.{c})), 0) as top from {t} group by load_id"""
        for c, form in _FORMS[t].items()
    )
    return f"""select * from (with x as (select load_id, unnest(map_keys(features)) as k, unnest(map_values(features)) as v from {t}), u as (select load_id, k, v, count(*) as n from x where v is not null and isfinite(v) and v <> -999 group by 1, 2, 3),
      w as (select load_id, fam, count(*) as n from (select load_id, unnest({expected}) as fam from {t}) group by 1, 2), cols as (select k, {family} as fam from (select unnest([{names}]) as k)),
      s as (select load_id, k, sum(n)::bigint as used, count(*) as dv, min(v) as lo, max(v) as hi, sum(v * n) / sum(n) as av, sqrt(greatest(sum(v * v * n) / sum(n) - (sum(v * n) / sum(n)) * (sum(v * n) / sum(n)), 0)) as sd, max(n) as top from u group by 1, 2)
      select '{t}' as table_name, w.load_id, cols.k as column_name, greatest(w.n, coalesce(used, 0))::bigint as rows, (greatest(w.n, coalesce(used, 0)) - coalesce(used, 0))::bigint as missing, coalesce(dv, 0) as distinct_values, null::bigint as violations, lo as lowest, hi as highest, av as average, sd as deviation, coalesce(s.top, 0) as top
      from w join cols using (fam) left join s on s.load_id = w.load_id and s.k = cols.k) union all {texts}"""


def quality_specs_names(t: str) -> list[str]:
    return [*S_NAMES, *DRP_NAMES, *FHSC_NAMES, *BC_NAMES] if t == "native30_replay" else FHSC_NAMES


_ROUNDED = "table_name, load_id, column_name, rows, missing, distinct_values, violations, lowest, highest, case when average is not null then printf('%.6e', average) end as average, top"


def oracle_sql() -> dict[str, str]:
    return {**_P1_SQL, "p5_profile": f"select {_ROUNDED} from ({_profile_sql('native30_replay')} union all {_profile_sql('sample_reference_features')})"}
