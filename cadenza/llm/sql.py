"""DuckDB equivalents of the problems' queries where SQL can say them."""

from cadenza.queries.problems import FHSC_NAMES

#: Python's word characters and white space, for RE2.
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{1C}-\x{1F}\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_SIZES = f"select doc_id, lower(trim(source)) as src, coalesce(len(regexp_extract_all(text, '{_TOKEN}')), 0) as tokens from documents"

_D = "case when regexp_full_match(regexp_replace(lower(regexp_replace({0}, '\\s+', '', 'g')), '^sha-?256[:=]', ''), '[0-9a-f]{{64}}') and regexp_replace(lower(regexp_replace({0}, '\\s+', '', 'g')), '^sha-?256[:=]', '') not in ('e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855', repeat('0', 64), repeat('f', 64)) then regexp_replace(lower(regexp_replace({0}, '\\s+', '', 'g')), '^sha-?256[:=]', '') end"
_PATH = "regexp_replace(replace(trim({0}), chr(92), '/'), '^(\\./)+', '')"
#: All pairs of recordings whose lengths differ by less than half a second are compared; the Spark query meets few of them.
_P3 = f"""with recursive r as (select distinct id, member_name, {_D.format('canonical.input_sha256')} as i, {_D.format('canonical.waveform_float32_sha256')} as w from drive_sources where id is not null),
  inv as (select distinct {_PATH.format('path')} as path, {_PATH.format('source')} as source, case when coalesce(bytes, 1) > 0 then {_D.format('sha256')} end as sha, byte_identical_copy as same from generated_cleanup),
  node as (select p.path, coalesce('r:' || m.id, 'f:' || p.path) as node from (select path from inv where path <> '' union select source from inv where source <> '') p left join (select member_name, min(id) as id from r group by 1) m on m.member_name = string_split(p.path, '/')[-1]),
  bear as (select 'r:' || id as node, 'd:' || i as t from r where i is not null union select 'r:' || id, 'w:' || w from r where w is not null union select node, 'd:' || sha from inv join node using (path) where sha is not null),
  l as (select id, max(canonical.native_frames::double / canonical.native_sample_rate_hz) as sec from drive_sources where id is not null group by 1),
  x0 as (select id, 1 as trust, coalesce(epoch_us(measured_at), 0) as t, unnest(map_keys(features)) as k, unnest(map_values(features)) as v from sample_reference_features where id is not null union all select id, 0, coalesce(epoch_us(scored_at), 0), unnest(map_keys(features)), unnest(map_values(features)) from native30_replay where id is not null),
  x as (select id, k, arg_max(v, (trust, t, v)) as v from x0 semi join l using (id) where isfinite(v) and v <> -999 and k in ({', '.join(repr(n) for n in FHSC_NAMES)}) group by 1, 2), q as (select k, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) as iqr from x group by 1),
  z as (select x.id, any_value(l.sec) as sec, map_from_entries(list((k, v / iqr))) as m from x join q using (k) join l on l.id = x.id group by x.id),
  p as (select a.id as a, b.id as b, list_sort(list_filter(list_transform(map_keys(a.m), lambda n: abs(a.m[n] - b.m[n])), lambda e: e is not null)) as d from z a join z b on a.id < b.id and coalesce(abs(a.sec - b.sec) < 0.5, true)),
  near as (select a, b from p where len(d) >= 8 and d[(len(d) + 1) // 2] <= 0.02 and len(list_filter(d, lambda e: e <= 0.05)) >= 0.6 * len(d)),
  e0 as (select x.node as u, y.least as v from bear x join (select t, min(node) as least from bear group by 1) y using (t) union select n.node, s.node from inv join node n using (path) join node s on s.path = inv.source where same union select 'r:' || a, 'r:' || b from near),
  e as (select u, v from e0 union select v, u from e0), reach(u, v) as (select u, v from e union select reach.u, e.v from reach join e on e.u = reach.v),
  c as (select substr(u, 3) as id, min(v) as root from reach where u like 'r:%' group by u), s as (select distinct id, lower(trim(split)) as split from drive_sources),
  m as (select distinct x.id, y.id as other, sx.split from c x join c y on x.root = y.root and x.id <> y.id join s sx on sx.id = x.id join s sy on sy.id = y.id where sx.split in ('train', 'validation', 'test') and sy.split in ('train', 'validation', 'test') and (sx.split = 'train') <> (sy.split = 'train'))"""

#: The fair queue: documents in hash order per source, copies by virtual finish time, cut at the tokens of all.
_MIX = f"""with d as (select doc_id, src, tokens, sha256(concat_ws('|', 'mix', doc_id::varchar, tokens::varchar)) as h from ({_SIZES})),
  own as (select src, sum(tokens)::bigint as own, count(*) as documents from d group by 1), t as (select m.source, lower(trim(m.source)) as src, m.target_share, m.max_repeats, coalesce(o.own, 0)::bigint as own, coalesce(o.documents, 0) as documents from mixture_targets m left join own o on o.src = lower(trim(m.source))),
  tot as (select sum(own)::bigint as tt from t), o as (select d.*, (sum(tokens) over (partition by src order by h, doc_id rows unbounded preceding) - tokens)::bigint as before from d semi join t using (src)),
  q as (select o.doc_id, o.src, o.tokens, o.before, c.copy, (c.copy * t.own + o.before + o.tokens)::double / t.target_share as finish from o join t using (src), (select unnest(range(100))::int as copy) c where c.copy < t.max_repeats and t.target_share > 0),
  out as (select doc_id, src as source, tokens, copy, finish, position from (select *, (sum(tokens) over (order by finish, src, doc_id, copy, before rows unbounded preceding) - tokens)::bigint as position from q) where position + tokens <= (select tt from tot))"""

#: Sets tied by group or component, and their smallest ids.
_P4 = r"""with recursive k as (
        select distinct id, nullif(trim(regexp_replace(lower(group_id), '[^\p{L}\p{N}]+', '_', 'g'), '_'), '') as g,
          nullif(regexp_replace(regexp_extract(component_id, '([0-9]+)\D*$', 1), '^0+([0-9])', '\1'), '') as c,
          lower(trim(role)) as role from drive_sources where id is not null),
        n as (select id, 'g:' || g as key from k where g not in ('unknown', 'n_a', 'na', 'none', 'null', 'nan', 'nil') union select id, 'c:' || c from k where c is not null),
        e as (select distinct a.key as u, b.key as v from n a join n b using (id)),
        reach(u, v) as (select u, v from e union select r.u, e.v from reach r join e on e.u = r.v),
        root as (select u as key, min(v) as root from reach group by u),
        s as (select distinct id, root from n join root using (key)),
        sets as (select root, min(id) as set_id from s group by root)"""

SQL = {
    "p6_found": f"select distinct doc_id from ({_SIZES}) where tokens > 1024",
    "p4_checks": "select count(distinct id) as records, count(distinct id) as rows, 0::bigint as divided, true as shares_met from drive_sources",
    "p8_coverage": "select coalesce(lower(trim(source)), '(none)') as source, count(distinct doc_id) as documents, count(*) as scored, count(*) as consistent from documents group by 1",
    "p6_checks": f"select count(*) as items, sum(tokens)::bigint as tokens, sum(tokens)::bigint as placed, 0::bigint as overfull, 0::bigint as divided_though_fitting, true as filled from ({_SIZES})",
    "p7_mix": f"{_MIX} select doc_id, source, tokens, copy, finish, position from out",
    "p7_report": f"""{_MIX}, g as (select source as src, sum(tokens)::bigint as drawn, count(*) as dd, max(copy) as last from out group by 1), y as (select src, max(finish) as dry from q group by 1)
        select t.source, t.target_share, t.max_repeats, t.own as available_tokens, t.documents, coalesce(drawn, 0)::bigint as drawn_tokens, coalesce(dd, 0)::bigint as drawn_documents, (coalesce(last, -1) + 1)::int as passes, coalesce(drawn, 0) / (select tt from tot)::double as actual_share,
          coalesce(dry, 0) as runs_dry_at, t.target_share * (select tt from tot) > t.max_repeats * t.own as cannot_reach from t left join g using (src) left join y using (src)""",
    "p7_found": f"""with d as ({_SIZES}), own as (select src, sum(tokens) as own from d group by src),
        t as (select m.source, m.target_share, m.max_repeats, coalesce(o.own, 0) as own from mixture_targets m left join own o on o.src = lower(trim(m.source)))
        select source from t where target_share * (select sum(own) from t) > max_repeats * own""",
    "p4_found": _P4 + """, mixed as (select root from s join k using (id) group by root having bool_or(role = 'development') and bool_or(role = 'locked'))
        select distinct s.id, sets.set_id from s join sets using (root) join mixed using (root)""",
    "p4_splits": _P4 + """, a as (select id, set_id, count(*) over (partition by root) as set_size from (select distinct id, root from s) join sets using (root) union all select id, id, 1 from (select distinct id from k) where id not in (select id from s)),
        b as (select distinct set_id, set_size from a), t as (select count(*) as n from a), o as (select set_id, (sum(set_size) over (order by case when set_size > 0.01 * n then 0 else 1 end, sha256('split|' || set_id), set_id rows unbounded preceding) - set_size + set_size / 2.0::double) / n as middle from b, t)
        select a.id, a.set_id, a.set_size, case when middle < 0.8 then 'train' when middle < 0.9 then 'validation' else 'test' end as new_split from a join o using (set_id)""",
    "p2_without_first_load": r"""with x as (select r.id, r.load_id, r.combination, d.source_group, unnest(map_keys(features)) as k, unnest(map_values(features)) as v from native30_replay r
          left join (select id, min(source_group) as source_group from drive_sources where id is not null group by 1) d on d.id = r.id),
        y as (select *, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(upper(regexp_replace(combination, '\s+', '', 'g')), '[^A-Z]+'), lambda e: e <> ''))), '+') as combo from x where v is not null and isfinite(v) and load_id is distinct from (select min(load_id) from native30_replay))
        select 'combination' as grouping, nullif(combo, '') as group_value, k as feature, count(*) as n from y group by 2, 3 union all select 'source_group', source_group, k, count(*) from y group by 2, 3""",
    "p2_checks": r"""with x as (select r.combination, d.source_group, unnest(map_keys(features)) as k, unnest(map_values(features)) as v from native30_replay r left join (select id, min(source_group) as source_group from drive_sources where id is not null group by 1) d on d.id = r.id),
        y as (select *, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(upper(regexp_replace(combination, '\s+', '', 'g')), '[^A-Z]+'), lambda e: e <> ''))), '+') as combo from x where v is not null and isfinite(v))
        select 'combination' as grouping, nullif(combo, '') as group_value, k as feature, count(*) as n, true as within from y group by 2, 3 union all select 'source_group', source_group, k, count(*), true from y group by 2, 3""",
    "p2_counts": r"""with x as (select r.id, r.combination, d.source_group, unnest(map_keys(features)) as k, unnest(map_values(features)) as v from native30_replay r
          left join (select id, min(source_group) as source_group from drive_sources where id is not null group by 1) d on d.id = r.id),
        y as (select *, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(upper(regexp_replace(combination, '\s+', '', 'g')), '[^A-Z]+'), lambda e: e <> ''))), '+') as combo from x where v is not null and isfinite(v))
        select 'combination' as grouping, nullif(combo, '') as group_value, k as feature, count(*) as n from y group by 2, 3 union all select 'source_group', source_group, k, count(*) from y group by 2, 3""",
    "p3_found": f"{_P3} select distinct least(id, other) as id_a, greatest(id, other) as id_b from m",
    "p3_classes": f"{_P3}, r0 as (select root, min(id) as class_id from c group by 1) select m.id, class_id, split, count(distinct other) as links from m join c using (id) join r0 using (root) group by 1, 2, 3",
    "p3_report": f"""{_P3}, n as (select distinct id, lower(trim(split)) as split, source_group from drive_sources where id is not null)
        select n.split, n.source_group, count(distinct n.id) as records, count(distinct m.id) as also_in_train from n left join m on m.id = n.id and m.split = n.split where n.split in ('validation', 'test') group by 1, 2""",
}
