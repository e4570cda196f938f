"""Queries of windows, sequences, rankings and selections (WIN, TOP)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions.hashing import rank_key
from cadenza.operators import metrics as m
from cadenza.operators import relational as r
from cadenza.operators import sequences as s
from cadenza.operators.metrics import six
from cadenza.queries._cohort import C, cohort
from cadenza.queries.aggregates import FOLD, WEIGHTS, with_fold
from cadenza.registry import Registry

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
#: Frames of a recording: index n within the user, flags a (active) and v (valid).
FR = "fr as (select user_id, id, value, k, score, row_number() over (partition by user_id order by ts, id) - 1 as n, k % 3 <> 0 as a, k % 11 <> 0 as v from c)"
H = "sha256('20260907|' || {})"


def frames(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "id")) - 1
    return cohort(spark, d).select("user_id", "id", "value", "k", "score", n.cast("bigint").alias("n"), (F.col("k") % 3 != 0).alias("a"), (F.col("k") % 11 != 0).alias("v"))


@R(f"with {C} select id, rank() over (partition by source_group order by score) + (count(*) over (partition by source_group, score) - 1) / 2.0::double as rank from c")
def win_01_average_rank(spark: SparkSession, d: str) -> DataFrame:
    return m.with_average_rank(cohort(spark, d).select("id", "source_group", "score"), "score", ["source_group"]).select("id", "rank")


@R(f"with {C}, g as (select user_id, k % 12 as p, median(value) md from c group by 1, 2) select id, round(value - md, 6) as centred from c join g on g.user_id = c.user_id and g.p = c.k % 12")
def win_02_median_centring(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).select("id", "user_id", (F.col("k") % 12).alias("p"), "value")
    return c.join(c.groupBy("user_id", "p").agg(F.median("value").alias("md")), ["user_id", "p"]).select("id", six(F.col("value") - F.col("md"), "centred"))


@R(f"with {C} select id, round(value - lag(value) over w, 6) as step, round(abs(value - coalesce(lag(value) over w, value)), 6) as change from c window w as (partition by user_id order by ts, id)")
def win_03_first_difference(spark: SparkSession, d: str) -> DataFrame:
    lag = F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "id"))
    return cohort(spark, d).select("id", six(F.col("value") - lag, "step"), six(F.abs(F.col("value") - F.coalesce(lag, F.col("value"))), "change"))


@R(f"with {C}, {FR}, e as (select user_id, a and not coalesce(lag(a) over (partition by user_id order by n), false) as e from fr) select user_id, count(*) filter (e) as bursts from e group by 1")
def win_04_rising_edges(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    e = F.col("a") & ~F.coalesce(F.lag("a").over(W.partitionBy("user_id").orderBy("n")), F.lit(False))
    return f.select("user_id", e.alias("e")).groupBy("user_id").agg(F.count_if("e").alias("bursts"))


@R(f"with {C}, {FR}, g as (select user_id, n, n - row_number() over (partition by user_id order by n) as g from fr where a) select user_id, min(n) as first, max(n) as last, count(*) as length from g group by user_id, g")
def win_05_true_runs(spark: SparkSession, d: str) -> DataFrame:
    return s.true_runs(frames(spark, d), ["user_id"], "n", F.col("a"))


@R(f"""with {C}, {FR}, g as (select user_id, n, n - row_number() over (partition by user_id order by n) as g from fr where a), t as (select user_id, min(n) as f, max(n) as l from g group by user_id, g having count(*) >= 4),
  w as (select user_id, f, l, unnest(list_distinct(list_concat(range(f, l - 3 + 1, 2), [l - 3]))) as start from t) select user_id, start from w""")
def win_06_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    t = s.true_runs(frames(spark, d), ["user_id"], "n", F.col("a")).where("length >= 4")
    return t.select("user_id", F.explode(s.window_starts(F.col("first"), F.col("last"), 4, 2)).alias("start"))


@R(f"""with {C}, {FR}, b as (select *, sum(case when v then 0 else 1 end) over (partition by user_id order by n) as bad from fr), x as (select *, case when n - lag(n) over w - 1 > 3 or bad <> lag(bad) over w then 1 else 0 end as new from b where a and v window w as (partition by user_id order by n)), g as (select *, sum(new) over (partition by user_id order by n) g from x)
  select user_id, min(n) as first, max(n) as last from g group by user_id, g having max(n) - min(n) + 1 >= 3""")
def win_07_gap_filling(spark: SparkSession, d: str) -> DataFrame:
    return s.fill_gaps(frames(spark, d), ["user_id"], "n", F.col("a"), F.col("v"), 3, 3)


IV = "iv as (select user_id, value * 20 as s, value * 20 + k + 1 as e from c)"


@R(f"with {C}, {IV}, x as (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) m from iv), g as (select *, sum(case when s < m then 0 else 1 end) over (partition by user_id order by s, e rows unbounded preceding) g from x) select user_id, round(min(s), 6) as start, round(max(e), 6) as end, count(*) as parts from g group by user_id, g")
def win_08_interval_merge(spark: SparkSession, d: str) -> DataFrame:
    iv = cohort(spark, d).select("user_id", (F.col("value") * 20).alias("s"), (F.col("value") * 20 + F.col("k") + 1).alias("e"))
    return s.merge_intervals(iv, ["user_id"], "s", "e").select("user_id", six("start", "start"), six("end", "end"), "parts")


@R(f"with {C}, l as (select user_id, list_sort(list(value::double)) as t from c group by 1) select user_id, len(t)::int as notes, len(list_reduce(list_transform(t, lambda x: [x]), lambda a, x: case when x[1] - a[-1] > 0.5 then list_concat(a, x) else a end))::int as chords from l")
def win_09_chord_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Onsets per recording within 0.5 of the first of a cluster are one chord."""
    c = cohort(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.col("value").cast("double"))).alias("t"))
    return c.select("user_id", F.size("t").alias("notes"), F.size(s.anchor_clusters(F.col("t"), 0.5)).alias("chords"))


@R(f"""with {C}, l as (select user_id, list_sort(list_distinct(list(least(greatest(value::double, 0), 30)))) as t from c group by 1), k as (select user_id, list_reduce(list_concat([[0.0::double]], list_transform(list_filter(t, lambda x: x >= 1 and x <= 29), lambda x: [x])), lambda a, x: case when x[1] - a[-1] >= 1 then list_concat(a, x) else a end) as b from l)
  select user_id, len(b)::int + 1 as boundaries, round(list_sum(list_concat(b, [30.0::double])), 6) as total from k""")
def win_10_clean_boundaries(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).groupBy("user_id").agg(F.collect_list(F.col("value").cast("double")).alias("t"))
    b = c.select("user_id", s.clean_boundaries(F.col("t"), 30.0).alias("b"))
    return b.select("user_id", F.size("b").alias("boundaries"), six(F.aggregate("b", F.lit(0.0), lambda a, x: a + x), "total"))


@R(f"""with {C}, {FR}, x as (select user_id, n, k, lag(k) over w as before, lag(n) over w as n0 from fr where v window w as (partition by user_id order by n)) select user_id, n, before, k as after, round(k::double / nullif(before, 0), 6) as ratio, k = 2 * before or before = 2 * k as half_or_double from x where n - n0 = 1 and k <> before""")
def win_11_transitions(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("n")
    x = frames(spark, d).where("v").select("user_id", "n", "k", F.lag("k").over(w).alias("before"), F.lag("n").over(w).alias("n0")).where("n - n0 = 1 and k <> before")
    return x.select("user_id", "n", "before", F.col("k").alias("after"), F.round(F.try_divide(F.col("k").cast("double"), F.col("before").cast("double")), 6).alias("ratio"), ((F.col("k") == 2 * F.col("before")) | (F.col("before") == 2 * F.col("k"))).alias("half_or_double"))


@R(f"with {C}, {FR} select user_id, (n // 8)::bigint as block, round(avg(value) filter (v), 6) as mean from fr group by 1, 2 having count(*) filter (v) >= 6")
def win_12_tumbling_blocks(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).groupBy("user_id", F.floor(F.col("n") / 8).alias("block")).agg(six(F.avg(F.when(F.col("v"), F.col("value"))), "mean"), F.count_if("v").alias("m")).where("m >= 6").drop("m")


@R(f"with {C}, {FR}, f as (select *, count(*) over (partition by user_id) total from fr) select user_id, (n // 4)::bigint as pool, round(sum(value), 6) as total from f where n < total - total % 4 and n % 4 + 1 <= 4 group by 1, 2")
def win_13_whole_pools(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    g = f.groupBy("user_id", F.floor(F.col("n") / 4).alias("pool")).agg(six(F.sum("value"), "total"), F.count(F.lit(1)).alias("m"))
    return g.where("m = 4").drop("m")


@R("with e as (select vec_id, embedding, unnest(range(0, 64 - 16 + 1, 8)) as s from embeddings) select vec_id, s as start, round(list_sum(list_transform(embedding[s + 1 : s + 16], lambda x: x::double * x::double)), 6) as power from e")
def win_14_overlapping_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of 16 every 8 over each vector."""
    from cadenza.session import table

    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(48).cast("bigint"), F.lit(8).cast("bigint"))).alias("start"))
    p = F.aggregate(F.slice("embedding", (F.col("start") + 1).cast("int"), 16), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return e.select("vec_id", "start", six(p, "power"))


@R(f"with {C}, {FR} select id, round((coalesce(lag(value) over w, 0) + value + coalesce(lead(value) over w, 0)) / 3, 6) as smooth from fr window w as (partition by user_id order by n)")
def win_15_moving_average(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("n")
    return frames(spark, d).select("id", six((F.coalesce(F.lag("value").over(w), F.lit(0.0)) + F.col("value") + F.coalesce(F.lead("value").over(w), F.lit(0.0))) / 3, "smooth"))


@R(f"with {C}, {FR}, x as (select *, first_value(value) over (partition by user_id order by n) f, last_value(value) over (partition by user_id order by n rows between unbounded preceding and unbounded following) l from fr) select id, round(list_sort([coalesce(lag(value, 2) over w, f), coalesce(lag(value) over w, f), value, coalesce(lead(value) over w, l), coalesce(lead(value, 2) over w, l)])[3], 6) as median5 from x window w as (partition by user_id order by n)")
def win_16_rolling_median(spark: SparkSession, d: str) -> DataFrame:
    """Median of five with the edges repeated."""
    w = W.partitionBy("user_id").orderBy("n")
    f, z = F.first("value").over(w), F.last("value").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    five = F.array_sort(F.array(F.coalesce(F.lag("value", 2).over(w), f), F.coalesce(F.lag("value").over(w), f), F.col("value"), F.coalesce(F.lead("value").over(w), z), F.coalesce(F.lead("value", 2).over(w), z)))
    return frames(spark, d).select("id", six(five[2], "median5"))


@R("""with v as (select vec_id, list_transform(embedding, lambda x: abs(x::double)) as v from embeddings), a as (select vec_id, v, list_sort(list_distinct(list_transform(range(60), lambda s: s + list_position(v[s + 1 : s + 5], list_min(v[s + 1 : s + 5])) - 1))) as low from v),
  p as (select vec_id, v, low, unnest(range(64)) as i from a), q as (select vec_id, i, v[i + 1] as x, v, coalesce(list_max(list_filter(low, lambda k: k <= i)), low[1]) as l, coalesce(list_min(list_filter(low, lambda k: k >= i)), low[-1]) as r from p),
  d as (select vec_id, i, greatest(x - case when l >= r then v[l + 1] else v[l + 1] + (v[r + 1] - v[l + 1]) * (i - l) / (r - l)::double end, 0) as d from q) select vec_id, i::int as place, round(d / nullif(sum(d) over (partition by vec_id), 0), 6) as residual from d""")
def win_17_lower_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Values above the line through the least of each five neighbours, as a share of their sum."""
    from cadenza.functions.signal import lower_envelope_residual
    from cadenza.session import table

    r = table(spark, d, "embeddings").select("vec_id", lower_envelope_residual(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("r"))
    return r.select("vec_id", F.posexplode("r").alias("place", "residual")).withColumn("residual", F.round("residual", 6))


@R()
def win_18_find_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Peaks by height, then distance, then prominence."""
    from cadenza.functions.signal import peak_places
    from cadenza.session import table

    return table(spark, d, "embeddings").select("vec_id", peak_places(F.transform("embedding", lambda x: x.cast("double"))).alias("peaks"))


TURN = ", ".join("round(avg(" + " + ".join(f"a.v[{(c - t) % 12 + 1}] * b.v[{c + 1}]" for c in range(12)) + f") over w, 9) as t{t}" for t in range(12))


@R(f"""with {C}, {FR}, u as (select user_id, n, v as ok, list_transform(range(12), lambda i: 1.0::double + (k * (i + 3) + i * i) % 12) as r from fr), b as (select user_id, n, list_transform(r, lambda x: x / sqrt(list_sum(list_transform(r, lambda y: y * y)))) as v from u where ok),
  p as (select a.user_id, l.lag, a.n, count(*) over w as m, {TURN} from b a, (select unnest(range(8, 13)) as lag) l, b where b.user_id = a.user_id and b.n = a.n + l.lag window w as (partition by a.user_id, l.lag order by a.n range between current row and 3 following))
  select user_id, lag::int as lag, count(*) as patterns, round(quantile_cont(greatest({', '.join(f't{t}' for t in range(12))}), 0.9), 6) as peak, count(*) filter (greatest({', '.join(f't{t}' for t in range(12))}) >= 0.88) as returning from p where m = 4 group by 1, 2""")
def win_19_lagged_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How patterns of four frames return 8 to 12 frames later, in any turn of their twelve classes."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: 1.0 + (F.col("k") * (i + 3) + i * i) % 12)
    f = frames(spark, d).select("user_id", "n", "v", raw.alias("r"))
    f = f.withColumn("c", F.transform("r", lambda x: x / F.sqrt(F.aggregate("r", F.lit(0.0), lambda a, y: a + y * y))))
    x = s.lagged_similarity(f, ["user_id"], "n", "c", F.col("v"), range(8, 13))
    return x.groupBy("user_id", "lag").agg(F.count(F.lit(1)).alias("patterns"), six(F.percentile("similarity", F.lit(0.9)), "peak"), F.count_if(F.col("similarity") >= 0.88).alias("returning"))


@R(f"with {C}, g as (select distinct source_group, group_id, {H.format('group_id')} as h from c), x as (select *, dense_rank() over (partition by source_group order by h, group_id) r from g) select c.source_group, count(*) as rows, count(distinct c.group_id) as groups from c join x using (source_group, group_id) where r <= 10 group by 1")
def win_20_first_groups_by_hash(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d)
    g = c.select("source_group", "group_id").distinct()
    top = r.top_per_group(g, ["source_group"], [rank_key(F.col("group_id")), F.col("group_id")], 10)
    return c.join(top, ["source_group", "group_id"]).groupBy("source_group").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("group_id").alias("groups"))


@R(f"""with {C}, g as (select {FOLD} as fold, group_id, {H.format('group_id')} as h, list_distinct(list(source_group)) as src from c group by 1, 2, 3), k as (select list_sort(list_distinct(list(source_group))) as names from c),
  e as (select fold, group_id, h, cap, list_transform(names, lambda n: list_contains(src, n)::int) as own from g, k, (select unnest([25, 50, 100]) as cap)),
  l as (select fold, list({{'used': list_transform(own, lambda v: 0), 'taken': []::varchar[], 'out': []::struct(g varchar, cap int)[], 'own': own, 'g': group_id, 'cap': cap}} order by cap, h, group_id) as e from e group by 1),
  r as (select fold, list_reduce(list_concat([{{'used': e[1].used, 'taken': []::varchar[], 'out': []::struct(g varchar, cap int)[], 'own': e[1].own, 'g': '', 'cap': 0}}], e), lambda a, x: case when list_contains(a.taken, x.g) or len(list_filter(list_zip(a.used, x.own), lambda z: z[2] = 1 and z[1] >= x.cap)) > 0 then a
    else {{'used': list_transform(list_zip(a.used, x.own), lambda z: z[1] + z[2]), 'taken': list_append(a.taken, x.g), 'out': list_append(a.out, {{'g': x.g, 'cap': x.cap}}), 'own': x.own, 'g': x.g, 'cap': x.cap}} end).out as o from l)
  select fold, u.g as group_id, u.cap as cap from (select fold, unnest(o) as u from r)""")
def win_21_coupled_caps(spark: SparkSession, d: str) -> DataFrame:
    """Nested caps of 25, 50 and 100 groups per source and fold."""
    g = with_fold(cohort(spark, d)).select("fold", "group_id", "source_group", rank_key(F.col("group_id")).alias("order")).distinct()
    return s.coupled_caps(g, ["fold"], [25, 50, 100])


@R(f"""with {C}, x as (select id, source_group, group_id, row_number() over (partition by source_group, group_id order by {H.format('id::varchar')}) a from c), y as (select *, row_number() over (partition by source_group order by a, {H.format('group_id')}, id) o from x where a <= 2) select source_group, id from y where o <= 20""")
def win_22_balanced_pick(spark: SparkSession, d: str) -> DataFrame:
    c = cohort(spark, d).select("id", "source_group", "group_id")
    x = r.top_per_group(c, ["source_group", "group_id"], [rank_key(F.col("id").cast("string"))], 2).withColumn("a", F.row_number().over(W.partitionBy("source_group", "group_id").orderBy(rank_key(F.col("id").cast("string")))))
    return r.top_per_group(x, ["source_group"], [F.col("a"), rank_key(F.col("group_id")), F.col("id")], 20).select("source_group", "id")


@R(f"with {C} select group_id, arg_min(id, {H.format('id::varchar')}) as id from c group by 1")
def win_23_least_hash_per_key(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).groupBy("group_id").agg(F.min_by("id", rank_key(F.col("id").cast("string"))).alias("id"))


@R(f"""with {C}, x as (select id, source_group, {H.format('id::varchar')} h, row_number() over (partition by source_group order by {H.format('id::varchar')}) p from c), y as (select *, row_number() over (order by case when p <= 4 then 0 else 1 end, h) o from x) select id, p <= 4 as first_pass from y where o <= 50""")
def win_24_capped_then_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Four of each style in hash order, then the rest until 50 are taken: a global top 50, no window over all rows."""
    h = rank_key(F.col("id").cast("string"))
    c = cohort(spark, d).select("id", "source_group", h.alias("h"))
    first = r.top_per_group(c, ["source_group"], [F.col("h")], 4).select("id", F.lit(True).alias("first_pass"))
    x = c.join(first, "id", "left").withColumn("first_pass", F.coalesce("first_pass", F.lit(False)))
    return x.orderBy(F.desc("first_pass"), "h").limit(50).select("id", "first_pass")


@R(f"with {C} select source_group, id, value from (select *, row_number() over (partition by source_group order by value desc, id) o from c) where o <= 5")
def win_25_head_per_group(spark: SparkSession, d: str) -> DataFrame:
    return r.top_per_group(cohort(spark, d), ["source_group"], [F.desc("value"), F.col("id")], 5).select("source_group", "id", "value")


@R(f"""with {C}, p as (select component_id, source_group, count(*) n, sum(label) pos from c group by 1, 2), t as (select source_group, sum(n)::bigint n, sum(pos)::bigint pos from p group by 1) select p.component_id, p.source_group, p.n as held, t.n - p.n as kept, t.pos - p.pos as kept_positive from p join t using (source_group)""")
def win_26_leave_group_out(spark: SparkSession, d: str) -> DataFrame:
    """Each group left out in turn: what remains is the total less the group's own, so no fold repeats the rows."""
    p = cohort(spark, d).groupBy("component_id", "source_group").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    t = p.groupBy("source_group").agg(F.sum("n").alias("tn"), F.sum("pos").alias("tp"))
    return p.join(t, "source_group").select("component_id", "source_group", F.col("n").alias("held"), (F.col("tn") - F.col("n")).alias("kept"), (F.col("tp") - F.col("pos")).alias("kept_positive"))


@R(f"with {C} select id, {H.format('id::varchar')} as key from c order by 2 limit 25")
def top_01_least_hashes(spark: SparkSession, d: str) -> DataFrame:
    return cohort(spark, d).select("id", rank_key(F.col("id").cast("string")).alias("key")).orderBy("key").limit(25)


@R(f"with {C}, s as (select source_group, role, round(avg(score), 2) as v, count(distinct group_id) as parts from c group by 1, 2) select source_group, role from s where v >= (select max(v) from s) - 1e-12 order by parts, source_group, role limit 1")
def top_02_best_within_tolerance(spark: SparkSession, d: str) -> DataFrame:
    x = cohort(spark, d).groupBy("source_group", "role").agg(F.round(F.avg("score"), 2).alias("v"), F.count_distinct("group_id").alias("parts"))
    best = x.agg(F.max("v").alias("best"))
    return x.join(F.broadcast(best), F.col("v") >= F.col("best") - 1e-12).orderBy("parts", "source_group", "role").limit(1).select("source_group", "role")


EVIDENCE = "ev as (select id, pos, name, c from (select id, unnest([1, 2, 3, 4]) as pos, unnest(['f1', 'f2', 'f3', 'f4']) as name, unnest([f1 * 0.01, f2 * -1.5, f3 * 0.05, f4 * -0.1]) as c from c) where c is not null)"


def evidence(c: DataFrame) -> DataFrame:
    part = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), (F.col(n) * w).alias("c")) for i, (n, w) in enumerate((("f1", 0.01), ("f2", -1.5), ("f3", 0.05), ("f4", -0.1)), 1)])).alias("e")
    return c.select("id", part).select("id", "e.pos", "e.name", "e.c").where("c is not null")


@R(f"with {C}, {EVIDENCE}, r as (select *, row_number() over (partition by id order by abs(c) desc, pos) o from ev) select id, o as rank, name, round(c, 6) + 0.0 as contribution from r where o <= 3")
def top_03_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The three largest contributions of each record: its few parts are sorted as one array, without a shuffle."""
    one = F.array(*[F.struct((-F.abs(F.col(n) * w)).alias("a"), F.lit(i).alias("pos"), F.lit(n).alias("name"), (F.col(n) * w).alias("c")) for i, (n, w) in enumerate((("f1", 0.01), ("f2", -1.5), ("f3", 0.05), ("f4", -0.1)), 1)])
    top = F.slice(F.array_sort(F.filter(one, lambda x: x["c"].isNotNull())), 1, 3)
    x = cohort(spark, d).select("id", F.posexplode(top).alias("o", "e"))
    return x.select("id", (F.col("o") + 1).cast("bigint").alias("rank"), "e.name", six("e.c", "contribution"))


@R(f"with {C} select id, row_number() over (order by list_position(['purchase', 'error', 'view', 'click'], source_group) nulls first, lpad(id::varchar, 10, '0')) as place from c")
def top_04_canonical_sort(spark: SparkSession, d: str) -> DataFrame:
    """Rows in canonical source order; places come from ranges: each source's rows are cut into ranges of the id."""
    from cadenza.session import with_running_total

    place = F.array_position(F.array(*[F.lit(x) for x in ("purchase", "error", "view", "click")]), F.col("source_group"))
    x = cohort(spark, d).select("id", F.coalesce(place, F.lit(0)).alias("o"))
    step = ((x.agg(F.max("id")).first()[0] or 0) >> 10) + 1
    y = with_running_total(x, [], (F.col("o") * 1024 + F.floor(F.col("id") / step)).cast("int"), [F.lpad(F.col("id").cast("string"), 10, "0")], F.lit(1), "before")
    return y.select("id", (F.col("before") + 1).alias("place"))


@R("with e as (select vec_id, unnest(range(64)) as i, unnest(list_transform(embedding, lambda x: round(x::double * x::double, 9))) as p from embeddings), r as (select *, row_number() over (partition by vec_id order by p desc, i) o from e) select vec_id, string_agg(i::varchar, ',' order by o) as strongest from r where o <= 16 group by 1")
def top_05_strongest_bins(spark: SparkSession, d: str) -> DataFrame:
    from cadenza.session import table

    x = F.transform("embedding", lambda v, i: F.struct((-F.round(v.cast("double") * v.cast("double"), 9)).alias("p"), i.alias("i")))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(F.slice(F.array_sort(x), 1, 16), lambda e: e["i"].cast("string")), ",").alias("strongest"))


@R(f"with {C} select label, id from (select label, id, row_number() over (partition by label order by {H.format('id::varchar')}) o from c) where o <= 30")
def top_06_seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample per class by hash order; the generator of another language's shuffle is not imitated."""
    return r.top_per_group(cohort(spark, d), ["label"], [rank_key(F.col("id").cast("string"))], 30).select("label", "id")


@R(f"with {C} select id, score >= 0.9 as passed from c order by score >= 0.9 desc, case when score >= 0.9 then {H.format('id::varchar')} end, score desc, id limit 40")
def top_07_threshold_then_backfill(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("score") >= 0.9
    c = cohort(spark, d)
    return c.orderBy(F.desc(ok), F.when(ok, rank_key(F.col("id").cast("string"))), F.desc("score"), "id").limit(40).select("id", ok.alias("passed"))


@R(f"""with {C}, {WEIGHTS}, s as (select score, sum(case when label = 1 then weight else 0 end) p, sum(case when label = 0 then weight else 0 end) n from w group by 1), t as (select score, sum(p) over (order by score desc) / sum(p) over () as tpr, 1 - sum(n) over (order by score desc) / sum(n) over () as tnr from s)
  select score as threshold, round((tpr + tnr) / 2, 6) as balanced_accuracy from t order by round((tpr + tnr) / 2, 9) desc, abs(score - 0.5), score limit 1""")
def top_08_threshold_search(spark: SparkSession, d: str) -> DataFrame:
    return m.choose_threshold(m.hierarchical_weights(cohort(spark, d)), F.col("weight")).select(F.col("score").alias("threshold"), six("ba", "balanced_accuracy"))


@R("with e as (select vec_id, unnest(range(1, 33)) as lag, embedding as e from embeddings), a as (select vec_id, lag, round(list_sum(list_transform(range(1, 65 - lag), lambda i: e[i]::double * e[i + lag]::double)), 6) as r from e), m as (select vec_id, max(r) as best from a group by 1) select vec_id, min(lag) as lag from a join m using (vec_id) where r >= 0.9 * best and best > 0 group by 1")
def top_09_fundamental_lag(spark: SparkSession, d: str) -> DataFrame:
    """The earliest lag whose autocorrelation is within a tenth of the greatest."""
    from cadenza.session import table

    lags = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda k: F.round(F.aggregate(F.sequence(F.lit(0), 63 - k), F.lit(0.0), lambda a, i: a + F.get("embedding", i).cast("double") * F.get("embedding", i + k).cast("double")), 6))
    x = table(spark, d, "embeddings").select("vec_id", lags.alias("r")).withColumn("best", F.array_max("r")).where("best > 0")
    return x.select("vec_id", F.expr("cast(element_at(filter(transform(r, (v, i) -> if(v >= 0.9D * best, i + 1, null)), x -> x is not null), 1) as bigint)").alias("lag"))
