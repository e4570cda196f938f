"""Queries of signal operators (SIG). Signals: the vectors of a label and span of ids joined in order of vec_id, at 1 kHz."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import kernels as k
from cadenza.operators import signals as s
from cadenza.operators.metrics import ratio, six
from cadenza.queries._cohort import C, cohort
from cadenza.registry import Registry
from cadenza.session import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
SR, SIZE, HOP, SPAN = 1000, 64, 16, 500


def recordings(spark: SparkSession, d: str) -> DataFrame:
    """(recording, x, y): the vectors of a label and of a span of SPAN ids joined; y is the signal delayed by one vector.

    A recording holds up to SPAN vectors whatever the table's size, so recordings grow in number and not in length.
    """
    name = F.concat_ws("-", F.col("label").cast("string"), F.floor(F.col("vec_id") / SPAN).cast("string"))
    e = table(spark, d, "embeddings").groupBy(name.alias("recording")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    x = F.flatten(F.transform("v", lambda e: F.transform(e["embedding"], lambda z: z.cast("double"))))
    return e.select("recording", x.alias("x")).withColumn("y", F.concat(F.slice("x", F.lit(65), F.size("x")), F.slice("x", 1, 64)))


def measured(spark: SparkSession, d: str, kernel, inputs=("x",)) -> DataFrame:
    return s.long(s.measure(recordings(spark, d), "recording", list(inputs), kernel), "recording")


#: Coefficients of bins 4, 8 and 12 of every frame of SIZE samples, HOP apart, under a periodic Hann window, for DuckDB.
SPECTRA = """sm as (select label::varchar || '-' || (vec_id // 500)::varchar as recording, (row_number() over (partition by label, vec_id // 500 order by vec_id) - 1) * 64 as start, embedding from embeddings), sa as (select recording, start + i as n, embedding[i + 1]::double as x from sm, (select unnest(range(64)) as i)),
  fs as (select recording, max(n) + 1 as total, (max(n) + 1 - 64) // 16 as last from sa group by 1), fr as (select sa.recording, n // 16 - o as k, n - 16 * (n // 16 - o) as j, x from sa join fs using (recording), (select unnest(range(4)) as o) where n // 16 - o between 0 and last),
  sp as (select recording, k, b, sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 64)) * cos(2 * pi() * b * j / 64)) / 32 as re, -sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 64)) * sin(2 * pi() * b * j / 64)) / 32 as im from fr, (select unnest([4, 8, 12]) as b) group by 1, 2, 3)"""


@R("select distinct id, case when canonical.native_frames >= 30 * canonical.native_sample_rate_hz then (canonical.native_frames - 30 * canonical.native_sample_rate_hz) // 2 end as start_frame, 30 * canonical.native_sample_rate_hz as frames from drive_sources where canonical.native_frames is not null and canonical.native_sample_rate_hz is not null")
def sig_01_centre_crop(spark: SparkSession, d: str) -> DataFrame:
    n, want = F.col("canonical.native_frames"), 30 * F.col("canonical.native_sample_rate_hz")
    t = table(spark, d, "drive_sources").where("canonical.native_frames is not null and canonical.native_sample_rate_hz is not null")
    return t.select("id", F.when(n >= want, F.floor((n - want) / 2)).alias("start_frame"), want.alias("frames")).distinct()


@R()
def sig_01_resample(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d, lambda x: {"n": len(y := k.resample(x, 441, 320)), "rms": math.sqrt(np.mean(y * y)), "rms_before": math.sqrt(np.mean(x * x))})


@R("select vec_id, list_max(embedding)::double - list_min(embedding)::double < 1e-8 as silent from embeddings")
def sig_02_silence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", (F.array_max("embedding").cast("double") - F.array_min("embedding").cast("double") < 1e-8).alias("silent"))


@R()
def sig_03_phase_family(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d, lambda x: k.phase_family(x, SR))


@R()
def sig_04_harmony_family(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d, lambda x: k.harmony_family(*k.chroma_blocks(np.repeat(x, 8), SR)))


@R()
def sig_05_recurrence_family(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d, lambda x: k.recurrence_family(*k.chroma_blocks(np.tile(x, 8), SR)))


@R()
def sig_06_stereo_family(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d, lambda x, y: k.stereo_family(x, y, SR, size=SIZE, hop=HOP, bands=((50, 150), (150, 300), (300, 450))), ("x", "y"))


@R()
def sig_07_bicoherence_grid(spark: SparkSession, d: str) -> DataFrame:
    """Pools of 512 samples, triads of every fourth bin."""
    return s.produce(recordings(spark, d), "recording", ["x"], lambda x: k.bicoherence_pools(x, 512, SIZE, HOP, k.triads(4, 24, 32)), "pool int, f1 int, f2 int, eligible boolean, b2 double, biphase double")


@R(f"""with {SPECTRA}, u as (select a.recording, a.k, a.re * b.re - a.im * b.im as re, a.re * b.im + a.im * b.re as im, c.re as vr, c.im as vi from sp a join sp b using (recording, k) join sp c using (recording, k) where a.b = 4 and b.b = 8 and c.b = 12),
  t as (select recording, sum(re * vr + im * vi) as tr, sum(im * vr - re * vi) as ti, sum(re * re + im * im) as eu, sum(vr * vr + vi * vi) as ev from u group by 1) select recording, unnest(['b2', 'biphase']) as name, unnest([round(least(1, (tr * tr + ti * ti) / eu / ev), 6), round(atan2(ti, tr), 6)]) as value from t""")
def sig_08_bicoherence(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d, lambda x: dict(zip(("b2", "biphase"), k.bicoherence(k.spectra(x, SIZE, HOP), (4, 8)))))


POOLS = "p as (select user_id, id % 6 as pool, k % 5 <> 0 as eligible, score as b2, source_group = 'click' as cond from c)"


@R(f"with {C}, {POOLS}, m as (select user_id, cond, pool, avg(b2) filter (eligible) b2 from p group by 1, 2, 3) select a.user_id, round(median(a.b2), 8) as base, round(median(b.b2), 8) as changed, round(median(b.b2) - median(a.b2), 8) as median_difference, round(avg(b.b2 - a.b2), 8) as paired_mean from m a join m b on a.user_id = b.user_id and a.pool = b.pool and not a.cond and b.cond group by 1")
def sig_09_pool_reduction(spark: SparkSession, d: str) -> DataFrame:
    p = cohort(spark, d).groupBy("user_id", (F.col("id") % 6).alias("pool")).agg(*[F.avg(F.when((F.col("k") % 5 != 0) & ((F.col("source_group") == "click") == c), F.col("score"))).alias(n) for n, c in (("a", False), ("b", True))], F.count_if(F.col("source_group") == "click").alias("nb"), F.count_if(F.col("source_group") != "click").alias("na")).where("na > 0 and nb > 0")
    return p.groupBy("user_id").agg(*[F.round(v, 8).alias(n) for v, n in ((F.median("a"), "base"), (F.median("b"), "changed"), (F.median("b") - F.median("a"), "median_difference"), (F.avg(F.col("b") - F.col("a")), "paired_mean"))])


@R()
def sig_10_spectral_family(spark: SparkSession, d: str) -> DataFrame:
    def kernel(x: np.ndarray) -> dict:
        p, _ = k.vocal_power(x, SIZE, HOP)
        return k.spectral_family(p, np.fft.rfftfreq(SIZE, 1 / SR), HOP / SR, (30, 200), (60, 200), (200, 400))

    return measured(spark, d, kernel)


FRAME = "f as (select user_id, row_number() over (partition by user_id order by ts, id) - 1 as n, 20 * log10(value + 1e-3) as db from c)"


@R(f"with {C}, {FRAME}, g as (select user_id, greatest(quantile_cont(db, 0.3), max(db) - 35) as floor, count(*) n from f group by 1) select user_id, count(*) filter (db >= floor) as active, round(count(*) filter (db >= floor)::double / count(*), 6) as active_ratio, count(*) filter (db >= floor) >= 16 as eligible from f join g using (user_id) group by 1")
def sig_11_vocal_activity(spark: SparkSession, d: str) -> DataFrame:
    f = cohort(spark, d).select("user_id", (20 * F.log10(F.col("value") + 1e-3)).alias("db"))
    g = f.groupBy("user_id").agg(F.greatest(F.percentile("db", F.lit(0.3)), F.max("db") - 35).alias("floor"))
    x = f.join(g, "user_id").groupBy("user_id").agg(F.count_if(F.col("db") >= F.col("floor")).alias("active"), F.count(F.lit(1)).alias("n"))
    return x.select("user_id", "active", six(ratio(F.col("active"), F.col("n")), "active_ratio"), (F.col("active") >= 16).alias("eligible"))


@R()
def sig_12_dynamics_family(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d, lambda x: k.dynamics_family(k.event_levels(x, SR, SIZE, 8)))


BEATS = "b as (select user_id, sum(0.3 + k / 400.0::double) over (partition by user_id order by ts, id) as t, 1 + (row_number() over (partition by user_id order by ts, id) - 1) % 4 as number from c)"


def beats(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "id")
    return cohort(spark, d).select("user_id", F.sum(0.3 + F.col("k") / 400).over(w).alias("t"), (1 + (F.row_number().over(w) - 1) % 4).alias("number"))


@R(f"""with {C}, {BEATS}, i as (select user_id, t, t - lag(t) over w as ibi, round(60 / nullif(t - lag(t) over w, 0), 6) as bpm from b window w as (partition by user_id order by t)), q as (select user_id, count(ibi) n, (quantile_cont(ibi, 0.75) - quantile_cont(ibi, 0.25)) / median(ibi) as cv from i group by 1),
  v as (select user_id, t, bpm, lag(bpm) over (partition by user_id order by t) as before from i where bpm between 30 and 300), tv as (select user_id, count(*) n, median(abs(bpm - before)) / median(bpm) as tv from v group by 1), h as (select user_id, least(floor((bpm - 30) / 5), 53) bin, count(*)::double n from v group by 1, 2), p as (select user_id, n / sum(n) over (partition by user_id) p from h), e as (select user_id, -sum(p * ln(p)) / ln(54) as ent from p group by 1)
  select user_id, round(round(cv, 9), 6) as ibi_cv, round(round(tv, 9), 6) as tempo_tv, round(round(ent, 9), 6) as tempo_entropy from q join tv using (user_id) join e using (user_id) where q.n >= 15 and tv.n >= 14""")
def sig_13_rhythm_family(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("t")
    i = beats(spark, d).select("user_id", "t", (F.col("t") - F.lag("t").over(w)).alias("ibi")).where("ibi > 0").withColumn("bpm", F.round(60 / F.col("ibi"), 6))
    q = i.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), ((F.percentile("ibi", F.lit(0.75)) - F.percentile("ibi", F.lit(0.25))) / F.median("ibi")).alias("cv")).where("n >= 15")
    v = i.where("bpm between 30 and 300").withColumn("before", F.lag("bpm").over(w))
    tv = v.groupBy("user_id").agg(F.count(F.lit(1)).alias("m"), (F.median(F.abs(F.col("bpm") - F.col("before"))) / F.median("bpm")).alias("tv")).where("m >= 14")
    h = v.groupBy("user_id", F.least(F.floor((F.col("bpm") - 30) / 5), F.lit(53)).alias("bin")).agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s"))
    e = h.select("user_id", ((F.log("t") - F.col("s") / F.col("t")) / math.log(54)).alias("e"))
    return q.join(tv, "user_id").join(e, "user_id").select("user_id", *[six(F.round(v, 9), n) for v, n in (("cv", "ibi_cv"), ("tv", "tempo_tv"), ("e", "tempo_entropy"))])


SECTIONS = "s as (select user_id, row_number() over (partition by user_id order by ts, id) as n, 2 + k / 10.0::double as dur from c)"


@R(f"""with {C}, {SECTIONS}, q as (select user_id, count(*) n, (quantile_cont(dur, 0.75) - quantile_cont(dur, 0.25)) / median(dur) as cv, median(dur) md from s group by 1), h as (select user_id, floor(dur / 2) bin, count(*)::double n from s group by 1, 2), p as (select user_id, n / sum(n) over (partition by user_id) p from h), e as (select user_id, -sum(p * ln(p)) / ln(16) as ent from p group by 1)
  select user_id, round(cv, 6) as section_duration_cv, round(ent, 6) as section_duration_entropy, round(md, 6) as section_duration_median from q join e using (user_id) where n >= 3""")
def sig_14_phrase_family(spark: SparkSession, d: str) -> DataFrame:
    x = cohort(spark, d).select("user_id", (2 + F.col("k") / 10).alias("dur"))
    q = x.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), ((F.percentile("dur", F.lit(0.75)) - F.percentile("dur", F.lit(0.25))) / F.median("dur")).alias("cv"), F.median("dur").alias("md")).where("n >= 3")
    h = x.groupBy("user_id", F.floor(F.col("dur") / 2).alias("b")).agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s"))
    e = h.select("user_id", ((F.log("t") - F.col("s") / F.col("t")) / math.log(16)).alias("e"))
    return q.join(e, "user_id").select("user_id", six("cv", "section_duration_cv"), six("e", "section_duration_entropy"), six("md", "section_duration_median"))


@R(f"""with {C}, b as (select user_id, k % 5 + 2 as len from c), h as (select user_id, len, count(*) n from b group by 1, 2), t as (select user_id, sum(n)::double t, count(*) m from h group by 1), mo as (select user_id, len, n, row_number() over (partition by user_id order by n desc, len) r from h)
  select user_id, mo.len as mode, round(1 - mo.n / t.t, 6) as offmode_fraction, round((select -sum(h.n / t.t * ln(h.n / t.t)) from h where h.user_id = mo.user_id) / ln(8), 6) as length_entropy from mo join t using (user_id) where r = 1 and t.t >= 8""")
def sig_15_bar_features(spark: SparkSession, d: str) -> DataFrame:
    h = cohort(spark, d).groupBy("user_id", (F.col("k") % 5 + 2).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    a = h.groupBy("user_id").agg(F.sum("n").alias("t"), F.min(F.struct((-F.col("n")).alias("m"), "len")).alias("b"), F.sum(F.col("n") * F.log("n")).alias("s")).where("t >= 8")
    return a.select("user_id", F.col("b.len").alias("mode"), six(1 + ratio(F.col("b.m"), F.col("t")), "offmode_fraction"), six((F.log("t") - F.col("s") / F.col("t")) / math.log(8), "length_entropy"))


@R(f"""with {C}, {SECTIONS}, m as (select user_id, max(dur) mx, count(*) n from s group by 1), h as (select user_id, floor(dur / 2) bin, count(*)::double n from s group by 1, 2), p as (select user_id, n / sum(n) over (partition by user_id) p from h), e as (select user_id, -sum(p * ln(p)) as ent from p group by 1)
  select user_id, round(ent / ln(greatest(62, ceil(mx / 2) * 2 + 2) / 2), 6) as duration_entropy, round(mx, 6) as longest from m join e using (user_id) where n >= 3""")
def sig_16_structure_features(spark: SparkSession, d: str) -> DataFrame:
    x = cohort(spark, d).select("user_id", (2 + F.col("k") / 10).alias("dur"))
    h = x.groupBy("user_id", F.floor(F.col("dur") / 2).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max("dur").alias("mx")).groupBy("user_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s"), F.max("mx").alias("mx")).where("t >= 3")
    return h.select("user_id", six((F.log("t") - F.col("s") / F.col("t")) / F.log(F.greatest(F.lit(62.0), F.ceil(F.col("mx") / 2) * 2.0 + 2) / 2), "duration_entropy"), six("mx", "longest"))


@R()
def sig_17_timbre_family(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d, lambda x: k.timbre_family(x, SR, SIZE, HOP, 0.1))


@R()
def sig_18_modulation_family(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d, lambda x: k.modulation_family(x, SR, (50, 400), 0.5))


def _pitch(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = np.arange(len(x)) / 100
    return t, 220 * 2 ** ((x + 0.3 * np.sin(2 * np.pi * 5.5 * t)) / 12), np.arange(len(x)) % 300 > 20


@R()
def sig_19_pitch_microstructure(spark: SparkSession, d: str) -> DataFrame:
    """Every window of a second, twice a second, of the whole contour."""
    def kernel(x: np.ndarray) -> list[dict]:
        t, hz, _ = _pitch(x)
        return [dict(zip(("rate_hz", "extent_cents", "regularity"), k.vibrato_windows(t[i : i + 100], 1200 * np.log2(hz[i : i + 100])))) | {"window": i // 50} for i in range(0, max(len(t) - 99, 1), 50)]

    return s.produce(recordings(spark, d), "recording", ["x"], kernel, "window int, rate_hz double, extent_cents double, regularity double")


@R()
def sig_20_vibrato_presence(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d, lambda x: k.vibrato_presence(*_pitch(x)))


@R()
def sig_22_frame_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Cepstra 1 to 12 and level of every frame."""
    def kernel(x: np.ndarray) -> list[dict]:
        c, f = k.cepstra(x, SR, SIZE, SIZE), k.frames(x, SIZE, SIZE)
        return [{"frame": i, "cepstra": c[i, 1:13].round(6).tolist(), "level_db": float(20 * np.log10(np.sqrt(np.mean(f[i] ** 2)) + 1e-12))} for i in range(len(f))]

    return s.produce(recordings(spark, d), "recording", ["x"], kernel, "frame int, cepstra array<double>, level_db double")


@R(f"with {C}, b as (select user_id, (id % 8) as band, sum(value) m, sum(value) filter (k < 60) a from c group by 1, 2) select user_id, round(10 * log10((sum(m - coalesce(a, 0)) + 1e-9) / (sum(m) + 1e-9)), 6) as residual_db, round(corr(ln(m + 1), ln(coalesce(a, 0) + 1)), 6) as envelope_correlation, round(quantile_cont(m, 0.95) / median(m), 6) as burstiness from b group by 1 having count(*) >= 4 and stddev_pop(coalesce(a, 0)) > 0.001 and stddev_pop(m) > 0.001")
def sig_23_artifact_metrics(spark: SparkSession, d: str) -> DataFrame:
    b = cohort(spark, d).groupBy("user_id", (F.col("id") % 8).alias("band")).agg(F.sum("value").alias("m"), F.coalesce(F.sum(F.when(F.col("k") < 60, F.col("value"))), F.lit(0.0)).alias("a"))
    x = b.groupBy("user_id").agg(six(10 * F.log10((F.sum(F.col("m") - F.col("a")) + 1e-9) / (F.sum("m") + 1e-9)), "residual_db"), six(F.corr(F.log(F.col("m") + 1), F.log(F.col("a") + 1)), "envelope_correlation"), six(F.percentile("m", F.lit(0.95)) / F.median("m"), "burstiness"), F.count(F.lit(1)).alias("n"), F.stddev_pop("a").alias("sa"), F.stddev_pop("m").alias("sm"))
    return x.where("n >= 4 and sa > 0.001 and sm > 0.001").drop("n", "sa", "sm")


@R()
def sig_24_band_vectors(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d, lambda x: {f"v{i:02d}": v for i, v in enumerate(k.band_vectors(x, SR, SIZE, HOP, 12))})


@R()
def sig_25_cepstral_peak(spark: SparkSession, d: str) -> DataFrame:
    return measured(spark, d, lambda x: {"cpp_median": float(np.median([k.cepstral_peak(f, SR, 20, 200) for f in k.frames(x, 256, 128)])) if len(x) >= 256 else math.nan})


@R()
def sig_26_bias_filter(spark: SparkSession, d: str) -> DataFrame:
    """Spectral family with and without a bias that rises over the bins."""
    def kernel(x: np.ndarray) -> dict:
        p, _ = k.vocal_power(x, SIZE, HOP)
        f = np.fft.rfftfreq(SIZE, 1 / SR)
        how = (f, HOP / SR, (30, 200), (60, 200), (200, 400))
        a, b = k.spectral_family(p, *how), k.spectral_family(p * 10 ** (-np.linspace(0, 6, len(f)) / 10), *how)
        return {f"delta_{n}": b[n] - a[n] for n in a}

    return measured(spark, d, kernel)


@R(f"""with {SPECTRA}, p as (select recording, k, sum(re * re + im * im) as p from sp group by 1, 2), o as (select recording, last, unnest(range((total + 249) // 250)) * 0.25::double as onset from fs) select o.recording, onset, round(10 * log10(p + 1e-12), 6) as level_db from o join p on p.recording = o.recording and p.k = least(floor(onset * 1000 / 16)::bigint, last)""")
def sig_27_note_levels(spark: SparkSession, d: str) -> DataFrame:
    """Level at given onsets in the harmonics of given pitches."""
    def kernel(x: np.ndarray) -> list[dict]:
        p, f = np.abs(k.spectra(x, SIZE, HOP)) ** 2, np.fft.rfftfreq(SIZE, 1 / SR)
        return [{"onset": float(t), "level_db": float(10 * np.log10(sum(p[min(int(t * SR / HOP), len(p) - 1), np.abs(f - h * 60.0).argmin()] for h in (1, 2, 3)) + 1e-12))} for t in np.arange(0, len(x) / SR, 0.25)]

    return s.produce(recordings(spark, d), "recording", ["x"], kernel, "onset double, level_db double").withColumn("level_db", F.round("level_db", 6))


@R("with e as (select vec_id, unnest(range(64)) as i, unnest(embedding)::double as v from embeddings) select vec_id, round(sum(v * pow(10, (case when i < 32 then i * 6.0 / 32 else (64 - i) * 6.0 / 32 end) / 20.0::double)), 6) as changed_sum from e group by 1")
def sig_28_gain_envelope(spark: SparkSession, d: str) -> DataFrame:
    """A controlled change: a gain that rises by 6 dB and falls again."""
    gain = lambda i: F.pow(F.lit(10.0), F.when(i < 32, i * 6.0 / 32).otherwise((64 - i) * 6.0 / 32) / 20.0)
    x = F.transform("embedding", lambda v, i: v.cast("double") * gain(i))
    return table(spark, d, "embeddings").select("vec_id", six(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), "changed_sum"))


@R("with e as (select label % 2 as cls, i % 8 as time_bin, i // 8 as band, v from (select label, unnest(range(64)) as i, unnest(embedding)::double as v from embeddings)) select time_bin, band, round(avg(v) filter (cls = 1) - avg(v) filter (cls = 0), 6) as difference from e group by 1, 2")
def sig_29_class_difference(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select((F.col("label") % 2).alias("cls"), F.posexplode("embedding").alias("i", "v"))
    mean = lambda c: F.avg(F.when(F.col("cls") == c, F.col("v").cast("double")))
    return e.groupBy((F.col("i") % 8).cast("bigint").alias("time_bin"), F.floor(F.col("i") / 8).alias("band")).agg(six(mean(1) - mean(0), "difference"))
