"""Column-level data quality: exact aggregates per load and column, and a classifier two-sample test between loads."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.session import cut

#: A value that at least this share of a load's usable values of a column share is heavy; there are at most 1 / HEAVY of them.
HEAVY = 0.02
#: Values are clipped to this many interquartile ranges from the usual median before they enter a mean or the classifier.
CLIP = 4.0
#: Measures of how many different values a load has; the classifier sees single rows and is blind to them.
EXACT = ("distinct", "repeats", "top")


@dataclass(frozen=True)
class Spec:
    """What to profile: ``load`` and text columns with their usual form, and a map of measurements.

    ``names``: the keys of the map that are columns. ``groups``: for each key the group it belongs to, and ``expected``:
    an array<string> column of the groups that a row should have (both None: every row should have every key).
    ``stand_ins``: values that stand for a missing one.
    """

    load: str
    texts: Mapping[str, str] = field(default_factory=dict)
    values: str | None = None
    names: Sequence[str] = ()
    groups: Callable[[str], str] | None = None
    expected: Column | None = None
    stand_ins: Sequence[float] = (-999.0,)

    def group(self, name: str) -> str:
        return self.groups(name) if self.groups else ""


def usable(v: Column, stand_ins: Sequence[float]) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))) & ~v.isin([float(x) for x in stand_ins])


def _index(names: Sequence[str]) -> Column:
    return F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])


def _long(df: DataFrame, spec: Spec) -> DataFrame:
    """(load_id, c, v) of the usable values; c is the place of the key in spec.names."""
    x = df.select(F.col(spec.load).alias("load_id"), F.explode(spec.values).alias("k", "v")).where(usable(F.col("v"), spec.stand_ins))
    return x.select("load_id", F.try_element_at(_index(spec.names), F.col("k")).alias("c"), F.when(F.col("v") == 0, 0.0).otherwise(F.col("v")).alias("v")).where("c is not null")


def scales(df: DataFrame, spec: Spec) -> dict[str, tuple[float, float]]:
    """name -> (median, interquartile range) over all loads' usable values, to one part in 2,000 of rank."""
    if not spec.values:
        return {}
    q = _long(df, spec).groupBy("c").agg(F.percentile_approx("v", [0.25, 0.5, 0.75], 2000).alias("q")).collect()  # a row per column
    return {spec.names[r["c"]]: (r["q"][1], (r["q"][2] - r["q"][0]) or abs(r["q"][1]) or 1.0) for r in q}


def profile(df: DataFrame, spec: Spec, scale: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row per load and column with exact aggregates over all rows.

    (load_id, column_name, rows, missing, distinct_values, violations, lowest, highest, average, deviation, level, spread, top, heavy).
    rows counts rows that should have the column, missing those without a usable value (null, NaN,
    infinite, stand-in, blank or absent key). distinct_values and the rest are over usable values; violations are
    texts not of their usual form (null for numbers). level and spread are mean and deviation of the values clipped to CLIP
    interquartile ranges (``scale``, see scales) around the median; top is the most frequent value's count, heavy the values
    that HEAVY of the load's rows share. Values are counted per distinct value first, map-side, then by load, column and
    value: a load or value with a third of all rows is spread over tasks. A null load is a load of its own. An
    empty table gives no rows. A column wholly missing in a load has nulls for its ranges. Other keys and columns are not read.
    """
    load = F.col(spec.load).alias("load_id")
    schema = ["load_id", "column_name", "rows", "missing", "distinct_values", "violations", "lowest", "highest", "average", "deviation", "level", "spread", "top", "heavy"]
    out = None
    if spec.values:
        scale = scales(df, spec) if scale is None else scale
        groups = df.select(load, (spec.expected if spec.expected is not None else F.array(F.lit(""))).alias("g")).groupBy("load_id", "g").agg(F.count(F.lit(1)).alias("n"))
        groups = groups.select("load_id", F.explode(F.array_distinct("g")).alias("grp"), "n").groupBy("load_id", "grp").agg(F.sum("n").alias("rows"))
        columns = df.sparkSession.createDataFrame([(i, n, spec.group(n), *map(float, scale.get(n, (0.0, 1.0)))) for i, n in enumerate(spec.names)], "c int, column_name string, grp string, mid double, unit double")
        want = groups.join(F.broadcast(columns), "grp")  # a row per column, of a schema that is given
        total = df.groupBy(load).agg(F.count(F.lit(1)).alias("all_rows"))
        counted = _long(df, spec).groupBy("load_id", "c", "v").agg(F.count(F.lit(1)).alias("n"))
        counted = counted.join(F.broadcast(columns.select("c", "mid", "unit")), "c")
        n, z = F.col("n").cast("double"), F.greatest(F.least((F.col("v") - F.col("mid")) / F.col("unit"), F.lit(CLIP)), F.lit(-CLIP))
        stats = counted.groupBy("load_id", "c").agg(
            F.sum("n").alias("used"), F.count(F.lit(1)).alias("distinct_values"), F.min("v").alias("lowest"), F.max("v").alias("highest"), (F.sum(F.col("v") * n) / F.sum(n)).alias("average"),
            F.sum(F.col("v") * F.col("v") * n).alias("sq"), (F.sum(z * n) / F.sum(n)).alias("level"), (F.sum(z * z * n) / F.sum(n)).alias("zz"), F.max("n").alias("top"),
        )
        # Heavy values need the load's size, so they come from a second look at the counts of values seen more than once.
        heavy = counted.where("n > 1").join(total, "load_id").where(F.col("n") >= HEAVY / 8 * F.col("all_rows"))
        heavy = heavy.groupBy("load_id", "c").agg(F.collect_list(F.struct("n", "v")).alias("often"))
        x = want.join(stats, ["load_id", "c"], "left").join(heavy, ["load_id", "c"], "left")
        used = F.coalesce("used", F.lit(0))
        rows = F.greatest("rows", used)
        out = x.select(
            "load_id", "column_name", rows.alias("rows"), (rows - used).alias("missing"), F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), F.lit(None).cast("bigint").alias("violations"), "lowest", "highest", "average",
            F.sqrt(F.greatest(F.col("sq") / used - F.col("average") * F.col("average"), F.lit(0.0))).alias("deviation"), "level", F.sqrt(F.greatest(F.col("zz") - F.col("level") * F.col("level"), F.lit(0.0))).alias("spread"), F.coalesce("top", F.lit(0)).alias("top"),
            F.transform(F.filter(F.coalesce("often", F.array().cast("array<struct<n:bigint,v:double>>")), lambda e: e["n"] >= HEAVY * used), lambda e: e["v"]).alias("heavy"),
        )
    for name, form in spec.texts.items():
        v = F.when(F.trim(F.col(name).cast("string")) != "", F.col(name).cast("string"))
        counted = df.groupBy(load, v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        kept = F.col("v").isNotNull()
        t = counted.groupBy("load_id").agg(
            F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~kept, F.col("n"))), F.lit(0)).alias("missing"), F.count("v").alias("distinct_values"), F.coalesce(F.sum(F.when(kept & ~F.col("v").rlike(form), F.col("n"))), F.lit(0)).alias("violations"), F.coalesce(F.max(F.when(kept, F.col("n"))), F.lit(0)).alias("top"),
        )
        nothing = {c: F.lit(None).cast("double") for c in ("lowest", "highest", "average", "deviation", "level", "spread")}
        t = t.withColumns({"column_name": F.lit(name), **nothing, "heavy": F.array().cast("array<double>")}).select(*schema)
        out = t if out is None else out.unionByName(t)
    return out


class _Encoder:
    """Rows of an Arrow batch as a matrix of features: for each column its block of them.

    A measurement's block: missing, clipped value, its square, whether it is a heavy value of its load; a text's: missing, not of its
    form. All are 0 where a row should not have the column. Scaled so that plain departures are of about equal size.
    """

    def __init__(self, spec: Spec, scale: Mapping, heavy: Mapping) -> None:
        self.names, self.texts = list(spec.names), dict(spec.texts)
        self.group = [spec.group(n) for n in self.names]
        self.mid = np.array([scale.get(n, (0.0, 1.0))[0] for n in self.names])
        self.unit = np.array([scale.get(n, (0.0, 1.0))[1] for n in self.names])
        self.heavy, self.stand_ins = heavy, np.array(spec.stand_ins, float)
        self.columns = self.names + list(self.texts)
        self.block = np.repeat(np.arange(len(self.columns)), [4] * len(self.names) + [2] * len(self.texts))

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        import pyarrow.compute as pc

        n, m = batch.num_rows, len(self.names)
        out = np.zeros((n, len(self.block)), np.float32)
        if m:
            maps = batch.column("values")
            offsets = np.asarray(maps.offsets)
            length = np.diff(offsets)
            if maps.null_count:
                length[np.asarray(maps.is_null())] = 0
            col = np.asarray(pc.fill_null(pc.index_in(maps.keys, value_set=pa.array(self.names)), -1))
            val = np.asarray(pc.fill_null(maps.items, np.nan), float)
            row = np.repeat(np.arange(n), np.diff(offsets))
            live = np.repeat(length > 0, np.diff(offsets)) & (col[offsets[0] : offsets[-1]] >= 0)
            x = np.full((n, m), np.nan)
            x[row[live], col[offsets[0] : offsets[-1]][live]] = val[offsets[0] : offsets[-1]][live]
            x[~np.isfinite(x) | np.isin(x, self.stand_ins)] = np.nan
            known = ~np.isnan(x)
            if "expected" in batch.schema.names:
                e = batch.column("expected").to_pylist()
                seen: dict = {}
                want = np.stack([seen.setdefault(k, np.array([g in k for g in self.group])) for k in (tuple(g or ()) for g in e)])
            else:
                want = np.ones((n, m), bool)
            z = np.clip((x - self.mid) / self.unit, -CLIP, CLIP)
            tie = np.zeros((n, m), bool)
            load = np.array(batch.column("load_id").to_pylist(), object)
            for one in dict.fromkeys(load):
                at = load == one
                for j, v in self.heavy.get(one, {}).items():
                    tie[at, j] = np.isin(x[at, j], v)
            out[:, 0 : 4 * m : 4] = 3.0 * (want & ~known)
            out[:, 1 : 4 * m : 4] = np.where(known, z, 0)
            out[:, 2 : 4 * m : 4] = np.where(known, np.minimum(z * z, 4 * CLIP) / 2, 0)
            out[:, 3 : 4 * m : 4] = 3.0 * (known & tie)
        for j, (name, form) in enumerate(self.texts.items()):
            t = batch.column(f"t_{j}")
            t = t.cast(pa.string())
            gone = np.asarray(pc.fill_null(pc.equal(pc.utf8_trim_whitespace(t), ""), True))
            out[:, 4 * m + 2 * j] = 3.0 * gone
            out[:, 4 * m + 2 * j + 1] = 3.0 * (~gone & ~np.asarray(pc.fill_null(pc.match_substring_regex(t, form), False)))
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 6) -> np.ndarray:
    """Weights of a ridge logistic regression with balanced classes by Newton steps; the last one is the intercept.

    The ridge keeps margins small, so that one telling column doesn't hide another.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    s = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1)).astype(np.float32)
    pen = np.full(x.shape[1], ridge, np.float32)
    pen[-1] = 1e-4
    w = np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (s * p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (s * (y - p)) - pen * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


#: Bins of a score's parts: BINS equal steps of asinh(x / FINE), the middle one around 0; fine where columns add little, and bounded.
BINS, FINE, STEP = 63, 0.02, 0.19


def _bin(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.arcsinh(x / FINE) / STEP + BINS / 2), 0, BINS - 1).astype(np.int64)


def rank_test(ones: np.ndarray, zeros: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(area under the curve, standard errors above chance) per row of two arrays of counts by rising bin: Mann-Whitney with half credit for, and correction of, ties."""
    n1, n0 = ones.sum(1), zeros.sum(1)
    n, both = n1 + n0, ones + zeros
    with np.errstate(invalid="ignore", divide="ignore"):
        area = (ones * (np.cumsum(zeros, 1) - zeros / 2)).sum(1) / (n1 * n0)
        var = ((n + 1) - (both**3 - both).sum(1) / (n * (n - 1))) / (12 * n1 * n0)
        return area, np.where(var > 0, (area - 0.5) / np.sqrt(np.maximum(var, 1e-300)), 0.0)


def two_sample(df: DataFrame, spec: Spec, stats: DataFrame, scale: Mapping[str, tuple[float, float]], sample: int = 500, reference: int = 2000, seed: str = "two-sample") -> DataFrame:
    """How well a classifier tells each load's rows from the others', and how much of that each column carries.

    (load_id, column_name, auc, auc_without, auc_alone, shift): for each load a logistic regression is fitted, in two
    folds, on about ``sample`` of its rows against about ``reference`` rows of all other loads (the only bounded samples; both are
    taken by hash, evenly over all rows). Every row of the table is then scored by the model of the fold it is not in: as a
    row of its load, and as one of the others' for another load given by its hash. auc is the discrimination of the whole
    score, auc_without that of the score without the column's block (ablation), auc_alone that of the block alone, each from
    the ranks of all rows' scores in BINS bins; shift is the block's rank test in standard errors. A task holds counts of
    up to 256 loads at a time. ``stats``: the profile. Loads of fewer than 20 rows are compared as they are; a single load gives no rows.
    """
    spark = df.sparkSession
    h = F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in spec.texts], F.col(spec.load), *([F.map_entries(spec.values)] if spec.values else []))
    cols = [F.col(spec.load).alias("load_id"), h.alias("h"), *([F.col(spec.values).alias("values")] if spec.values else []), *([spec.expected.alias("expected")] if spec.expected is not None and spec.values else []), *[F.col(c).cast("string").alias(f"t_{j}") for j, c in enumerate(spec.texts)]]
    rows = df.select(*cols).where("load_id is not null")
    kind = dict(rows.dtypes)["load_id"]
    size = {r["load_id"]: r["n"] for r in df.groupBy(F.col(spec.load).alias("load_id")).agg(F.count(F.lit(1)).alias("n")).collect() if r["load_id"] is not None}  # a number per load
    loads = sorted(size)
    if len(loads) < 2:
        return spark.createDataFrame([], f"load_id {kind}, column_name string, auc double, auc_without double, auc_alone double, shift double")
    place = {n: j for j, n in enumerate(spec.names)}
    heavy: dict = {}
    for r in stats.where(F.size("heavy") > 0).select("load_id", "column_name", "heavy").collect():  # at most 1 / HEAVY numbers per load and column
        if r["column_name"] in place:
            heavy.setdefault(r["load_id"], {})[place[r["column_name"]]] = np.array(r["heavy"])
    enc = _Encoder(spec, scale, heavy)
    share = spark.createDataFrame([(k, min(1.0, sample / size[k])) for k in loads], f"load_id {kind}, share double")
    share = F.broadcast(share) if len(loads) <= 1_000_000 else share  # a number per load, counted above; beyond that the join is shuffled
    unit = F.pmod(F.col("h"), F.lit(1 << 20)) / float(1 << 20)
    other = F.pmod(F.shiftright("h", 20), F.lit(1 << 20)) / float(1 << 20)
    drawn = rows.join(share, "load_id").withColumns({"own": unit < F.col("share"), "ref": other < min(1.0, reference / sum(size.values()))}).drop("share").where("own or ref")
    width = len(enc.block)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = enc(b)
                yield pa.RecordBatch.from_arrays([b.column("load_id"), b.column("h"), b.column("own"), b.column("ref"), pa.array(list(x), pa.list_(pa.float32()))], names=["load_id", "h", "own", "ref", "x"])

    drawn = cut(drawn.mapInArrow(encode, f"load_id {kind}, h bigint, own boolean, ref boolean, x array<float>"))
    r = drawn.where("ref").select("load_id", "h", "x").toPandas()  # about ``reference`` rows
    ref_load, ref_x, ref_fold = r["load_id"].to_numpy(), np.array(r["x"].to_list(), np.float32).reshape(len(r), width), (r["h"].to_numpy() >> 42) & 1

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, fold = np.stack(pdf["x"].to_list()).astype(np.float32), (pdf["h"].to_numpy() >> 42) & 1
        far = ref_load != pdf["load_id"].iloc[0]
        w = []
        for k in (0, 1):
            a, b = x[fold != k], ref_x[far & (ref_fold != k)]
            w.append(logistic(np.vstack([a, b]), np.arange(len(a) + len(b)) < len(a)).tolist() if len(a) and len(b) else [0.0] * (width + 1))
        return pd.DataFrame({"load_id": pdf["load_id"].iloc[:1], "w0": w[:1], "w1": w[1:]})

    models = drawn.where("own").select("load_id", "h", "x").groupBy("load_id").applyInPandas(fit, f"load_id {kind}, w0 array<float>, w1 array<float>").collect()  # two models per load
    at = {m["load_id"]: i for i, m in enumerate(models)}
    known = [m["load_id"] for m in models]
    if len(known) < 2:
        return spark.createDataFrame([], f"load_id {kind}, column_name string, auc double, auc_without double, auc_alone double, shift double")
    weights = spark.sparkContext.broadcast(np.array([[m["w0"], m["w1"]] for m in models], np.float32))  # loads x columns, as many as the result has rows
    first = np.searchsorted(enc.block, np.arange(len(enc.columns)))
    m = len(enc.columns) + 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        held: dict[int, np.ndarray] = {}  # per load: counts by class, part (block or rest), column and bin

        def emit() -> pa.RecordBatch:
            i = np.array(list(held), np.int32)
            n = np.stack(list(held.values()))
            a, b, c, d, e = np.nonzero(n)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in ((i[a], pa.int32()), (b, pa.int32()), (c, pa.int32()), (d, pa.int32()), (e, pa.int32()), (n[a, b, c, d, e], pa.int64()))], names=["i", "cls", "part", "c", "bin", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            x, hh = enc(b), np.asarray(b.column("h"))
            mine = np.array([at.get(k, -1) for k in b.column("load_id").to_pylist()])
            theirs = np.where(mine < 0, hh & 0x7FFFFFFF, mine + 1 + ((hh >> 43) & 0xFFFF) % (len(w) - 1)) % len(w)
            fold = (hh >> 42) & 1
            for cls, who in ((1, mine), (0, theirs)):
                rows_ = np.flatnonzero(who >= 0)
                part = np.add.reduceat(x[rows_] * w[who[rows_], fold[rows_], :-1], first, axis=1)
                full = part.sum(1, keepdims=True) + w[who[rows_], fold[rows_], -1:]
                places = np.stack([_bin(np.hstack([part, full])), _bin(np.hstack([full - part, full]))], 1) + (np.arange(2 * m) * BINS).reshape(2, m)
                for one in np.unique(who[rows_]):
                    own = places[who[rows_] == one].ravel()
                    held.setdefault(int(one), np.zeros((2, 2, m, BINS), np.int64))[cls] += np.bincount(own, minlength=2 * m * BINS).reshape(2, m, BINS)
            if len(held) > 256:
                yield emit()
        if held:
            yield emit()

    counts = rows.mapInArrow(score, "i int, cls int, part int, c int, bin int, n bigint").groupBy("i", "c", "part", "cls", "bin").agg(F.sum("n").alias("n"))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        """All columns of a load: its counts are bounded by columns and bins."""
        n = np.zeros((2, 2, m, BINS))
        n[pdf["cls"], pdf["part"], pdf["c"], pdf["bin"]] = pdf["n"]
        alone, z = rank_test(n[1, 0], n[0, 0])
        without, _ = rank_test(n[1, 1], n[0, 1])
        return pd.DataFrame({"i": pdf["i"].iloc[0], "column_name": enc.columns, "auc": alone[-1], "auc_without": without[:-1], "auc_alone": alone[:-1], "shift": z[:-1]})

    x = counts.groupBy("i").applyInPandas(judge, "i int, column_name string, auc double, auc_without double, auc_alone double, shift double")
    ids = spark.createDataFrame([(i, k) for i, k in enumerate(known)], f"i int, load_id {kind}")
    return x.join(ids, "i").select("load_id", "column_name", "auc", "auc_without", "auc_alone", "shift")


def departures(stats: DataFrame, sigmas: float = 8.0) -> DataFrame:
    """(load_id, column_name, measure, value, usual, sigmas): loads in which an exact aggregate departs plainly from the usual.

    Usual is the median over the loads; a departure is counted in the larger of its spread over loads (1.4826 median absolute
    deviations) and of its sampling error, and must pass a least size: 0.1 in shares, 0.3 interquartile ranges in level, a factor
    of 1.5 in spread, a third in the share of distinct values or a factor of 3 in both their number and their share ('repeats', for
    columns that usually repeat; a load that is only larger or smaller moves the two apart). A column has to be in three loads at least.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        n = pdf["rows"].to_numpy(float)
        used = np.maximum(n - pdf["missing"].to_numpy(float), 0)
        share = lambda v, by: np.where(by > 0, v / np.maximum(by, 1), np.nan)
        spread = pdf["spread"].to_numpy(float)
        usual_sd = np.nanmedian(spread) if np.isfinite(spread).any() else np.nan
        rate = lambda v, by: np.sqrt(np.maximum(np.nanmedian(v) * (1 - np.nanmedian(v)), 0.002) / np.maximum(by, 1)) if np.isfinite(v).any() else np.full(len(v), np.nan)
        with np.errstate(invalid="ignore", divide="ignore"):
            missing = share(pdf["missing"].to_numpy(float), n)
            bad = share(pdf["violations"].to_numpy(float), used)
            top = share(pdf["top"].to_numpy(float), used)
            distinct = share(pdf["distinct_values"].to_numpy(float), used)
            tests = (
                ("missing", missing, rate(missing, n), 0.1), ("violations", bad, rate(bad, used), 0.1), ("top", top, rate(top, used), 0.1), ("distinct", distinct, rate(distinct, used), 0.33),
                ("level", pdf["level"].to_numpy(float), usual_sd / np.sqrt(np.maximum(used, 1)), 0.3), ("spread", np.log(np.maximum(spread, 1e-3)), 1 / np.sqrt(np.maximum(used, 1)), np.log(1.5)),
            )
            for name, v, se, least in tests:
                ok = np.isfinite(v)
                if ok.sum() < 3:
                    continue
                mid = np.median(v[ok])
                err = np.maximum(1.4826 * np.median(np.abs(v[ok] - mid)), se)
                s = np.abs(v - mid) / np.maximum(err, 1e-9)
                for i in np.flatnonzero(ok & (s > sigmas) & (np.abs(v - mid) > least)):
                    out.append((pdf["load_id"].iloc[i], pdf["column_name"].iloc[i], name, float(v[i]), float(mid), float(s[i])))
            count = pdf["distinct_values"].to_numpy(float)
            ok = count > 0
            if ok.sum() >= 3:
                logs = [np.log(np.where(ok, v, np.nan)) for v in (count, distinct)]
                far = [v - np.median(v[ok]) for v in logs]
                err = [np.maximum(1.4826 * np.median(np.abs(g[ok])), 1 / np.sqrt(np.median(count[ok]))) for g in far]
                s = np.maximum(*[np.abs(g) / e for g, e in zip(far, err)])  # one of the two is steady where loads differ in size
                for i in np.flatnonzero(ok & (s > sigmas) & (far[0] * far[1] > 0) & (np.minimum(*np.abs(far)) > np.log(3))):
                    out.append((pdf["load_id"].iloc[i], pdf["column_name"].iloc[i], "repeats", float(distinct[i]), float(np.exp(np.median(logs[1][ok]))), float(s[i])))
        return pd.DataFrame(out, columns=["load_id", "column_name", "measure", "value", "usual", "sigmas"])

    kind = dict(stats.dtypes)["load_id"]
    return stats.where("load_id is not null").drop("heavy").groupBy("column_name").applyInPandas(one, f"load_id {kind}, column_name string, measure string, value double, usual double, sigmas double")


def changed_columns(df: DataFrame, spec: Spec, shift: float = 6.0, alone: float = 0.53, ablation: float = 0.02) -> DataFrame:
    """(load_id, column_name, auc, auc_without, auc_alone, shift, measures): columns that in one load depart plainly.

    Candidates are the columns by which the two-sample classifier tells the load's rows from the others': the column's own block discriminates
    (``shift`` standard errors and an area of ``alone``), and without it the classifier orders at least ``ablation`` more pairs of rows
    wrongly. The exact aggregates then have to depart, too. How often values repeat is no feature of a single row, so departures of EXACT
    measures need no candidate.
    """
    scale = scales(df, spec)
    stats = cut(profile(df, spec, scale))
    told = two_sample(df, spec, stats, scale)
    why = departures(stats).groupBy("load_id", "column_name").agg(F.sort_array(F.collect_set("measure")).alias("measures"))
    x = told.join(why, ["load_id", "column_name"], "right")
    carried = 1 - F.col("auc_without") >= (1 + ablation) * (1 - F.col("auc"))
    candidate = (F.col("shift") > shift) & (F.col("auc_alone") > alone) & carried
    return x.where(candidate | F.arrays_overlap("measures", F.array(*map(F.lit, EXACT)))).select(*told.columns, "measures")
