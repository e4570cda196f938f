"""Percentiles of very large numeric columns (problem 2): dyadic Count-sketches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Binary resolutions of an encoded value; the first EXACT of them are counted exactly; rows and counters of each signed sketch.
BITS, EXACT, DEPTH, WIDTH = 24, 14, 5, 1024
_LEVELS = BITS - EXACT
_rng = np.random.default_rng(20_240_917)
_MUL = _rng.integers(1, 1 << 63, (_LEVELS, DEPTH, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, (_LEVELS, DEPTH, 2), dtype=np.uint64)
#: Above so many distinct codes a sketch is held as counters instead of codes.
_DENSE = 16_384


def encode(values: np.ndarray) -> np.ndarray:
    """Codes of BITS bits in the order of the values: sign, exponent and the first bits of the fraction."""
    b = np.ascontiguousarray(values, np.float64).view(np.uint64)
    b = np.where(b >> np.uint64(63), ~b, b | np.uint64(1 << 63))
    return (b >> np.uint64(64 - BITS)).astype(np.uint32)


def decode(codes: np.ndarray) -> np.ndarray:
    """The middle of a code's cell, at most 2**-12 of a normal value's size from any value in it; 0 for values too small to be normal."""
    b = (codes.astype(np.uint64) << np.uint64(64 - BITS)) + np.uint64(1 << (63 - BITS))
    v = np.where(b >> np.uint64(63), b & np.uint64((1 << 63) - 1), ~b).view(np.float64)
    return np.where(np.abs(v) < np.finfo(float).tiny, 0.0, v)


def _hash(level: int, row: int, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = (prefix.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    h = x * _MUL[level, row, 0] + _ADD[level, row, 0]
    g = x * _MUL[level, row, 1] + _ADD[level, row, 1]
    return (h >> np.uint64(64 - 10)).astype(np.int64), ((g >> np.uint64(63)).astype(np.int64) * 2 - 1)


def _sum_by(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums per code of sorted codes."""
    if not len(codes):
        return codes, counts
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[at], np.add.reduceat(counts, at)


class Sketch:
    """One signed sketch per binary resolution. Linear: sketches of parts, days or loads add up, and counts may be negative.

    While it has few distinct codes it holds them as they are (what their sketches add up to is the same).
    """

    __slots__ = ("parts", "held", "exact", "table")

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self.exact: np.ndarray | None = None
        self.table: np.ndarray | None = None

    def add(self, codes: np.ndarray, counts: np.ndarray) -> Sketch:
        """Adds sorted codes with their counts; negative counts delete."""
        self.parts.append((codes, counts))
        self.held += len(codes)
        if self.held > 4 * _DENSE:
            self._compact()
            if self.held > _DENSE:
                self._spread()
        return self

    def merge(self, other: Sketch, sign: int = 1) -> Sketch:
        for c, n in other.parts:
            self.add(c, n * sign)
        if other.table is not None:
            self._spread()
            self.exact += sign * other.exact
            self.table += sign * other.table
        return self

    def _compact(self) -> None:
        if len(self.parts) > 1:
            c, n = np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts])
            o = np.argsort(c, kind="stable")
            self.parts = [_sum_by(c[o], n[o])]
        self.held = sum(len(p[0]) for p in self.parts)

    def _spread(self) -> None:
        """Codes into counters."""
        self._compact()
        if self.table is None:
            self.exact, self.table = np.zeros(1 << EXACT, np.int64), np.zeros((_LEVELS, DEPTH, WIDTH), np.int64)
        for c, n in self.parts:
            for level in range(_LEVELS - 1, -1, -1):
                for row in range(DEPTH):
                    h, s = _hash(level, row, c)
                    self.table[level, row] += np.rint(np.bincount(h, s * n, WIDTH)).astype(np.int64)
                c, n = _sum_by(c >> np.uint32(1), n)
            self.exact[c] += n
        self.parts, self.held = [], 0

    def to_bytes(self) -> bytes:
        if self.table is None:
            self._compact()
            c, n = self.parts[0] if self.parts else (np.empty(0, np.uint32), np.empty(0, np.int64))
            small = n.astype(np.int32) if not len(n) or np.abs(n).max() < 1 << 31 else None
            return (b"s" + c.astype("<u4").tobytes() + small.astype("<i4").tobytes()) if small is not None else (b"S" + c.astype("<u4").tobytes() + n.astype("<i8").tobytes())
        self._spread()
        return b"d" + zlib.compress(self.exact.astype("<i8").tobytes() + self.table.astype("<i8").tobytes(), 1)

    @classmethod
    def from_bytes(cls, b: bytes) -> Sketch:
        out = cls()
        if b[:1] == b"d":
            a = np.frombuffer(zlib.decompress(b[1:]), "<i8").astype(np.int64)
            out.exact, out.table = a[: 1 << EXACT].copy(), a[1 << EXACT :].reshape(_LEVELS, DEPTH, WIDTH).copy()
        elif len(b) > 1:
            wide = 4 if b[:1] == b"s" else 8
            k = (len(b) - 1) // (4 + wide)
            out.add(np.frombuffer(b, "<u4", k, 1).astype(np.uint32), np.frombuffer(b, f"<i{wide}", k, 1 + 4 * k).astype(np.int64))
        return out

    def n(self) -> int:
        return int(sum(int(p[1].sum()) for p in self.parts) + (0 if self.exact is None else int(self.exact.sum())))

    def _estimate(self, level: int, prefix: int) -> float:
        one = np.array([prefix], np.uint32)
        got = []
        for row in range(DEPTH):
            h, s = _hash(level, row, one)
            got.append(int(self.table[level, row, h[0]]) * int(s[0]))
        return float(np.median(got))

    def quantiles(self, ps: Sequence[float]) -> np.ndarray:
        """Values at the ranks p * n, by descent through the resolutions; NaN for an empty sketch."""
        self._spread()
        n = int(self.exact.sum())
        if n <= 0:
            return np.full(len(ps), np.nan)
        upto = np.cumsum(self.exact)
        out = []
        for p in ps:
            rank = min(max(p * n, 0.5), n - 0.5)
            code = int(np.searchsorted(upto, rank, side="left"))
            here, rank = float(self.exact[code]), rank - (float(upto[code - 1]) if code else 0.0)
            for level in range(_LEVELS):
                left = min(max(self._estimate(level, 2 * code), 0.0), here)
                if rank <= left:
                    code, here = 2 * code, left
                else:
                    code, here, rank = 2 * code + 1, here - left, rank - left
            out.append(code)
        return decode(np.array(out, np.uint32))

    def rank_error(self) -> float:
        """The share of n within which a found value's rank lies from the one asked for.

        One row's estimate of a node has at most the variance F2 / WIDTH of its resolution, F2 being the sum of squared counts,
        which the sketch itself gives; a descent sums one node of each sketched resolution. The median of DEPTH rows has
        about 0.54 of a row's standard error, so twice a row's is more than three and a half of the median's.
        """
        self._spread()
        n = max(int(self.exact.sum()), 1)
        f2 = np.median((self.table.astype(float) ** 2).sum(2), axis=1)
        return float(2 * np.sqrt(f2.sum() / WIDTH) / n)


def pack_values(df: DataFrame, names: Sequence[str], values: str, keep: Sequence[str]) -> DataFrame:
    """(<keep>, packed): the finite values of the map as 5 bytes each, place of the key and code; far narrower than the map.

    Null, NaN and infinite values, other keys and null maps count for nothing. The place is one byte: up to 256 names.
    """
    if len(names) > 256:
        raise ValueError("more than 256 names")
    keys = pa.array(list(names))
    kept = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column("__values")
            off = np.asarray(m.offsets)
            lo, hi = int(off[0]), int(off[-1])
            col = np.asarray(pc.fill_null(pc.index_in(m.keys.slice(lo, hi - lo), value_set=keys), -1))
            val = np.asarray(pc.fill_null(m.items.slice(lo, hi - lo), np.nan), float)
            ok = (col >= 0) & np.isfinite(val)
            rec = np.empty(int(ok.sum()), np.dtype([("c", "u1"), ("v", "<u4")]))
            rec["c"], rec["v"] = col[ok], encode(val[ok])
            ends = np.concatenate([[0], np.cumsum(ok)])[off - lo] * 5
            packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(rec.tobytes())])
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], packed], names=[*kept, "packed"])

    kinds = dict(df.dtypes)
    return df.select(*kept, F.col(values).alias("__values")).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in kept) + ", packed binary")


_SKETCH = "grouping string, group_value string, load_id int, c int, sketch binary"


def partial_sketches(packed: DataFrame, groupings: Sequence[str], load: str | None) -> DataFrame:
    """(grouping, group_value, load_id, c, sketch): sketches of each task's rows, per value of each grouping column, load and key.

    The map-side half of the aggregation: a task holds at most a few million distinct (group, key, code), then passes them on.
    """
    groups = list(groupings)
    cols = [*groups, *([load] if load else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def compact() -> None:
            nonlocal held, count
            k, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            o = np.argsort(k, kind="stable")
            held = [_sum_by(k[o], n[o])]
            count = len(held[0][0])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            compact()
            k, n = held[0]
            names = list(ids)
            at = np.flatnonzero(np.concatenate([[True], k[1:] >> np.uint64(BITS) != k[:-1] >> np.uint64(BITS)]))
            rows = []
            for a, z in zip(at, [*at[1:], len(k)]):
                top = int(k[a] >> np.uint64(BITS))
                s = Sketch().add((k[a:z] & np.uint64((1 << BITS) - 1)).astype(np.uint32), n[a:z])
                g, v, ld = names[top >> 8]
                rows.append((groups[g], v, ld, top & 255, s.to_bytes()))
            for i in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 2000]), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()))], names=["grouping", "group_value", "load_id", "c", "sketch"])
            held, count = [], 0
            ids.clear()

        for b in batches:
            if not b.num_rows:
                continue
            p = b.column("packed")
            off = np.frombuffer(p.buffers()[1], np.int32, len(p) + 1, p.offset * 4)
            data = np.frombuffer(p.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
            rec = np.frombuffer(data.tobytes(), np.dtype([("c", "u1"), ("v", "<u4")]))
            if not len(rec):
                continue
            row = np.repeat(np.arange(len(p)), np.diff(off) // 5)
            loads = b.column(load).to_pylist() if load else [None] * len(p)
            for g, name in enumerate(groups):
                key = np.array([ids.setdefault((g, v, ld), len(ids)) for v, ld in zip(b.column(name).to_pylist(), loads)], np.uint64)
                k = ((key[row] << np.uint64(8) | rec["c"].astype(np.uint64)) << np.uint64(BITS)) | rec["v"].astype(np.uint64)
                u, n = np.unique(k, return_counts=True)
                held.append((u, n))
                count += len(u)
            if count > 4_000_000:
                compact()
                if count > 2_000_000:
                    yield from flush()
        if held:
            yield from flush()

    return packed.select(*cols, "packed").mapInArrow(run, _SKETCH)


def merge_sketches(sketches: DataFrame, keys: Sequence[str] = ("grouping", "group_value", "load_id", "c"), per_key: int = 1000) -> DataFrame:
    """One sketch per ``keys``: sums of the sketches, streamed in key order, so no group is gathered in memory.

    A key with very many sketches (from more than ``per_key`` tasks) is first merged in salted parts.
    """
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, acc, out = None, None, []

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([*kinds, pa.binary()])], names=[*keys, "sketch"])

        kinds = None
        for b in batches:
            kinds = kinds or [b.column(k).type for k in keys]
            for *key, s in zip(*[b.column(k).to_pylist() for k in keys], b.column("sketch")):
                if key != now:
                    if acc is not None:
                        out.append((*now, acc.to_bytes()))
                        if len(out) >= 500:
                            yield emit()
                            out = []
                    now, acc = key, Sketch()
                acc.merge(Sketch.from_bytes(s.as_py()))
        if acc is not None:
            out.append((*now, acc.to_bytes()))
            yield emit()

    names = dict(sketches.dtypes)
    schema = ", ".join(f"{k} {names[k]}" for k in keys) + ", sketch binary"
    x = sketches.select(*keys, "sketch")
    # Partial sketches come from the tasks after a shuffle.
    if (parts := int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))) > per_key:
        salt = F.pmod(F.xxhash64("sketch"), F.lit(-(-parts // per_key)))
        x = x.withColumn("__s", salt).repartition(*keys, "__s").sortWithinPartitions("__s", *keys).select(*keys, "sketch").mapInArrow(run, schema)
    return x.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def deleted(sketches: DataFrame) -> DataFrame:
    """The same sketches with all counts negative: merged with others they take their values away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [Sketch().merge(Sketch.from_bytes(s.as_py()), -1).to_bytes() for s in b.column("sketch")]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if n == "sketch" else b.column(n) for n in b.schema.names], names=b.schema.names)

    return sketches.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in sketches.dtypes))


def percentiles(sketches: DataFrame, names: Sequence[str], ps: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """(<keys>, feature, n, p, estimate, rank_error, value_error) from merged sketches.

    estimate's rank is within rank_error * n of p * n (see Sketch.rank_error), its value within value_error of a value of that rank.
    """
    keys, names = [k for k in keys if k != "c"], list(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(len(keys) + 6)]
            for *key, c, s in zip(*[b.column(k).to_pylist() for k in keys], b.column("c").to_pylist(), b.column("sketch")):
                k = Sketch.from_bytes(s.as_py())
                n = k.n()
                if n <= 0:
                    continue
                err = k.rank_error()
                for p, q in zip(ps, k.quantiles(ps)):
                    for col, v in zip(out, (*key, names[c], n, p, float(q), err, abs(float(q)) * 2.0**-12 + np.finfo(float).tiny)):
                        col.append(v)
            kinds = [*[b.column(k).type for k in keys], pa.string(), pa.int64(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=[*keys, "feature", "n", "p", "estimate", "rank_error", "value_error"])

    types = dict(sketches.dtypes)
    return sketches.mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", feature string, n bigint, p double, estimate double, rank_error double, value_error double")


def within_bounds(values: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(<keys>, feature, n, within): whether each estimate of ``found`` (see percentiles) keeps its stated errors of rank and value.

    ``values``: keys, feature, v, the values themselves. Each is compared with its group's few estimates, and ranks are counted map-side.
    """
    keys = [*keys, "feature"]
    q = found.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("p", "estimate", "rank_error", "value_error"))).alias("q"))
    q = q.select(*[F.col(k).alias(f"__{k}") for k in keys], "n", "q")
    x = values.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("m"))
    x = x.join(q, [x[k].eqNullSafe(q[f"__{k}"]) for k in keys])
    most = int(found.agg(F.count_distinct("p")).first()[0] or 0)
    e = lambda i: F.get("q", F.lit(i))
    below = [F.sum(F.when(F.col("v") < e(i)["estimate"] - e(i)["value_error"], F.col("m")).otherwise(0)).alias(f"b{i}") for i in range(most)]
    upto = [F.sum(F.when(F.col("v") <= e(i)["estimate"] + e(i)["value_error"], F.col("m")).otherwise(0)).alias(f"u{i}") for i in range(most)]
    r = x.groupBy(*keys).agg(F.sum("m").alias("all"), F.max("n").alias("n"), F.max("q").alias("q"), *below, *upto)
    ok = F.col("n") == F.col("all")
    for i in range(most):
        ok = ok & (F.col(f"b{i}") / F.col("all") <= e(i)["p"] + e(i)["rank_error"] + 1 / F.col("all")) & (F.col(f"u{i}") / F.col("all") >= e(i)["p"] - e(i)["rank_error"] - 1 / F.col("all"))
    return r.select(*keys, "n", ok.alias("within"))
