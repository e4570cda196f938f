"""Same or near-same records across splits (problem 3): similarity fingerprints and segmented code blocks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.graph import components
from cadenza.session import cut

#: SHA-256 of no bytes, and digests that stand for an unknown file.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
UNKNOWN_SHA256 = ["0" * 64, "f" * 64]
#: Numbers that stand for a missing measurement.
STAND_INS = (-999.0,)

#: Cells per measured value (4 bits, in Gray code; 15 is for unknown), measurements per block, bits of 108 by which fingerprints of the same
#: recording may differ; steps of the counts behind the cells, and known measurements that two records must share.
CELLS, BLOCK, RADIUS, FINE, LEAST = 15, 5, 34, 400, 8
#: Values are kept in thousandths of an interquartile range from the median; those beyond 32 ranges count as unknown.
STEP, UNKNOWN = 1000, -32768


def file_digest(c: Column) -> Column:
    """The 64 hex digits of a digest however written; null if malformed, of an empty file or unknown."""
    d = F.regexp_replace(F.lower(F.regexp_replace(c, r"\s+", "")), r"^sha-?256[:=]", "")
    return F.when(d.rlike("^[0-9a-f]{64}$") & (d != EMPTY_SHA256) & ~d.isin(UNKNOWN_SHA256), d)


def file_path(c: Column) -> Column:
    """One spelling for a path: forward slashes, no leading or doubled './'."""
    p = F.regexp_replace(F.regexp_replace(F.trim(c), r"\\", "/"), r"/(\./)*/*", "/")
    return F.regexp_replace(p, r"^(\./)+", "")


def measurements(tables: Sequence[tuple[DataFrame, str, str, str]], names: Sequence[str]) -> DataFrame:
    """(id, v array<double> in the order of ``names``): one row per id, merged from several tables of measurements.

    ``tables``: (table, id column, column of a map of measurements, column of a timestamp), the most trusted first. Of an id's usable
    values of a name the latest of the most trusted table that has one counts, on ties the one of the greatest hash; null, NaN,
    infinite and stand-in values are not usable. The state per id and name is one value, combined map-side, however often an id is
    delivered. Ids without a usable value and null ids give no row; other names and columns are not read.
    """
    names = list(names)
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    long = None
    for trust, (t, id_, values, at) in enumerate(reversed(tables)):
        x = t.where(F.col(id_).isNotNull()).select(F.col(id_).cast("string").alias("id"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.explode(values).alias("name", "x"))
        x = x.where(F.col("name").isin(names) & F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < F.lit(float("inf"))) & ~F.col("x").isin(list(STAND_INS)))
        order = F.lit(trust << 60) + F.shiftleft(F.coalesce("t", F.lit(0)), 6) + F.xxhash64("x").bitwiseAND(F.lit(63))
        x = x.select("id", F.try_element_at(place, F.col("name")).alias("c"), "x", order.alias("o"))
        long = x if long is None else long.unionAll(x)
    best = long.groupBy("id", "c").agg(F.max_by("x", "o").alias("x"))
    wide = best.groupBy("id").agg(*[F.max(F.when(F.col("c") == i, F.col("x"))).alias(f"x{i}") for i in range(len(names))])
    return wide.select("id", F.array(*[f"x{i}" for i in range(len(names))]).alias("v"))


def _orders(n: int) -> list[np.ndarray]:
    """Two cyclic orders of the measurements: as they are, so that a family that was measured alone has runs of its own, and strided across families."""
    stride = next(s for s in range(n // 3 + 1, 3 * n + 3) if np.gcd(s, n) == 1)
    return [np.arange(n), np.arange(n) * stride % n]


def fingerprints(measured: DataFrame, n: int) -> DataFrame:
    """(id, key, seconds, code binary, v binary): 4 bits per measurement and the values in thousandths, key a hash of id.

    The cuts between cells are quantiles of each measurement over all rows, from counts in FINE equal steps between its
    1st and 99th percentile, of which none counts more than three times its share: so cells are about equally
    likely, and a group of copies that holds a third of all rows falls into one cell, not across several. Values are int16 in units of
    1/STEP of the measurement's interquartile range, from its median. Unknown values have code 15. Records with fewer than LEAST
    known values are left out. ``measured``: id, seconds, v (array<double> of ``n``, null for unknown).
    """
    long = measured.select(F.posexplode("v").alias("c", "x")).where("x is not null and not isnan(x)")
    known = {r["c"]: r["q"] for r in long.groupBy("c").agg(F.percentile_approx("x", [0.01, 0.25, 0.5, 0.75, 0.99], 2000).alias("q")).collect()}  # n x 5 numbers
    q = np.array([known.get(i) or [0.0, 0.0, 0.0, 1.0, 1.0] for i in range(n)])
    low, mid = q[:, 0], q[:, 2]
    width = np.where(q[:, 4] > low, q[:, 4] - low, 1.0)
    scale = np.where(q[:, 3] - q[:, 1] > width / 50, q[:, 3] - q[:, 1], width / 4)
    look = lambda d: F.element_at(F.array(*[F.lit(float(v)) for v in d]), F.col("c") + 1)
    fine = F.floor((F.col("x") - look(low)) / look(width) * FINE).alias("fine")
    counts = long.select("c", fine).where(F.col("fine").between(0, FINE - 1)).groupBy("c", "fine").count().collect()  # n x FINE numbers at most
    held = np.zeros((n, FINE))
    for r in counts:
        held[r["c"], r["fine"]] = r["count"]
    held = np.minimum(held, 3 * held.sum(1, keepdims=True) / FINE) + 1e-9
    upto = np.cumsum(held, axis=1) / held.sum(1, keepdims=True)
    edges = [low[i] + width[i] * (np.searchsorted(upto[i], np.arange(1, CELLS) / CELLS) + 1) / FINE for i in range(n)]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.asarray([np.asarray(x, float) for x in pdf["v"]], float).reshape(len(pdf), -1)
            z = np.round((v - mid) / scale * STEP)
            v[~(np.abs(z) < -UNKNOWN)] = np.nan
            code = np.stack([np.searchsorted(e, v[:, i]) for i, e in enumerate(edges)], 1).astype(np.uint8)
            code[np.isnan(v)] = 15
            z = np.where(np.isnan(v), UNKNOWN, z).astype("<i2")
            ok = (code < 15).sum(1) >= LEAST
            yield pd.DataFrame({"id": pdf["id"][ok], "key": pdf["key"][ok], "seconds": pdf["seconds"][ok], "code": _pack(code[ok]), "v": [x.tobytes() for x in z[ok]]})

    return measured.select("id", F.xxhash64("id").alias("key"), "seconds", "v").mapInPandas(encode, "id string, key bigint, seconds double, code binary, v binary")


def _pack(code: np.ndarray) -> list[bytes]:
    code = np.pad(code, ((0, 0), (0, code.shape[1] % 2)), constant_values=15)
    return [x.tobytes() for x in code[:, ::2] << 4 | code[:, 1::2]]


def _unpack(codes, n: int) -> np.ndarray:
    x = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return np.stack([x >> 4, x & 15], 2).reshape(len(x), -1)[:, :n]


def _words(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint bits of codes: Gray code of each cell and a mask of the bits that are known."""
    gray = code ^ (code >> 1)
    bits = ((gray[:, :, None] >> np.arange(4, dtype=np.uint8)) & 1).reshape(len(code), -1)
    known = np.repeat(code < 15, 4, axis=1)
    pad = -bits.shape[1] % 64
    pack = lambda x: np.packbits(np.pad(x, ((0, 0), (0, pad))).astype(np.uint8), axis=1).view(np.uint64)
    return pack(bits), pack(known)


class _Rows:
    """Records of a block: fingerprint words, values, lengths and keys; ``same`` says which of them are the same recording."""

    def __init__(self, pdf: pd.DataFrame, n: int, rule: Mapping[str, float]) -> None:
        self.bits, self.known = _words(_unpack(pdf["c"], n))
        self.v = np.frombuffer(b"".join(pdf["v"]), "<i2").reshape(len(pdf), n)
        self.seconds, self.key = pdf["seconds"].to_numpy(float), pdf["key"].to_numpy()
        self.rule = rule

    def same(self, i, j) -> np.ndarray:
        """Lengths, then the Hamming radius over bits known in both (in proportion where fewer are known), then the values themselves."""
        i, j = np.broadcast_arrays(i, j)
        ok = ~(np.abs(self.seconds[i] - self.seconds[j]) >= self.rule["seconds"])
        at = np.flatnonzero(ok)
        both = self.known[i[at]] & self.known[j[at]]
        n = np.bitwise_count(both).sum(-1)
        far = np.bitwise_count((self.bits[i[at]] ^ self.bits[j[at]]) & both).sum(-1)
        at = at[(n >= 4 * LEAST) & (far * 108 <= RADIUS * n)]
        a, b = self.v[i[at]].astype(np.int32), self.v[j[at]].astype(np.int32)
        both, d = (a != UNKNOWN) & (b != UNKNOWN), np.abs(a - b)
        n = both.sum(1)
        close = ((d <= self.rule["close"] * STEP) & both).sum(1)
        middle = ((d <= self.rule["median"] * STEP) & both).sum(1)
        ok[:] = False
        ok[at[(n >= LEAST) & (middle >= (n + 1) // 2) & (close >= self.rule["share"] * n)]] = True
        return ok


def _neighbours(x: _Rows, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All links within runs of rows: rows k apart, k by k; for many runs of few rows."""
    a, b, alive, k = [], [], np.arange(len(run)), 1
    while len(alive := alive[alive + k < len(run)]):
        alive = alive[run[alive] == run[alive + k]]
        hit = alive[x.same(alive, alive + k)]
        a.append(x.key[hit])
        b.append(x.key[hit + k])
        k += 1
    return np.concatenate([*a, np.empty(0, np.int64)]), np.concatenate([*b, np.empty(0, np.int64)])


def _spanning(x: _Rows, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, group of each row): links that connect exactly what all links between the rows would, fewer than there are rows.

    Breadth first: each row is compared once with the rows that are in no group reached so far; a reached row brings the
    rows of its ``group`` (from links known before) along. A group of copies is reached in one step, so it costs its number of rows.
    """
    member = pd.Series(np.arange(len(group))).groupby(group, sort=False).indices
    order = np.argsort(np.where(np.isnan(x.seconds), -np.inf, x.seconds), kind="stable")
    length, unknown = x.seconds[order], int(np.isnan(x.seconds).sum())
    low = np.searchsorted(length[unknown:], length - x.rule["seconds"] - 1e-3) + unknown
    high = np.searchsorted(length[unknown:], length + x.rule["seconds"] + 1e-3, "right") + unknown
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    left = np.ones(len(group), bool)  # by place in the order of lengths
    out, a, b = np.empty(len(group), np.int64), [], []
    for start in range(len(group)):
        if not left[place[start]]:
            continue
        queue = list(member[group[start]])
        left[place[queue]] = False
        for i in queue:  # grows while it is walked
            out[i] = start
            p = place[i]
            if p < unknown:
                rest = order[np.flatnonzero(left)]
            else:
                rest = order[np.concatenate([np.flatnonzero(left[:unknown]), low[p] + np.flatnonzero(left[low[p] : high[p]])])]
            for j in rest[x.same(np.full(len(rest), i), rest)] if len(rest) else ():
                if left[place[j]]:
                    a.append(x.key[i])
                    b.append(x.key[j])
                    new = member[group[j]]
                    left[place[new]] = False
                    queue.extend(new)
    return np.array(a, np.int64), np.array(b, np.int64), out


def block_links(prints: DataFrame, n: int, rule: Mapping[str, float], most: int = 20_000) -> DataFrame:
    """Links (a, b), a < b, between keys of the same recordings whose fingerprints share a code block; a spanning set of them.

    Each fingerprint is sent to the block of every run of BLOCK known measurements in two cyclic orders. What shares a
    block is compared by length, Hamming radius and values. Blocks of all sizes give the same: links that connect
    exactly the rows that comparing all of the block's pairs would connect, never all pairs of a group. Blocks above ``most``
    rows (there are at most rows / most of them) are cut into parts of about that many by a hash; each part is linked, then one row of each
    group of each part. Blocks that are not one group by then are linked again over every two of their parts, starting from the groups
    known so far, so no link between parts is lost.
    """
    orders = _orders(n)
    weights = np.random.default_rng(7).integers(1, 2**63 - 1, (len(orders), BLOCK), np.int64)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each run of known measurements; a block is a hash of its order, its measurements and their cells."""
        for pdf in batches:
            if not len(pdf):
                continue
            code = _unpack(pdf["code"], n).astype(np.int64)
            for order, w in zip(orders, weights):
                c = code[:, order]
                known = np.argsort(c == 15, axis=1, kind="stable")  # the known ones first, in their order
                count = (c < 15).sum(1)
                for start in range(n):
                    at = np.flatnonzero(count > start)
                    if not len(at):
                        break
                    run = (start + np.arange(BLOCK)) % count[at, None]
                    where = np.take_along_axis(known[at], run, 1)
                    with np.errstate(over="ignore"):
                        block = ((where * 16 + np.take_along_axis(c[at], where, 1) + 1) * w).sum(1)
                        block = (block ^ (block >> 29)) * np.int64(0x1B873593CC9E2D51)
                    yield pd.DataFrame({"key": pdf["key"].to_numpy()[at], "seconds": pdf["seconds"].to_numpy()[at], "c": pdf["code"].to_numpy()[at], "v": pdf["v"].to_numpy()[at], "block": block})

    rows = prints.select("key", "seconds", "code", "v").mapInPandas(spread, "key bigint, seconds float, c binary, v binary, block bigint")
    # A block's size is needed only for those above ``most``.
    hot = cut(rows.groupBy("block").agg(F.count(F.lit(1)).alias("rows_")).where(F.col("rows_") > most))
    whole = lambda x: x.withColumns({"part": F.lit(-1), "grp": F.col("key")})
    if hot.isEmpty():
        return _link(whole(rows), n, rule).where("b is not null").select("a", "b").distinct()
    rows = rows.join(hot, "block", "left")
    parts = F.when(F.col("rows_").isNotNull(), F.ceil(F.col("rows_") / most)).otherwise(0).cast("int")
    rows = cut(rows.withColumns({"parts": parts, "part": F.when(parts > 0, F.pmod(F.xxhash64("key", "block"), parts)).otherwise(-1).cast("int"), "grp": F.col("key")}).drop("rows_"))
    found = cut(_link(rows.drop("parts"), n, rule))
    one = found.where("b is null").select(F.col("a").alias("key"), "block").join(rows.where("part >= 0").select("key", "seconds", "c", "v", "block"), ["key", "block"])
    found = cut(found.where("b is not null").select("a", "b").unionAll(_link(whole(one), n, rule).where("b is not null").select("a", "b")).distinct())
    group = components(found, "a", "b").withColumnRenamed("node", "key")
    in_hot = rows.where("part >= 0").join(group, "key", "left").withColumn("grp", F.coalesce("root", "key")).drop("root")
    split = in_hot.groupBy("block").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).where("g0 <> g1").select("block")
    again = cut(in_hot.join(split, "block", "left_semi"))
    if again.isEmpty():
        return found
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    again = again.where("parts > 1").select("*", other).where("other <> part").withColumn("part", F.least("part", "other") * F.lit(1 << 15) + F.greatest("part", "other")).drop("other", "parts")
    return found.unionAll(_link(again, n, rule).where("b is not null").select("a", "b")).distinct()


def _link(rows: DataFrame, n: int, rule: Mapping[str, float]) -> DataFrame:
    """(a, b, block): links within each block and part; and, where part is 0 or more, a row (a, null, block) for each group of the part."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
            keep = a != b
            return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": pd.array(np.maximum(a, b)[keep], "Int64"), "block": pd.array([None] * int(keep.sum()), "Int64")})

        def done(pdf: pd.DataFrame, run: np.ndarray, size: np.ndarray) -> Iterator[pd.DataFrame]:
            """Complete blocks: those of few rows together, larger ones (and parts) one by one."""
            alone = (pdf["part"].to_numpy() >= 0) | (size > 16)
            few = (size > 1) & ~alone
            if few.any():
                yield made(*_neighbours(_Rows(pdf[few], n, rule), run[few]))
            for r in np.unique(run[alone]):
                own = pdf[run == r]
                a, b, group = _spanning(_Rows(own, n, rule), own["grp"].to_numpy())
                yield made(a, b)
                if own["part"].iloc[0] >= 0:
                    first = own["key"].to_numpy()[np.unique(group, return_index=True)[1]]
                    yield pd.DataFrame({"a": first, "b": pd.array([None] * len(first), "Int64"), "block": pd.array([own["block"].iloc[0]] * len(first), "Int64")})

        held: list[pd.DataFrame] = []  # the block that isn't complete
        for pdf in batches:
            if not len(pdf):
                continue
            b, s = pdf["block"].to_numpy(), pdf["part"].to_numpy()
            if (b[-1], s[-1]) == (b[0], s[0]) and held and (held[0]["block"].iloc[0], held[0]["part"].iloc[0]) == (b[0], s[0]):
                held.append(pdf)
                continue
            pdf = pd.concat([*held, pdf], ignore_index=True)
            b, s = pdf["block"].to_numpy(), pdf["part"].to_numpy()
            run = np.concatenate([[0], np.cumsum((b[1:] != b[:-1]) | (s[1:] != s[:-1]))])
            size = np.bincount(run)[run]
            last = run == run[-1]
            yield from done(pdf[~last], run[~last], size[~last])
            held = [pdf[last]]
        if held:
            pdf = pd.concat(held, ignore_index=True)
            yield from done(pdf, np.zeros(len(pdf), int), np.full(len(pdf), len(pdf)))

    x = rows.select("key", "seconds", "c", "v", "block", "part", "grp").repartition("block", "part").sortWithinPartitions("block", "part")
    return x.mapInPandas(link, "a bigint, b bigint, block bigint")


def near_links(measured: DataFrame, n: int, close: float = 0.05, share: float = 0.6, median: float = 0.02, seconds: float = 0.5, most: int = 20_000) -> DataFrame:
    """Links (src, dst) between ids whose measurements are nearly all equal and whose lengths differ by less than ``seconds``; a spanning set.

    ``measured``: id, seconds, v (array<double> of ``n`` measurements), one row per id. Of the measurements known in both (LEAST at least)
    the median difference must be at most ``median`` interquartile ranges and ``share`` of them within ``close``. An
    unknown length is no obstacle.
    """
    p = cut(fingerprints(measured, n))
    # Records of equal values and equal length (to the millisecond) have one representative in the block join.
    p = p.withColumn("ms", F.coalesce(F.round("seconds", 3), F.lit(-1.0)))
    rep = cut(p.groupBy("v", "ms").agg(F.min("key").alias("key"), F.max("key").alias("last"), F.min("code").alias("code")))
    alike = p.join(rep.where("key <> last").select("v", "ms", F.col("key").alias("a")), ["v", "ms"]).select("a", F.col("key").alias("b")).where("a <> b")
    rule = {"close": close, "share": share, "median": median, "seconds": seconds}
    links = block_links(rep.select("key", F.when(F.col("ms") >= 0, F.col("ms")).cast("float").alias("seconds"), "code", "v"), n, rule, most).unionAll(alike)
    name = lambda x: p.select(F.col("key").alias(x), F.col("id").alias(f"id_{x}"))
    return cut(links).join(name("a"), "a").join(name("b"), "b").select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")).where("src <> dst")


def same_file_links(records: DataFrame, inventory: DataFrame) -> DataFrame:
    """Links (src, dst) between nodes: 'r:' ids, 'f:' other files by path, that the digests or the inventory make the same file.

    ``records``: id, member_name, input_sha256, waveform_sha256. ``inventory``: path, source, bytes, sha256,
    byte_identical_copy. A path whose last part is a record's member_name is that record. Every digest ties its
    bearers to the least of them (a star, never all pairs); a true byte_identical_copy ties path and source.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    inv = inventory.select(file_path(F.col("path")).alias("path"), file_path(F.col("source")).alias("source"), F.when(F.coalesce(F.col("bytes"), F.lit(1)) > 0, file_digest(F.col("sha256"))).alias("sha"), F.col("byte_identical_copy").alias("same")).distinct()
    members = records.where("member_name is not null").groupBy(F.col("member_name").alias("base")).agg(F.min("id").alias("rid"))
    named = inv.select("path").unionAll(inv.select(F.col("source").alias("path"))).where("path <> ''").distinct()
    node = named.withColumn("base", base(F.col("path"))).join(members, "base", "left").select("path", F.coalesce(F.concat(F.lit("r:"), "rid"), F.concat(F.lit("f:"), "path")).alias("node"))
    src = node.select(F.col("path").alias("source"), F.col("node").alias("source_node"))
    copies = inv.where("same").join(node, "path").join(src, "source").select(F.col("node").alias("src"), F.col("source_node").alias("dst"))
    r = F.concat(F.lit("r:"), "id").alias("node")
    bearers = (
        records.select(r, F.concat(F.lit("d:"), file_digest(F.col("input_sha256"))).alias("digest"))
        .unionAll(records.select(r, F.concat(F.lit("w:"), file_digest(F.col("waveform_sha256"))).alias("digest")))
        .unionAll(inv.where("sha is not null").join(node, "path").select("node", F.concat(F.lit("d:"), "sha").alias("digest")))
        .where("digest is not null")
        .distinct()
    )
    least = bearers.groupBy("digest").agg(F.min("node").alias("src"), F.max("node").alias("last")).where("src <> last")
    return bearers.join(least, "digest").select("src", F.col("node").alias("dst")).where("src <> dst").unionAll(copies.where("src <> dst"))


def overlap_classes(records: DataFrame, inventory: DataFrame, measured: DataFrame, n: int, **near) -> DataFrame:
    """(id, class_id) for each record that is the same recording as another; class_id is the class's smallest id.

    ``records``: id, member_name, input_sha256, waveform_sha256. Links of same files and of near-equal fingerprints are closed
    transitively by least labels with pointer jumping. Null ids are left out; repeated rows of an id count once.
    """
    close = near_links(measured, n, **near).select(F.concat(F.lit("r:"), "src").alias("src"), F.concat(F.lit("r:"), "dst").alias("dst"))
    roots = components(same_file_links(records, inventory).unionAll(close))
    ids = roots.where("node like 'r:%'").select(F.expr("substr(node, 3)").alias("id"), "root")
    least = ids.groupBy("root").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return ids.join(least, "root").select("id", "class_id")


def cross_split_classes(classes: DataFrame, splits: DataFrame) -> DataFrame:
    """(id, class_id, split, links): a row per record of a class that is both in train and in another split.

    links is the number of the class's records on the other side (validation and test for a record in train, train for the others), so
    copies need not be expanded into pairs. A class is counted first, map-side. ``splits``: id, split; records of no known split have no row.
    """
    c = cut(classes.join(splits.distinct(), "id").where("split in ('train', 'validation', 'test')").select("id", "class_id", "split").distinct())
    n = c.groupBy("class_id").agg(F.count_distinct(F.when(F.col("split") == "train", F.col("id"))).alias("t"), F.count_distinct(F.when(F.col("split") != "train", F.col("id"))).alias("o")).where("t > 0 and o > 0")
    return c.join(n, "class_id").select("id", "class_id", "split", F.when(F.col("split") == "train", F.col("o")).otherwise(F.col("t")).alias("links"))


def cross_split_pairs(classes: DataFrame, splits: DataFrame) -> DataFrame:
    """(id_a, id_b, class_id, split): each pair of a train record and one of another split in the same class; id_a < id_b.

    ``splits``: id, split. The pairs are the result asked for; nothing else is paired. cross_split_classes has the same without pairs.
    """
    c = cut(classes.join(splits, "id"))
    t = c.where("split = 'train'").select("class_id", F.col("id").alias("t"))
    o = c.where("split in ('validation', 'test')").select("class_id", F.col("id").alias("o"), "split")
    return t.join(o, "class_id").where("t <> o").select(F.least("t", "o").alias("id_a"), F.greatest("t", "o").alias("id_b"), "class_id", "split").distinct()
