import datetime
import random

import pytest
from cadenza.llm import overlap

NAMES = [f"m{i}" for i in range(27)]
REC = "id string, member_name string, input_sha256 string, waveform_sha256 string"
INV = "path string, source string, bytes bigint, sha256 string, byte_identical_copy boolean"
MEA = "id string, seconds double, v array<double>"
A, B, C, D = ("a" * 64, "b" * 64, "c" * 64, "d" * 64)


def classes(spark, rec, inv=(), mea=(), **kw):
    mea = [(i, s, [m.get(k) for k in NAMES]) for i, s, m in mea]
    c = overlap.overlap_classes(spark.createDataFrame(list(rec), REC), spark.createDataFrame(list(inv), INV), spark.createDataFrame(mea, MEA), len(NAMES), **kw).collect()
    out = {}
    for r in c:
        out.setdefault(r["class_id"], set()).add(r["id"])
    return sorted(map(sorted, out.values()))


def measured(n, seed=3):
    r = random.Random(seed)
    return [(f"u{i:04d}", r.uniform(30, 300), {k: r.gauss(0, 1) for k in NAMES}) for i in range(n)]


def near(row, new, seed, broken=4, shift=0.2):
    r = random.Random(seed)
    m = {k: v + r.gauss(0, 0.002) for k, v in row[2].items()}
    for k in r.sample(NAMES, broken):
        m[k] = r.choice([None, float("nan"), -999.0, 1e6])
    return (new, row[1] + shift, m)


def test_same_files_in_every_notation_but_not_empty_or_unknown(spark):
    rec = [
        ("r1", "x1.wav", A, None), ("r2", "x2.wav", f"SHA256:{A.upper()}", None), ("r3", "x3.wav", None, B), ("r4", "x4.wav", f" {C}\n", B),
        ("e1", "e1.wav", overlap.EMPTY_SHA256, None), ("e2", "e2.wav", overlap.EMPTY_SHA256, None), ("z1", "z1.wav", "0" * 64, "0" * 64), ("z2", "z2.wav", "0" * 64, "0" * 64), ("n1", None, "", None), ("n2", None, "", None), (None, "q", A, None),
    ]
    inv = [("./in\\x4.wav", None, 5, D, None), ("y/x5.wav", "other//z.bin", 5, None, True), ("other/z.bin", None, 5, D, None), ("k/e1.wav", None, 0, A, None), (None, None, None, None, None)]
    assert classes(spark, [*rec, ("r5", "x5.wav", None, None)], inv) == [["r1", "r2"], ["r3", "r4", "r5"]]


def test_near_recordings_are_found_and_others_are_not(spark):
    base = measured(400)
    extra = [near(base[i], f"v{i:04d}", i) for i in range(40)] + [near(base[i], f"w{i:04d}", i, shift=0.7) for i in range(50, 60)]
    got = classes(spark, [(m[0], m[0], None, None) for m in base + extra], mea=base + extra)
    assert got == [[f"u{i:04d}", f"v{i:04d}"] for i in range(40)]


def test_a_group_of_a_third_of_all_rows_stays_connected(spark):
    base = measured(300)
    hot = [near(base[0], f"h{i:04d}", i, broken=i % 5, shift=0.3 * random.Random(i).random() - 0.15) for i in range(200)] + [(f"c{i}", base[0][1], dict(base[0][2])) for i in range(20)]
    got = classes(spark, [(m[0], m[0], None, None) for m in base + hot], mea=base + hot, most=60)
    assert got == [sorted(["u0000", *[h[0] for h in hot]])]


def same(a, b, unit):
    """The rule in plain Python, on exact values."""
    if a[1] is not None and b[1] is not None and abs(a[1] - b[1]) >= 0.5:
        return False
    usable = lambda x: x is not None and x == x and abs(x) < 30
    d = sorted(abs(a[2][k] - b[2][k]) / unit[k] for k in NAMES if usable(a[2][k]) and usable(b[2][k]))
    return len(d) >= 8 and d[(len(d) + 1) // 2 - 1] <= 0.02 and sum(x <= 0.05 for x in d) >= 0.6 * len(d)


@pytest.mark.parametrize("most", [20_000, 40])
def test_chains_in_small_and_large_blocks_equal_all_pairs(spark, most):
    """Takes that drift, so that ends of a chain are not the same and only what lies between ties them; cut blocks give the same classes as whole ones."""
    r = random.Random(5)
    base = measured(200, seed=9)
    rows = list(base)
    for c in range(3):
        m, t = dict(base[0][2]), base[0][1]
        m.update({k: r.gauss(0, 1) for k in NAMES[12 + 5 * c : 17 + 5 * c]})  # takes that share most cells and are not the same
        for i in range(60):
            m = {k: v + r.gauss(0, 0.008) for k, v in m.items()}
            rows.append((f"k{c}{i:03d}", t, dict(m)))
    quartile = lambda k, q: sorted(x[2][k] for x in rows)[int(q * len(rows))]
    unit = {k: quartile(k, 0.75) - quartile(k, 0.25) for k in NAMES}
    root = {x[0]: x[0] for x in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if same(a, b, unit):
                root[find(a[0])] = find(b[0])
    want = {}
    for x in rows:
        want.setdefault(find(x[0]), []).append(x[0])
    got = classes(spark, [(x[0], x[0], None, None) for x in rows], mea=rows, most=most)
    assert got == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_measurements_are_merged_by_trust_then_time(spark):
    t = "id string, features map<string,double>, at timestamp, v int"
    day = lambda n: datetime.datetime(2030, 1, n)
    a = spark.createDataFrame([("x", {"m0": 1.0, "m1": None, "q": 5.0}, day(1), 0), ("x", {"m0": 2.0, "m1": float("nan")}, day(2), 0), (None, {"m0": 9.0}, day(1), 0), ("e", {}, day(1), 0), ("n", None, None, 0)], t)
    b = spark.createDataFrame([("x", {"m0": 7.0, "m1": 3.0, "m2": -999.0}, day(9), 0), ("y", {"m2": float("inf"), "m0": 4.0}, None, 0)], t)
    got = {r["id"]: r["v"] for r in overlap.measurements([(a, "id", "features", "at"), (b, "id", "features", "at")], ["m0", "m1", "m2"]).collect()}
    assert got == {"x": [2.0, 3.0, None], "y": [4.0, None, None]}


def test_classes_across_splits_carry_their_links(spark):
    c = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "e"), ("f", "e")], "id string, class_id string")
    s = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "train"), ("d", None), ("b", "test"), ("e", "test"), ("f", "validation")], "id string, split string")
    assert sorted(map(tuple, overlap.cross_split_classes(c, s).collect())) == [("a", "a", "train", 1), ("b", "a", "test", 2), ("c", "a", "train", 1)]


def test_pairs_only_across_splits(spark):
    c = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", "a")], "id string, class_id string")
    s = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "train"), ("d", None), ("b", "test")], "id string, split string")
    assert sorted((r["id_a"], r["id_b"]) for r in overlap.cross_split_pairs(c, s).collect()) == [("a", "b"), ("b", "c")]


def test_empty_tables_and_missing_measurements(spark):
    assert classes(spark, []) == []
    assert classes(spark, [("a", None, None, None), ("b", None, None, None)], mea=[("a", None, {k: None for k in NAMES}), ("b", None, {})]) == []


def test_unknown_lengths_are_no_obstacle(spark):
    base = measured(60)
    rows = base + [(f"v{i}", None, dict(base[i][2])) for i in range(5)]
    assert classes(spark, [(m[0], m[0], None, None) for m in rows], mea=rows) == [[f"u{i:04d}", f"v{i}"] for i in range(5)]
