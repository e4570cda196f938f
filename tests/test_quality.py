import random

import numpy as np
import pytest

from cadenza.operators import quality as q


def rows(loads=8, n=300, seed=1):
    rng = random.Random(seed)
    out = []
    for load in range(loads):
        for i in range(n):
            m = {c: rng.gauss(10, 2) for c in ("a", "b", "c", "d")}
            if load == 3:
                m["a"] = None if rng.random() < 0.5 else m["a"]
            if load == 4:
                m["b"] *= 1000
            if load == 5:
                m["c"] = 7.25 if rng.random() < 0.7 else m["c"]
            if rng.random() < 0.02:
                m["d"] = rng.choice([None, float("nan"), float("inf"), -999.0, 1e9])
            sha = f"{rng.getrandbits(64):016x}" * 4
            out.append((load, f"ai_x_{i:016x}", sha[:40] if load == 6 and rng.random() < 0.3 else sha, m, "clash"))
    return out


SCHEMA = "load_id int, id string, sha256 string, features map<string,double>, level string"
SPEC = q.Spec("load_id", {"id": "^ai_[a-z]_[0-9a-f]{16}$", "sha256": "^[0-9a-f]{64}$"}, "features", ["a", "b", "c", "d"])


def test_changed_columns_finds_what_was_planted(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = {(r["load_id"], r["column_name"]) for r in q.changed_columns(df, SPEC).collect()}
    assert got == {(3, "a"), (4, "b"), (5, "c"), (6, "sha256")}


def test_profile_is_exact(spark):
    data = rows(3, 50)
    p = {(r["load_id"], r["column_name"]): r for r in q.profile(spark.createDataFrame(data, SCHEMA), SPEC).collect()}
    for load in range(3):
        v = [m["d"] for ld, _, _, m, _ in data if ld == load]
        ok = [x for x in v if x is not None and np.isfinite(x) and x != -999]
        r = p[load, "d"]
        assert (r["rows"], r["missing"], r["distinct_values"]) == (len(v), len(v) - len(ok), len(set(ok)))
        assert (r["lowest"], r["highest"]) == (min(ok), max(ok)) and r["average"] == pytest.approx(np.mean(ok)) and r["deviation"] == pytest.approx(np.std(ok), rel=1e-6)


def test_nulls_empty_and_single_load(spark):
    none = spark.createDataFrame([(1, None, None, None, None), (None, "x", " ", {"a": 1.0}, "y"), (1, "ai_x_0", "z", {"a": None, "zz": 3.0}, "y")], SCHEMA)
    p = {(r["load_id"], r["column_name"]): r for r in q.profile(none, SPEC).collect()}
    assert (p[1, "a"]["rows"], p[1, "a"]["missing"], p[1, "a"]["lowest"]) == (2, 2, None)
    assert (p[1, "id"]["missing"], p[1, "id"]["violations"]) == (1, 1)
    assert q.changed_columns(none, SPEC).count() == 0
    assert q.changed_columns(spark.createDataFrame([], SCHEMA), SPEC).count() == 0


def test_expected_groups_count_absent_keys(spark):
    from pyspark.sql import functions as F

    spec = q.Spec("load_id", {}, "features", ["s1", "d1"], lambda n: n[0], F.split("combo", r"\+"))
    df = spark.createDataFrame([(1, "s+d", {"s1": 1.0}), (1, "s", {"s1": 2.0}), (1, "d", {})], "load_id int, combo string, features map<string,double>")
    p = {r["column_name"]: (r["rows"], r["missing"]) for r in q.profile(df, spec).collect()}
    assert p == {"s1": (2, 0), "d1": (2, 2)}


def test_logistic_separates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)).astype(np.float32)
    y = x[:, 1] > 0
    w = q.logistic(x, y)
    assert abs(w[1]) > 5 * max(abs(w[0]), abs(w[2]))


def test_rank_test_is_mann_whitney_with_ties():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 6, 80), rng.integers(1, 7, 120)
    area, z = q.rank_test(np.bincount(a, minlength=8)[None], np.bincount(b, minlength=8)[None])
    want = np.mean([(x > y) + 0.5 * (x == y) for x in a for y in b])
    n, t = 200, np.unique(np.concatenate([a, b]), return_counts=True)[1]
    sd = np.sqrt(((n + 1) - (t**3 - t).sum() / (n * (n - 1))) / (12 * 80 * 120))
    assert area[0] == pytest.approx(want) and z[0] == pytest.approx((want - 0.5) / sd)
    assert q.rank_test(np.array([[5, 0]]), np.array([[7, 0]]))[1][0] == 0


def test_ablation_says_which_column_the_classifier_needs(spark):
    df = spark.createDataFrame(rows(6, 400), SCHEMA)
    scale = q.scales(df, SPEC)
    t = {(r["load_id"], r["column_name"]): r for r in q.two_sample(df, SPEC, q.profile(df, SPEC, scale), scale).collect()}
    assert t[4, "b"]["auc"] > 0.9 and t[4, "b"]["auc_without"] < 0.6 and t[4, "b"]["shift"] > 20
    assert abs(t[4, "d"]["auc_alone"] - 0.5) < 0.06 and t[4, "d"]["auc_without"] > 0.9
    assert len({x for x, _ in t}) == 6 and len(t) == 36


def test_changed_columns_finds_repetition(spark):
    """Well-formed texts that collapse, a measurement rounded to many levels, a column that usually repeats and repeats far more."""
    rng = random.Random(5)
    out = []
    for load, n in enumerate((1200, 1500, 1000, 1300, 1200, 400)):
        few = [f"ai_x_{i:016x}" for i in range(40)]
        for i in range(n):
            m = {"a": rng.gauss(10, 2), "b": float(rng.randrange(10_000)), "c": rng.gauss(10, 2), "d": float(rng.randrange(200 if load != 4 else 25))}
            m["d"] = m["d"] * 8 if load == 4 else m["d"]
            m["a"] = round(m["a"] * 20) / 20 if load == 1 else m["a"]
            out.append((load, few[i % 40] if load == 2 else f"ai_x_{rng.getrandbits(64):016x}", f"{rng.getrandbits(256):064x}" if load == 3 else f"{i % 9:064x}", m, "clash"))
    got = {(r["load_id"], r["column_name"]) for r in q.changed_columns(spark.createDataFrame(out, SCHEMA), SPEC).collect()}
    assert got == {(1, "a"), (2, "id"), (3, "sha256"), (4, "d")}
