import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import bootstrap, graph, models, relational, sequences
from cadenza.plans import schedule


def union_find(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in edges:
        p[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for x in list(p):
        least[find(x)] = min(least.get(find(x), x), x)
    return {x: least[find(x)] for x in p}


def test_components_match_union_find(spark):
    r = random.Random(1)
    e = [(f"n{r.randint(0, 80):02d}", f"n{r.randint(0, 80):02d}") for _ in range(60)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)]
    got = {x["node"]: x["root"] for x in graph.components(spark.createDataFrame([*e, (None, "x"), ("y", "y")], "src string, dst string")).collect()}
    want = union_find([(a, b) for a, b in e if a != b])
    assert got == want


def test_interval_join_and_nearest_by_brute_force(spark):
    r = random.Random(4)
    pts = [(r.randint(0, 3), r.uniform(0, 50), i) for i in range(80)]
    iv = [(r.randint(0, 3), (s := r.uniform(0, 50)), s + r.uniform(0, 30), i) for i in range(40)]
    p, i = spark.createDataFrame(pts, "k int, t double, pid int"), spark.createDataFrame(iv, "k int, s double, e double, sid int")
    got = {(x["pid"], x["sid"]) for x in relational.interval_join(p, i, ["k"], "t", "s", "e", 7.0).collect()}
    assert got == {(a[2], b[3]) for a in pts for b in iv if a[0] == b[0] and b[1] <= a[1] < b[2]}
    marks = [(k, float(t), n) for k in range(4) for n, t in enumerate(sorted(r.sample(range(60), 9)))]
    near = {(x["k"], x["t"]): x["n"] for x in relational.nearest(p, spark.createDataFrame(marks, "k int, t double, n bigint"), "k", "t", "n").collect()}
    for k, t, _ in pts:
        assert near[k, t] == min(((abs(m[1] - t), m[2]) for m in marks if m[0] == k))[1]


def test_asof_only_between_adjacent_good_samples(spark):
    s = spark.createDataFrame([(1, 0.0, 10.0, True), (1, 1.0, 20.0, True), (1, 2.0, 30.0, False), (1, 3.0, 40.0, True)], "k int, t double, v double, ok boolean")
    g = spark.createDataFrame([(1, t) for t in (-1.0, 0.0, 0.5, 1.5, 2.0, 2.5, 3.0, 4.0)], "k int, t double")
    got = {r["t"]: r["v"] for r in relational.asof_interpolate(g, s, "k", "t", "v", "ok").collect()}
    assert got == {-1.0: None, 0.0: 10.0, 0.5: 15.0, 1.5: None, 2.0: None, 2.5: None, 3.0: 40.0, 4.0: None}


def test_matching():
    import pandas as pd

    m = relational.best_assignment(pd.DataFrame([(1, 1), (1, 2), (2, 1), (3, 2), (3, 3)], columns=["a", "b"]))
    assert len(m) == 3 and len({a for a, _ in m}) == len({b for _, b in m}) == 3


def test_require_unique_fails(spark):
    with pytest.raises(Exception, match="repeated key"):
        relational.require_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"]).collect()


def test_eligibility_rules(spark):
    df = spark.createDataFrame([(1, "5", "x"), (2, "oops", "y"), (3, None, None), (4, "9", "x")], "id int, n string, s string")
    ids = lambda rules: [r["id"] for r in df.where(relational.eligibility(rules)).orderBy("id").collect()]
    assert ids({"min": {"n": 5}}) == [1, 4] and ids({"equals": {"s": "y"}}) == [2] and ids({"any": [{"max": {"n": 5}}, {"in": {"s": ["y"]}}]}) == [1, 2]


def test_sequences(spark):
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate([1, 1, 0, 1, 0, 0, 1, 1, 1])], "k int, n bigint, f int")
    runs = sorted((r["first"], r["last"]) for r in sequences.true_runs(df, ["k"], "n", F.col("f") == 1).collect())
    assert runs == [(0, 1), (3, 3), (6, 8)]
    iv = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 3.0), (1, 3.0, 4.0), (1, 10.0, 11.0)], "k int, s double, e double")
    assert sorted((r["start"], r["end"], r["parts"]) for r in sequences.merge_intervals(iv, ["k"], "s", "e").collect()) == [(0.0, 3.0, 2), (3.0, 4.0, 1), (10.0, 11.0, 1)]
    one = spark.createDataFrame([([0.0, 0.4, 0.6, 0.9, 5.0],)], "t array<double>")
    assert one.select(sequences.anchor_clusters(F.col("t"), 0.5)).first()[0] == [0.0, 0.6, 5.0]
    assert one.select(sequences.clean_boundaries(F.array(*[F.lit(float(x)) for x in (-1, 0.5, 2, 2.4, 7, 9.7, 40)]), 10)).first()[0] == [0.0, 2.0, 7.0, 10.0]
    w = spark.createDataFrame([(0, 9)], "f bigint, l bigint").select(sequences.window_starts(F.col("f"), F.col("l"), 4, 3)).first()[0]
    assert w == [0, 3, 6]


def test_caps_are_nested_and_respected(spark):
    r = random.Random(9)
    rows = [(0, f"g{i}", f"s{r.randint(0, 3)}", f"{r.random():.6f}") for i in range(200)] + [(0, "g0", "s1", "x"), (0, "g1", "s2", "y")]
    got = sequences.coupled_caps(spark.createDataFrame(rows, "fold int, group_id string, source_group string, order string"), ["fold"], [5, 20]).collect()
    for cap in (5, 20):
        use = {x["group_id"] for x in got if x["cap"] <= cap}
        n = {}
        for _, g, s, _ in {x[:3] + ("",) for x in rows if x[1] in use}:
            n[s] = n.get(s, 0) + 1
        assert max(n.values()) <= cap + 1


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(60, 3))
    x[::3, 1] = np.nan
    y = rng.integers(0, 2, 60)
    w = rng.uniform(0.5, 2, 60)
    df = spark.createDataFrame([(*[None if np.isnan(v) else float(v) for v in r], int(t), float(u)) for r, t, u in zip(x, y, w)], "a double, b double, c double, label int, w double")
    prep = models.prepare(df, ["a", "b", "c"], "w")
    got = models.ridge(prep)
    miss = np.isnan(x).astype(float)
    z = np.hstack([np.where(np.isnan(x), np.nanmedian(x, 0), x), miss])
    mean = (w[:, None] * z).sum(0) / w.sum()
    sd = np.sqrt((w[:, None] * (z - mean) ** 2).sum(0) / w.sum())
    sd[sd < 1e-8] = 1
    a = np.hstack([np.ones((60, 1)), (z - mean) / sd])
    beta = np.linalg.solve(a.T @ (w[:, None] * a) + 10 * np.diag([0, *[1] * 6]), a.T @ (w * y))
    assert got.intercept == pytest.approx(beta[0]) and got.coefficients == pytest.approx(beta[1:], abs=1e-9)
    raw = [r[0] for r in df.select(models.raw_score(got)).collect()]
    assert raw == pytest.approx((a @ beta).tolist(), abs=1e-9)
    r, tol = models.normal_equation_residual(prep, got)
    assert r <= tol


def test_platt_lowers_loss(spark):
    r = random.Random(3)
    rows = [((s := r.uniform(-1, 2)), int(r.random() < 1 / (1 + np.exp(-4 * (s - 0.5)))), 1.0) for _ in range(500)]
    a, b, c, d = models.platt(spark.createDataFrame(rows, "score double, label int, w double"), "score", "w")
    assert 2.0 < a / d < 6.0 and -50 < b < 50


def test_bootstrap_multiplicity_one_is_the_estimate(spark):
    df = spark.createDataFrame([("a", "g1", 1.0), ("a", "g2", 3.0), ("a", "g2", 5.0)], "s string, g string, v double")
    draws = bootstrap.multiplicities(df, "g", 50)
    again = bootstrap.multiplicities(df.repartition(3), "g", 50)
    assert {r["g"]: r["draws"] for r in draws.collect()} == {r["g"]: r["draws"] for r in again.collect()}
    one = df.select("g").distinct().withColumn("draws", F.array(F.lit(1)))
    assert bootstrap.replicate_sums(df, one, "g", ["s"], {"v": "v"}).first()["v"] == 9.0


def test_drawn_sums_are_those_of_joined_draws(spark):
    rows = [(None if i % 41 == 0 else i % 2_300, None if i % 7 == 0 else f"s{i % (3 if i % 2 else 150)}", i % 5 - 2, None if i % 3 == 0 or i % 7 == 0 else 10**12 + i) for i in range(2_500)]
    df = spark.createDataFrame(rows, "id bigint, s string, v int, w bigint")
    for by in (["s"], []):
        want = bootstrap.replicate_sums(df, bootstrap.multiplicities(df, "id", 20), "id", by, {"a": "v", "b": "w"})
        got = bootstrap.drawn_sums(df, "id", by, {"a": "v", "b": "w"}, 20)
        assert got.dtypes == want.dtypes and set(got.collect()) == set(want.collect()) and got.count() == want.count() > 0
    assert bootstrap.drawn_sums(df.where("id < 0"), "id", ["s"], {"a": "v"}, 20).count() == 0
    with pytest.raises(ValueError):
        bootstrap.drawn_sums(df.withColumn("v", F.col("v") / 2), "id", [], {"a": "v"}, 20)


def test_power_set():
    assert relational.power_set(["S", "D", "R"]) == ["S", "D", "R", "S+D", "S+R", "D+R", "S+D+R"]


def test_closures_are_dealt_whole_with_every_source_in_every_part(spark):
    r = random.Random(4)
    rows = [(f"r{i:05d}", f"s{i % 4}", 1 + int(r.paretovariate(1.2)) % 400) for i in range(4000)] + [(f"r{i:05d}", "rare", 2) for i in range(0, 4000, 800)] + [("solo", "single", 5), ("none", None, 3), ("none", None, 4)]
    shares = [("train", 0.6), ("calibration", 0.2), ("test", 0.2)]
    c = spark.createDataFrame(rows, "root string, source string, n int")
    got = {x["root"]: x["part"] for x in schedule.partition_closures(c, shares).collect()}
    assert set(got) == {x[0] for x in rows} and got == {x["root"]: x["part"] for x in schedule.partition_closures(c.repartition(5), shares).collect()}
    for s in ("s0", "s1", "s2", "s3", "rare"):
        own = [x for x in rows if x[1] == s]
        count, mass = ({p: sum(w(x) for x in own if got[x[0]] == p) / sum(map(w, own)) for p, _ in shares} for w in (lambda x: 1, lambda x: x[2]))
        assert min(count.values()) > 0
        if s != "rare":
            assert all(abs(count[p] - w) < 0.02 and abs(mass[p] - w) < 0.05 for p, w in shares)
    assert schedule.partition_closures(c.limit(0), shares).collect() == []


def test_exact_medians(spark):
    r = random.Random(8)
    for n in (0, 1, 2, 7, 4001, 4000):
        rows = [(r.gauss(0, 1), float(r.randrange(3)), None if r.random() < 0.5 else r.random(), float("nan")) for _ in range(n)]
        got = models.exact_medians(spark.createDataFrame(rows, "a double, b double, c double, d double"), ["a", "b", "c", "d"])
        want = [float(np.median([x[i] for x in rows if x[i] is not None and x[i] == x[i]] or [0])) for i in range(4)]
        assert np.allclose(got, want, rtol=1e-12, atol=1e-12)


def test_targets_are_filled_to_one_level(spark):
    from cadenza.operators import sequences

    r = random.Random(3)
    for count in (0, 5, 40, 100, 10_000):
        have = {i: r.choice([0, 1, 2, 5, 9, 30]) for i in range(17)}
        df = spark.createDataFrame([(i, h, f"{r.getrandbits(128):032x}") for i, h in have.items()], "k int, have int, o string")
        order = [x["k"] for x in df.orderBy("o", "k").collect()]
        want, left = dict.fromkeys(have, 0), min(count, sum(have.values()))
        while left:
            for k in order:
                if left and want[k] < have[k]:
                    want[k] += 1
                    left -= 1
        assert {x["k"]: x["target"] for x in sequences.proportional_targets(df, "k", "have", count, "o").collect()} == want
    assert sequences.proportional_targets(df.limit(0), "k", "have", 5, "o").collect() == []


def test_containment_at_any_place(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdé漢") for _ in range(r.randint(2, 9)))
    texts = [(i, " ".join(word() for _ in range(r.randint(1, 40)))) for i in range(60)] + [(900, None), (901, "short")]
    queries = [(i, t[r.randint(0, 20) :][: r.randint(20, 60)]) for i, t in texts[:30]] + [(50, texts[40][1])]
    d, q = spark.createDataFrame(texts, "id bigint, t string"), spark.createDataFrame(queries, "item bigint, query string")
    got = {(x["id"], x["item"], x["exact"]) for x in relational.containing(d, q, "id", "t").collect()}
    assert got == {(i, j, t == s) for i, t in texts if t for j, s in queries if len(s) >= 32 and s in t}
