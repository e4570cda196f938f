import random

import numpy as np
import pytest
from cadenza.llm import dyadic as d

SCHEMA = "g string, load_id int, m map<string,double>, c int, sketch string"


def test_codes_keep_order_and_bound_values():
    v = np.sort(np.r_[-1e300, -5.5, -1e-8, -0.0, 0.0, 1e-300, 0.1, 3.0, 1e9, np.random.default_rng(1).normal(size=1000)])
    c = d.encode(v)
    assert (np.diff(c.astype(int)) >= 0).all()
    big = np.abs(v) > 1e-200
    assert (np.abs(d.decode(c) - v)[big] <= np.abs(v)[big] * 2.0**-12).all()


def sketch(v):
    c, n = np.unique(d.encode(np.asarray(v, float)), return_counts=True)
    return d.Sketch().add(c, n)


def rank_gap(v, q, p):
    s = np.sort(v)
    return max(0.0, np.searchsorted(s, q - abs(q) * 2**-12, "left") / len(s) - p, p - np.searchsorted(s, q + abs(q) * 2**-12, "right") / len(s))


@pytest.mark.parametrize("make", [lambda r: r.normal(size=60_000), lambda r: np.exp(3 * r.normal(size=60_000)), lambda r: r.integers(0, 7, 60_000) / 10, lambda r: np.r_[r.normal(size=30_000), np.full(30_000, 4.25)], lambda r: r.standard_cauchy(60_000), lambda r: np.full(50_000, -2.5)])
def test_ranks_within_the_stated_bound(make):
    v = make(np.random.default_rng(4))
    s = sketch(v)
    ps = (0.01, 0.1, 0.5, 0.9, 0.99)
    for p, q in zip(ps, s.quantiles(ps)):
        assert rank_gap(v, q, p) <= s.rank_error() + 1 / len(v)
    assert s.rank_error() < 0.2  # a single value is the worst case


def test_parts_add_up_and_deletions_undo():
    r = np.random.default_rng(5)
    a, b = r.normal(size=40_000), r.normal(3, 1, size=30_000)
    whole, parts = sketch(np.r_[a, b]), sketch(a).merge(sketch(b))
    whole._spread()
    parts._spread()
    assert (whole.table == parts.table).all() and (whole.exact == parts.exact).all()
    back = parts.merge(sketch(b), -1)
    ref = sketch(a)
    ref._spread()
    back._spread()
    assert (back.table == ref.table).all() and back.n() == 40_000
    for s in (sketch(a), sketch(a[:100]), d.Sketch()):
        again = d.Sketch.from_bytes(s.to_bytes())
        assert again.n() == s.n() and again.to_bytes() == d.Sketch.from_bytes(again.to_bytes()).to_bytes()


def table(spark, rows):
    return spark.createDataFrame([(*x, 1, "clash") for x in rows], SCHEMA)


def test_distributed_equals_one_sketch_and_loads_join(spark):
    r = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 5}", i % 4, {"a": r.gauss(0, 1), "b": r.choice([None, float("nan"), float("inf"), 1.0]), "zz": 1.0}) for i in range(4000)] + [(None, 1, None), ("g1", None, {})]
    packed = d.pack_values(table(spark, rows).repartition(5), ["a", "b"], "m", ["g", "load_id"])
    parts = d.partial_sketches(packed, ["g"], "load_id")
    keys = ["grouping", "group_value", "c"]
    direct = {(x["group_value"], x["feature"], x["p"]): x for x in d.percentiles(d.merge_sketches(parts.drop("load_id"), keys), ["a", "b"], (0.25, 0.5), keys).collect()}
    twice = d.percentiles(d.merge_sketches(d.merge_sketches(parts, per_key=1).drop("load_id"), keys), ["a", "b"], (0.25, 0.5), keys).collect()
    assert len(twice) == len(direct)
    for x in twice:
        assert (x["n"], x["estimate"]) == (direct[x["group_value"], x["feature"], x["p"]]["n"], direct[x["group_value"], x["feature"], x["p"]]["estimate"])
    hot = [m["a"] for g, _, m in rows if g == "hot"]
    assert direct["hot", "a", 0.5]["n"] == len(hot) and rank_gap(hot, direct["hot", "a", 0.5]["estimate"], 0.5) <= direct["hot", "a", 0.5]["rank_error"] + 0.001
    assert direct["hot", "b", 0.5]["n"] == sum(m["b"] == 1.0 for g, _, m in rows if g == "hot")


def test_empty(spark):
    keys = ["grouping", "group_value", "c"]
    p = d.partial_sketches(d.pack_values(table(spark, []), ["a"], "m", ["g", "load_id"]), ["g"], "load_id")
    assert d.percentiles(d.merge_sketches(p.drop("load_id"), keys), ["a"], (0.5,), keys).count() == 0
