import random

from cadenza.llm.components import random_mate_components
from cadenza.llm.splits import assign_splits, normal_key, numeric_key, tied_sets
from pyspark.sql import functions as F


def groups(pairs):
    out = {}
    for v, r in pairs:
        out.setdefault(r, set()).add(v)
    return sorted(map(sorted, out.values()))


def union_find(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        p[find(a)] = find(b)
    return groups((x, find(x)) for x in list(p))


def test_contraction_matches_union_find(spark):
    r = random.Random(7)
    e = [(r.randint(0, 120), r.randint(0, 120)) for _ in range(90)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(200)]
    df = spark.createDataFrame([*e, *e[:20], (None, 1), (9, 9)], "src bigint, dst bigint")
    assert groups((x["vertex"], x["root"]) for x in random_mate_components(df).collect()) == union_find([x for x in e if x[0] != x[1]])


def test_no_edges(spark):
    assert random_mate_components(spark.createDataFrame([(1, 1), (None, 2)], "src bigint, dst bigint")).count() == 0
    assert random_mate_components(spark.createDataFrame([], "src string, dst string")).count() == 0


SCHEMA = "id string, g string, c string, set_id string, root string, key string"


def sets(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)
    return tied_sets(df, "id", {"g": normal_key(F.col("g")), "c": numeric_key(F.col("c"))})


def test_sets_of_spellings_missing_keys_and_repeated_rows(spark):
    rows = [("a", "X_Set:1", "component_007"), ("b", "x-set/ 1 ", None), ("c", "n/a", "Component 7"), ("d", "unknown", "-"), ("e", None, "none"), ("f", "y:2", "component-000"), ("f", "y:2", "component-000"), ("g", "", "component_0"), (None, "y:2", "7"), ("h", "x_set:2", "70")]
    got = {r["id"]: (r["set_id"], r["set_size"]) for r in sets(spark, rows).collect()}
    assert got == {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "d": ("d", 1), "e": ("e", 1), "f": ("f", 2), "g": ("f", 2), "h": ("h", 1)}


def test_one_group_of_a_third_and_shares(spark):
    rows = [(f"hot{i:04d}", "hot", None) for i in range(1000)] + [(f"r{i:04d}", f"g:{i // 2}", str(i // 3)) for i in range(2000)]
    s = assign_splits(sets(spark, rows), [("train", 0.8), ("validation", 0.1), ("test", 0.1)]).collect()
    assert len(s) == 3000 and len({(r["set_id"], r["new_split"]) for r in s}) == len({r["set_id"] for r in s})
    n = {k: sum(r["new_split"] == k for r in s) / 3000 for k in ("train", "validation", "test")}
    assert abs(n["train"] - 0.8) < 0.02 and abs(n["validation"] - 0.1) < 0.02


def test_empty_sets(spark):
    s = sets(spark, [])
    assert s.count() == 0 and assign_splits(s, [("train", 0.8), ("test", 0.2)]).count() == 0
