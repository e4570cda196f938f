from cadenza.llm import mixing
from pyspark.sql import functions as F

T = "source string, target_share double, max_repeats int"


def run(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "doc bigint, source string, size bigint")
    out, report = mixing.mix(d, "doc", F.col("source"), F.col("size"), spark.createDataFrame(targets, T), **kw)
    return out.collect(), {r["source"]: r for r in report.collect()}


def test_shares_caps_and_spellings(spark):
    docs = [(i, ["big", " Big ", "BIG "][i % 3], 10) for i in range(3000)] + [(10_000 + i, "small", 10) for i in range(200)] + [(20_000 + i, "tiny", 10) for i in range(10)] + [(1, None, 10), (2, "other", 10)]
    out, rep = run(spark, docs, [("big", 0.6, 1), ("Small", 0.3, 4), ("tiny", 0.1, 2), ("gone", 0.0, 3)], budget=20_000)
    used = {}
    for r in out:
        used[r["id"], r["copy"]] = used.get((r["id"], r["copy"]), 0) + 1
    assert max(used.values()) == 1 and max(c for _, c in used) <= 3
    assert sum(r["tokens"] for r in out) <= 20_000
    assert rep["tiny"]["drawn_tokens"] == 200 and rep["gone"]["drawn_tokens"] == 0
    assert abs(rep["big"]["drawn_tokens"] / rep["Small"]["drawn_tokens"] - 2.0) < 0.05
    assert abs(sum(r["actual_share"] for r in rep.values()) - 1) < 0.01


def test_targets_that_cannot_be_reached(spark):
    _, rep = run(spark, [(i, "a", 5) for i in range(90)] + [(100 + i, "b", 5) for i in range(10)], [("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.1, 5)])
    assert {k for k, r in rep.items() if r["cannot_reach"]} == {"b", "c"}


def test_no_documents_null_sizes_and_repeated_rows(spark):
    out, rep = run(spark, [], [("a", 1.0, 2)])
    assert out == [] and rep["a"]["available_tokens"] == 0 and rep["a"]["cannot_reach"] is False
    out, rep = run(spark, [(1, "a", None), (2, "a", 7), (2, "a", 7)], [("a", 1.0, 1)])
    assert rep["a"]["available_tokens"] == 14 and sum(r["tokens"] for r in out) == 14


def test_order_doesnt_depend_on_partitions(spark):
    d = spark.createDataFrame([(i, "ab"[i % 2], 1 + i % 9) for i in range(500)], "doc bigint, source string, size bigint")
    t = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 2)], T)
    one = {(r["id"], r["copy"], r["position"]) for r in mixing.mix(d.coalesce(1), "doc", F.col("source"), F.col("size"), t)[0].collect()}
    two = {(r["id"], r["copy"], r["position"]) for r in mixing.mix(d.repartition(7), "doc", F.col("source"), F.col("size"), t)[0].collect()}
    assert one == two
