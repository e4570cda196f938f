import itertools
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import metrics as m

SCHEMA = "id bigint, label int, source_group string, group_id string, score double"


def cohort(spark, n=300, seed=2):
    r = random.Random(seed)
    rows = [(i, (y := r.randint(0, 1)), f"{'ha'[y]}{r.randint(0, 2)}", f"g{r.randint(0, 20)}", round(r.random(), 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_weights_balance_classes_sources_and_groups(spark):
    rows, df = cohort(spark)
    w = m.hierarchical_weights(df).collect()
    assert sum(r["weight"] for r in w) == pytest.approx(len(rows))
    mass = {}
    for r in w:
        mass[r["label"]] = mass.get(r["label"], 0) + r["weight"]
    assert mass[0] == pytest.approx(mass[1])


def test_auc_by_brute_force_with_ties(spark):
    rows, df = cohort(spark)
    pos, neg = [r[4] for r in rows if r[1]], [r[4] for r in rows if not r[1]]
    want = sum((p > n) + (p == n) / 2 for p, n in itertools.product(pos, neg)) / len(pos) / len(neg)
    assert m.auc(df, []).first()["auc"] == pytest.approx(want)
    assert m.auc(df.where("label = 1"), []).first()["auc"] is None


def test_ties_give_the_known_values(spark):
    df = spark.createDataFrame([(i, y, "s", "g", 0.5) for i, y in enumerate([0, 1, 0, 1])], SCHEMA)
    p = m.probability_metrics(df, []).first()
    assert p["brier"] == pytest.approx(0.25) and p["log_loss"] == pytest.approx(0.6931471805599453)
    assert m.expected_calibration_error(m.calibration_bins(df, []), []).first()["ece"] == pytest.approx(0)
    assert m.auc(df, []).first()["auc"] == 0.5
    assert m.confusion(df, []).first()["balanced_accuracy"] == 0.5


def test_pairs_equal_filtered_metrics(spark):
    _, df = cohort(spark)
    for r in m.source_pairs(df).collect():
        own = df.where(F.col("source_group").isin(r["human_source"], r["ai_source"]))
        assert r["auc"] == pytest.approx(m.auc(own, []).first()["auc"])
        assert r["balanced_accuracy"] == pytest.approx(m.confusion(own, []).first()["balanced_accuracy"])


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5]
    got = {r["p"]: r["adjusted"] for r in m.benjamini_hochberg(spark.createDataFrame([(x,) for x in p], "p double"), "p").collect()}
    s = sorted(p)
    want = [min(1, min(s[j] * len(p) / (j + 1) for j in range(i, len(p)))) for i in range(len(p))]
    assert [got[x] for x in s] == pytest.approx(want)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert m.source_pairs(df).count() == 0 and m.auc(df, ["source_group"]).count() == 0
