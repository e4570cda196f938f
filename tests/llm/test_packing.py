import random
from collections import defaultdict

import numpy as np
import pytest
from cadenza.llm import packing
from cadenza.llm.tokens import n_tokens
from pyspark.sql import functions as F


def check(rows, capacity=1024, lengths=(128, 256, 512, 1024)):
    bins, items = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["container"]].append(r)
        items[r["id"]].append(r)
    for b in bins.values():
        used = sum(r["piece_tokens"] for r in b)
        n = {r["container_length"] for r in b}
        assert len(n) == 1 and used <= (n := n.pop()) and n in lengths and not any(used <= x < n for x in lengths)
    for i in items.values():
        t = i[0]["tokens"]
        assert sum(r["piece_tokens"] for r in i) == t * (len(i) // i[0]["pieces"] or 1) or len(i) % i[0]["pieces"] == 0
        if t <= capacity:
            assert i[0]["pieces"] == 1
    return bins


def test_every_item_is_whole_and_fits(spark):
    r = random.Random(1)
    data = [(i, r.choice([0, 1, 5, 300, 700, 1024, 1025, 5000, r.randint(1, 1500)])) for i in range(400)] + [(900, None), (901, 2048)]
    df = spark.createDataFrame([(i, s, "x", 1) for i, s in data], "doc bigint, size bigint, g string, tokens int")
    rows = packing.pack(df, "doc", F.col("size"), rows_per_group=150).collect()
    bins = check(rows)
    for i, s in data:
        own = [x for x in rows if x["id"] == i]
        assert sum(x["piece_tokens"] for x in own) == (s or 0) and len(own) == max(1, -(-(s or 0) // 1024)) == own[0]["pieces"]
        assert sorted(x["piece"] for x in own) == list(range(len(own)))
    space = sum(b[0]["container_length"] for b in bins.values())
    assert sum(s or 0 for _, s in data) / space > 0.95


def test_repeated_ids_are_separate_items_and_empty_table(spark):
    df = spark.createDataFrame([(1, 600)] * 50, "doc bigint, size bigint")
    rows = packing.pack(df, "doc", F.col("size"), rows_per_group=10).collect()
    assert len(rows) == 50 and len({r["container"] for r in rows}) == 50
    assert packing.pack(df.limit(0), "doc", F.col("size")).count() == 0


def test_repeated_ids_above_the_capacity_have_containers_of_their_own(spark):
    """Two rows of one id of 2,048 tokens fill four containers, and a row repeated without an id three of 1,024 for each row of 3,000."""
    df = spark.createDataFrame([(7, 2048), (7, 2048), (None, 3000), (None, 3000)], "doc bigint, size bigint")
    for n in (1, 100):
        rows = packing.pack(df, "doc", F.col("size"), rows_per_group=n).collect()
        bins = check(rows)
        assert len([b for b, r in bins.items() if any(x["id"] == 7 for x in r)]) == 4 and sum(r["piece_tokens"] for r in rows) == 10_096
        assert all(sum(x["piece_tokens"] for x in b) <= 1024 for b in bins.values())


def test_a_row_repeated_most_often_is_spread_over_groups_and_groups_repeat(spark):
    df = spark.createDataFrame([(None, 100)] * 3000 + [(i, 100 + i % 900) for i in range(3000)], "doc bigint, size bigint")
    rows = packing.pack(df, "doc", F.col("size"), rows_per_group=1000).collect()
    check(rows)
    hot = [r for r in rows if r["id"] is None]
    assert len(hot) == 3000 and {r["copy"] for r in hot} == set(range(3000)) and len({r["container"].split("-")[1] for r in hot}) == 6
    again = packing.pack(df.repartition(7), "doc", F.col("size"), rows_per_group=1000).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert packing.divided(packing.pack(df.unionAll(spark.createDataFrame([(-1, 1025)], df.schema)), "doc", F.col("size"))).collect() == [(-1,)]


def test_a_shorter_length_is_opened_where_nothing_to_come_fills_the_longer():
    """The odd 500 leaves 524 of 1,024, of which the 340s to come could fill 340 only; they fill 1,020 of 1,024 among themselves."""
    s = np.array([500] * 5 + [340] * 6)
    where, final = packing.best_fit(s, (512, 1024))
    assert sorted(final) == [512] + [1024] * 4 and (np.bincount(where, s) <= final).all()
    _, one = packing.best_fit(s, (1024,))
    assert one.sum() == 5 * 1024
    where, final = packing.best_fit(np.array([600, 424]), (512, 1024))
    assert list(final) == [1024] and list(where) == [0, 0]


def test_best_fit_is_near_the_lower_bound():
    r = np.random.default_rng(2)
    s = np.sort(r.integers(1, 700, 5000))[::-1]
    where, final = packing.best_fit(s, (256, 512, 1024))
    used = np.bincount(where, s)
    assert (used <= final).all() and s.sum() / final.sum() > 0.985


@pytest.mark.parametrize("text,n", [("", 0), (None, 0), ("  \n", 0), ("a b_1", 2), ("don't", 3), ("Ünïcode 漢字!?", 3), ("a—b...c", 5), ("x y z\x1cw", 4), ("3.14", 3), ("١٢٣", 1)])
def test_tokens(spark, text, n):
    import re

    assert spark.createDataFrame([(text,)], "t string").select(n_tokens(F.col("t"))).first()[0] == n == len(re.findall(r"\w+|[^\w\s]+", text or ""))


def test_very_long_text(spark):
    df = spark.range(1).select(F.lit(7).cast("bigint").alias("doc"), F.expr("repeat('ab, ', 200000)").alias("t"))
    rows = packing.pack(df, "doc", n_tokens(F.col("t"))).collect()
    assert len(rows) == -(-400_000 // 1024) and sum(r["piece_tokens"] for r in rows) == 400_000
