"""Queries that cover their whole table, against plain Python on small tables."""

import hashlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from cadenza.queries import joins, models, signals, supplement


def digest(nodes):
    sums = [0] * 4
    for node in nodes:
        h = hashlib.sha256(node.encode()).hexdigest()
        sums = [s + int(h[16 * i : 16 * i + 16], 16) for i, s in enumerate(sums)]
    return hashlib.sha256("|".join(["sum", str(len(nodes)), *map(str, sums)]).encode()).hexdigest()


def test_sup_18_reports_every_component(spark, tmp_path):
    rows = [(f"i{i:03}", ("hub", f"t{i:03}")) for i in range(60)] + [("j0", ("solo", "one")), ("j1", ("solo", "two")), ("j2", (None, "last"))]
    spark.createDataFrame(rows[::-1], "id string, provenance struct<artist:string,title:string>").write.parquet(f"{tmp_path}/drive_sources.parquet")
    got = {r["group_id"]: r["keys"] for r in supplement.sup_18_group_identity(spark, str(tmp_path)).collect()}
    assert got == {digest(x): len(x) for x in (["a:hub", *[f"t:t{i:03}" for i in range(60)]], ["a:solo", "t:one", "t:two"], ["t:last"])}


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("events")
    kinds = ("click", "view", "error", "purchase")
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), i % 3, kinds[i * 7 % 4], (i * 37 % 50) / 4, f'{{"k": {i * 13 % 100}}}') for i in range(90)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    out = [{"id": i, "user": u, "value": v, "k": i * 13 % 100, "label": int(e in ("error", "purchase"))} for i, _, u, e, v, _ in rows]
    for x in out:
        x["score"] = (x["id"] * 37 + x["k"] * 101 + x["label"] * 250) % 1000 / 1000
    return str(d), out


def pairs(rows, ok):
    return {(a["id"], b["id"]) for a in rows for b in rows if a["user"] == b["user"] and ok(a, b)}


def most(edges):
    owner = {}

    def grow(a, seen):
        for b in edges[a] - seen:
            seen.add(b)
            if b not in owner or grow(owner[b], seen):
                owner[b] = a
                return True
        return False

    return sum(grow(a, set()) for a in edges)


def test_joins_use_all_rows(spark, events):
    d, rows = events
    got = lambda q: [tuple(r) for r in q(spark, d).collect()]
    inside = lambda p, s: s["k"] > 0 and s["value"] * 10 <= p["value"] * 10 + p["id"] % 7 < s["value"] * 10 + s["k"]
    assert Counter(got(joins.jn_14_interval_join)) == Counter(pairs(rows, inside))
    gap = lambda a, b: a["id"] < b["id"] and b["k"] - a["k"] >= 20 and b["score"] - a["score"] >= 0.1
    met = defaultdict(list)
    for a, b in pairs(rows, gap):
        met[a].append(b)
    assert Counter(got(joins.jn_20_pairs_within_source)) == Counter((a, len(b), min(b)) for a, b in met.items())
    grid = {u: sorted({r["k"] * 1.5 for r in rows if r["user"] == u}) for u in range(3)}
    want = {(u, t, min(range(len(grid[u])), key=lambda i: (abs(grid[u][i] - t), i))) for u, t in {(r["user"], r["value"]) for r in rows}}
    assert Counter(got(joins.jn_19_nearest_snap)) == Counter(want)


def test_matchings_use_all_rows(spark, events):
    d, rows = events
    start, end = lambda r: r["id"] % 97 / 10, lambda r: r["id"] % 97 / 10 + r["k"] / 20
    overlap = lambda a, b: a["id"] % 2 == 0 and b["id"] % 2 == 1 and abs(start(a) - start(b)) <= 1.0 and start(a) < end(b) and start(b) < end(a)
    alike = lambda a, b: a["label"] == 0 and b["label"] == 1 and a["k"] // 10 == b["k"] // 10
    for query, ok in ((joins.jn_16_overlap_assignment, overlap), (joins.jn_17_quota_matching, alike)):
        allowed, edges = pairs(rows, ok), defaultdict(set)
        for a, b in allowed:
            edges[a].add(b)
        got = [(r["a"], r["b"]) for r in query(spark, d).collect()]
        assert set(got) <= allowed and len({a for a, _ in got}) == len({b for _, b in got}) == len(got) == most(edges)


def test_recordings_are_bounded_and_the_delayed_channel_is_as_long(spark, tmp_path):
    e = spark.range(1_200).selectExpr("id as vec_id", "0 as label", "transform(sequence(0, 63), i -> cast(id * 64 + i as float)) as embedding")
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    x = signals.recordings(spark, str(tmp_path)).selectExpr("recording", "size(x) as n", "size(y) as m", "y[0] as first", "element_at(y, size(y) - 64) as last").orderBy("recording").collect()
    assert [tuple(r) for r in x] == [("0-0", 32_000, 32_000, 64.0, 31_999.0), ("0-1", 32_000, 32_000, 32_064.0, 63_999.0), ("0-2", 12_800, 12_800, 64_064.0, 76_799.0)]


def test_drawn_rows_are_as_in_sql_and_not_broadcast(spark, tmp_path):
    """The planner sees the bytes of the ids only; a table of their draws, 500 times as long, went through the driver."""
    duckdb = pytest.importorskip("duckdb")
    kinds = ("click", "view", "error", "purchase")
    rows = [(None if i % 50 == 0 else i // 2, datetime(2024, 1, 1), 9 + i % 2, kinds[i * 7 % 4], float(i % 9), None if i % 11 == 0 else f'{{"k": {i * 13 % 100}}}') for i in range(400)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = models.bst_06_stratified_rows(spark, str(tmp_path))
    want = con.execute(models.oracle_sql()["bst_06_stratified_rows"]).df().iloc[0].to_dict()
    assert got.first().asDict() == pytest.approx(want)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and "draws" not in plan
