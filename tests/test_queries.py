"""Every query of the core against its SQL at the smallest scale, and the contract of the entry module."""

import math
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry
from cadenza.queries import modules

DATA = Path("/root/testdata/sf0.001")
CORE = {k: f for m in modules() for k, f in m.queries().items()}
SQL = {k: s for m in modules() for k, s in m.oracle_sql().items()}
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def normal(df: pd.DataFrame) -> pd.DataFrame:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "-"
        return str(v) if isinstance(v, (bool, str)) or not hasattr(v, "__float__") else f"{float(v) + 0.0:.6g}"

    df = df[sorted(df.columns)].map(cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got, want = CORE[name](spark, str(DATA)).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(normal(got), normal(want))


def finite(rows):
    return all(not isinstance(v, float) or math.isfinite(v) for r in rows for v in r)


def one_to_one(rows, key, *sides):
    return all(len({(r[key], r[s]) for r in rows}) == len(rows) for s in sides)


#: What has to hold of the rows of queries without SQL, besides being there and finite.
HOLDS = {
    "jn_16_overlap_assignment": lambda r: one_to_one(r, "user_id", "a", "b"), "jn_17_quota_matching": lambda r: one_to_one(r, "user_id", "a", "b"),
    "bst_07_cluster_statistics": lambda r: all(x["mean_low"] <= x["mean"] <= x["mean_high"] and x["median_low"] <= x["median"] <= x["median_high"] for x in r), "p1_lists": lambda r: all(x["value"] is not None for x in r), "p5_changes": lambda r: all(x["measures"] for x in r), "fn_01_normal_text": lambda r: all(x["digest"] is None or len(x["digest"]) == 64 for x in r),
    "fn_10_content_digest": lambda r: all(len(x["digest"]) == 64 for x in r), "sig_07_bicoherence_grid": lambda r: all(x["b2"] is None or -1e-9 <= x["b2"] <= 1 + 1e-9 for x in r), "sig_22_frame_descriptors": lambda r: all(len(x["cepstra"]) == 12 for x in r), "sup_25_lag_estimation": lambda r: all(abs(x["value"]) <= 1 + 1e-6 for x in r if x["name"] == "peak"),
    "str_01_running_decode": lambda r: all(x["captured"] == min(max(x["frames"] - 100, 0), 100) for x in r), "win_18_find_peaks": lambda r: all(b - a >= 3 for x in r for a, b in zip(x["peaks"], x["peaks"][1:])),
}


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_query_without_sql_gives_sound_rows(spark, name):
    rows = CORE[name](spark, str(DATA)).collect()
    assert rows and finite(rows) and HOLDS.get(name, bool)(rows)


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(CORE) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
