"""Every registered query that has SQL, against DuckDB."""

import duckdb
import pytest

from sluice.queries import ORACLES, QUERIES, TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = duck.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["cache_claims_a", "cache_claims_b"])
def test_cache_claims_among_more_users(spark, name):
    """Events of the users that the claim's list is filled with."""
    con, large = duckdb.connect(), SF.replace("sf0.001", "sf0.1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{large}/events.parquet'")
    assert con.execute("SELECT count(DISTINCT user_id) FROM events WHERE user_id BETWEEN 1000 AND 1039").fetchone() == (40,)
    assert [tuple(r) for r in QUERIES[name](spark, large).collect()] == con.execute(ORACLES[name]).fetchall()


def test_approximate_distinct(spark, duck):
    got = {r.event_type: r.x for r in QUERIES["agg_uniq_approx"](spark, SF).collect()}
    for kind, n in duck.execute("SELECT event_type, count(DISTINCT user_id) FROM events GROUP BY 1").fetchall():
        assert abs(got[kind] - n) <= 0.1 * n
