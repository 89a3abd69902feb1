"""M1/M2/M5 parity: the Spark forest (numpy trees, Arrow scoring) equals the
SQL forest of the oracle -- both grow trees from the same hash draws."""

import duckdb

import __spark_entry__ as E
from tests.conftest import SF001


def _duck(sql):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return [dict(zip(cols, r)) for r in cur.fetchall()]


def test_forest_scores_and_flags_match_sql(spark):
    q, o = E.queries(), E.oracle_sql()
    got = {r["row_id"]: (r["anomaly_score"], r["detector_flag"])
           for r in q["iforest_flags"](spark, SF001).collect()}
    want = {r["row_id"]: (r["anomaly_score"], r["detector_flag"]) for r in _duck(o["iforest_flags"])}
    assert set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 2e-6 and got[k][1] == want[k][1] for k in got)
    assert sum(f for _, f in got.values()) == 4
