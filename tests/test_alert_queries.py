"""The registered alert queries on rows of the test's own."""

import datetime as dt

import duckdb

from joblattice.plans.oracles import ORACLES
from joblattice.plans.queries import QUERIES


def test_alerts_new_covers_every_listing(spark, tmp_path):
    """Four listings that suit one user; the one toggled before is left out, no other."""
    day = dt.datetime(2024, 1, 2)
    tables = {
        # "red ring", remote, of one field and band; field and band are made from the key
        "orders": ([(k, 1, "O", 1.0, day, "1-URGENT") for k in (105, 106, 107, 108)],
                   "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "part": ([(0, "red ring", "Brand#1", "STANDARD")], "p_partkey bigint, p_name string, p_brand string, p_type string"),
        "nation": ([(0, "NATION_0")], "n_nationkey int, n_name string"),
        # user 459 has the skills red and ring, works remote and has 9 years
        "customer": ([(459, 0, "AUTOMOBILE", 1.0)], "c_custkey bigint, c_nationkey int, c_mktsegment string, c_acctbal double"),
        "events": ([(107, day, 459, "view", 1.0, '{"k": 1}')],
                   "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    found = QUERIES["alerts_new"](spark, str(tmp_path)).collect()
    expected = [(459, 105, 100), (459, 106, 100), (459, 108, 90)]
    assert sorted((r.user_id, r.id_num, r.score) for r in found) == expected
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(con.sql(ORACLES["alerts_new"]).fetchall()) == expected
