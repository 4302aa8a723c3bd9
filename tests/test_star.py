"""Registered queries on small star-schema tables of their own."""

from collections import Counter

import pytest

import __spark_entry__ as entry

TABLES = {
    "region": ("r_regionkey int, r_name string", [(0, "A")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "N0", 0), (1, "N1", 0)]),
    "customer": ("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(k, f"c{k}", k % 2, 1.0, "BUILDING") for k in range(4)]),
    "supplier": ("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", [(k, f"s{k}", k, 1.0) for k in range(2)]),
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(k, f"p{k}", "Brand#1", "SMALL", 2, 1.0) for k in range(8)]),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string",
        [(0, 0, "F", 1.0, "1-URGENT"), (1, 1, "F", 1.0, "4-LOW"), (2, 2, "O", 1.0, "5-NONE"), (3, 3, "F", 1.0, "5-NONE")],
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string",
        [(o, 1, s, s, 46.0, "R", "F") for o in range(4) for s in range(2)],
    ),
}


@pytest.fixture(scope="session")
def star(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("star"))
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_blast_radius_asks_every_node_and_every_reason(spark, star):
    got = {(r.target, r.why): r.n for r in entry.queries()["blast_radius"](spark, star).collect()}
    assert {why for _, why in got} == {"dependent", "descendant", "event", "flow", "rule"}
    assert got["r0", "descendant"] == 8 and got["r0/n0", "descendant"] == 3
    # customer 1 emits to both suppliers, on which 2 and 3 listen
    assert got["r0/n1/c1", "event"] == 2 and got["r0/n0/s0", "event"] == 3 and got["r0/n0/s0", "dependent"] == 1
    assert Counter(t for t, why in got if why == "flow") == {"r0/n0": 1, "r0/n1": 1} and got["r0/n0", "flow"] == 2
