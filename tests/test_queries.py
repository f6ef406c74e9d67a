from pathlib import Path

import duckdb
import pytest

from loomset.plans.program import Program
from loomset.plans.queries import ORACLES, QUERIES
from loomset.sources.tables import SCHEMA, loaders

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")
@pytest.mark.parametrize("name", [n for n in QUERIES if n != "r1_recursion"])
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = QUERIES[name](spark, FOLDER).toPandas(), c.sql(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, got[cols].values.tolist())) == sorted(map(str, want[cols].values.tolist()))


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")
@pytest.mark.parametrize(
    ("name", "pushed"),
    [
        ("p1_prefix_filter", ["GreaterThanOrEqual(c_acctbal"]),
        ("s13_predicate", ["LessThan(p_size,10)"]),
        ("f8_dates", ["GreaterThanOrEqual(o_orderdate", "LessThan(o_orderdate"]),
        ("j3_semijoin", ["GreaterThanOrEqual(c_acctbal"]),
    ],
)
def test_filters_reach_the_scan(spark, name, pushed):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().explainString(mode)
    filters = " ".join(x for x in plan.split("\n") if x.startswith("PushedFilters"))
    assert all(p in filters for p in pushed), filters


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")
@pytest.mark.parametrize("name", ["j3_has_orders", "j4_antijoin", "p5_not_related", "p8_or_related", "c2_if_related"])
def test_filtered_rows_are_not_joined_by_null_keys(spark, name):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().explainString(mode).split("\n")
    # Orders are read by the filter's scan only, and no join's key is a choice that is null for what the filter drops.
    assert all("GreaterThanOrEqual(o_totalprice" in x for x in plan if x.startswith("PushedFilters") and "o_" in x)
    assert any("o_totalprice" in x for x in plan) and not any("CASE" in x for x in plan if x.startswith(("Left keys", "Right keys", "Arguments: hashpartitioning")))


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")
@pytest.mark.parametrize(
    ("body", "where"),
    [
        ("(Order where .total > 100000) . customer . nation . name", "o_totalprice > 100000"),
        ("((Order where .total > 100000) . customer where .acctbal > 0) . nation . name", "o_totalprice > 100000 AND c_acctbal > 0"),
        ("((Order where .total > 100000) . customer except (id where .acctbal > 0)) . nation . name", "o_totalprice > 100000 AND NOT c_acctbal > 0"),
    ],
)
def test_paths_of_filtered_rows(spark, body, where):
    t = lambda x: f"'{FOLDER}/{x}.parquet'"
    got = Program(spark, SCHEMA + f"let x : Order -> Text = {body}", loaders(spark, FOLDER)).view("x").collect()
    want = duckdb.connect().sql(f"SELECT o_orderkey, n_name FROM {t('orders')} JOIN {t('customer')} ON o_custkey = c_custkey JOIN {t('nation')} ON c_nationkey = n_nationkey WHERE {where}").fetchall()
    assert want and sorted((r["l"], r["r"], r["w"]) for r in got) == sorted((*x, 1) for x in want)
