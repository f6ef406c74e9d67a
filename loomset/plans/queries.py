"""Queries in the language over the tables, each with SQL that gives the same rows (k, v, w)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import SCHEMA, loaders
from ..streaming.app import App
from .program import Program

C = "CAST(round({} * 100) AS BIGINT)"
TOTAL, BAL, PRICE, PPRICE, VALUE = (C.format(x) for x in ("o_totalprice", "c_acctbal", "l_extendedprice", "p_retailprice", "value"))

#: name: (declarations, the view, SQL for k, v and w)
VIEWS: dict[str, tuple[str, str, str]] = {
    "s1_identity": ("let x : Nation = Nation", "x", "SELECT n_nationkey::BIGINT k, n_nationkey::BIGINT v, 1::BIGINT w FROM nation"),
    "s2_path": ("let x : Customer -> Text = .nation.region.name", "x", "SELECT c_custkey::BIGINT k, r_name v, 1::BIGINT w FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "s3_view": ("let bal : Customer -> Money = .acctbal\nlet x : Customer -> Money = bal + bal", "x", f"SELECT c_custkey::BIGINT k, 2 * {BAL} v, 1::BIGINT w FROM customer"),
    "s6_constant": ("let x : Nation -> Int = 5", "x", "SELECT n_nationkey::BIGINT k, 5::BIGINT v, 1::BIGINT w FROM nation"),
    "s7_atom": ("let x : Nation -> {@north} = @north", "x", "SELECT n_nationkey::BIGINT k, 'north' v, 1::BIGINT w FROM nation"),
    "s8_unit": ("let x : Nation -> Unit = unit", "x", "SELECT n_nationkey::BIGINT k, 0::BIGINT v, 1::BIGINT w FROM nation"),
    "s11_state": ("state least : Money = 5000\nlet x : Customer = id where .acctbal > least", "x", f"SELECT c_custkey::BIGINT k, c_custkey::BIGINT v, 1::BIGINT w FROM customer WHERE {BAL} > 500000"),
    "s13_predicate": ("let x : Part = id where .size < 10", "x", "SELECT p_partkey::BIGINT k, p_partkey::BIGINT v, 1::BIGINT w FROM part WHERE p_size < 10"),
    "p1_prefix_filter": ("let x : Customer -> Money = .acctbal where > 9000", "x", f"SELECT c_custkey::BIGINT k, {BAL} v, 1::BIGINT w FROM customer WHERE {BAL} > 900000"),
    "p2_prefix_in": ("let x : Order -> OrderStatus = .status where in (F | P)", "x", "SELECT o_orderkey::BIGINT k, o_orderstatus v, 1::BIGINT w FROM orders WHERE o_orderstatus IN ('F', 'P')"),
    "p3_in": ("let x : Order = .status in (O | P)", "x", "SELECT o_orderkey::BIGINT k, o_orderkey::BIGINT v, 1::BIGINT w FROM orders WHERE o_orderstatus IN ('O', 'P')"),
    "p4_comparison": ("let x : Customer = .acctbal >= .nation.region.name.least\nlet least = min(Customer.acctbal by .nation.region.name)", "x", f"WITH c AS (SELECT c_custkey, {BAL} b, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT c_custkey::BIGINT k, c_custkey::BIGINT v, 1::BIGINT w FROM c JOIN (SELECT r_name, min(b) m FROM c GROUP BY 1) USING (r_name) WHERE b >= m"),
    "p5_not": ("let x : Order = Order where not .status = F", "x", "SELECT o_orderkey::BIGINT k, o_orderkey::BIGINT v, 1::BIGINT w FROM orders WHERE o_orderstatus <> 'F'"),
    "p7_and": ("let x : Part = Part where .size > 20 & .price > 950", "x", f"SELECT p_partkey::BIGINT k, p_partkey::BIGINT v, 1::BIGINT w FROM part WHERE p_size > 20 AND {PPRICE} > 95000"),
    "p8_or": ("let x : Part = Part where (.size > 45 | .size < 3)", "x", "SELECT p_partkey::BIGINT k, p_partkey::BIGINT v, 1::BIGINT w FROM part WHERE p_size > 45 OR p_size < 3"),
    "p5_not_related": ("let has = ~((Order where .total > 400000) . customer)\nlet x : Customer = Customer where not has", "x", f"SELECT c_custkey::BIGINT k, c_custkey::BIGINT v, 1::BIGINT w FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {TOTAL} > 40000000)"),
    "p8_or_related": ("let has = ~((Order where .total > 400000) . customer)\nlet x : Customer = Customer where (has | .acctbal > 8000)", "x", f"SELECT c_custkey::BIGINT k, c_custkey::BIGINT v, 1::BIGINT w FROM customer WHERE {BAL} > 800000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE {TOTAL} > 40000000)"),
    "p9_sides": ("let f : Part -> Text * Int = (.brand , .size)\nlet x : Part -> Int = snd f", "x", "SELECT p_partkey::BIGINT k, p_size::BIGINT v, 1::BIGINT w FROM part"),
    "j1_compose": ("let sup : Nation -> Supplier = ~(Supplier . nation)\nlet x : Region -> Supplier = ~(Nation . region) . sup", "x", "SELECT n_regionkey::BIGINT k, s_suppkey::BIGINT v, 1::BIGINT w FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "j1_weights": ("let x : Region -> Text = ~(Nation . region) . ~(Customer . nation) . segment", "x", "SELECT n_regionkey::BIGINT k, c_mktsegment v, count(*)::BIGINT w FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"),
    "j3_semijoin": ("let rich : Customer = Customer where .acctbal > 9500\nlet x : Order -> Customer = .customer[rich]", "x", f"SELECT o_orderkey::BIGINT k, o_custkey::BIGINT v, 1::BIGINT w FROM orders JOIN customer ON o_custkey = c_custkey WHERE {BAL} > 950000"),
    "j3_has_orders": ("let has = ~((Order where .total > 400000) . customer)\nlet x : Customer = Customer where has", "x", f"SELECT c_custkey::BIGINT k, c_custkey::BIGINT v, 1::BIGINT w FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {TOTAL} > 40000000)"),
    "j4_antijoin": ("let has = ~((Order where .total > 400000) . customer)\nlet x : Customer = Customer except has", "x", f"SELECT c_custkey::BIGINT k, c_custkey::BIGINT v, 1::BIGINT w FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {TOTAL} > 40000000)"),
    "j6_arithmetic": ("let x : Part -> Money = .price * .size", "x", f"SELECT p_partkey::BIGINT k, {PPRICE} * p_size v, 1::BIGINT w FROM part"),
    "j7_inverse": ("let x : Region -> Nation = ~(Nation . region)", "x", "SELECT n_regionkey::BIGINT k, n_nationkey::BIGINT v, 1::BIGINT w FROM nation"),
    "j8_by": ("let x : Text -> Int = Part.size by .brand", "x", "SELECT p_brand k, p_size::BIGINT v, count(*)::BIGINT w FROM part GROUP BY 1, 2"),
    "j10_correlated": ("let mean : Customer -> Money = avg(Order.total by .customer)\nlet x : Order = id where .total > .customer.mean", "x", f"WITH m AS (SELECT o_custkey, CAST(sum({TOTAL}) AS BIGINT) // count(*) m FROM orders GROUP BY 1) SELECT o_orderkey::BIGINT k, o_orderkey::BIGINT v, 1::BIGINT w FROM orders JOIN m USING (o_custkey) WHERE {TOTAL} > m"),
    "j11_many_to_many": ("let x : Part -> Nation = distinct (~(Line . part) . .supplier.nation)", "x", "SELECT DISTINCT l_partkey::BIGINT k, s_nationkey::BIGINT v, 1::BIGINT w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"),
    "a1_sum": ("let rev : Line -> Money = .price\nlet x : Customer -> Money = sum(rev by .order.customer)", "x", f"SELECT c_custkey::BIGINT k, coalesce(s, 0)::BIGINT v, 1::BIGINT w FROM customer LEFT JOIN (SELECT o_custkey, sum({PRICE}) s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey"),
    "a2_count": ("let x : Customer -> Int = count(Order by .customer)", "x", "SELECT c_custkey::BIGINT k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::BIGINT v, 1::BIGINT w FROM customer"),
    "a3_avg": ("let x : Text -> Money = avg(Part.size by .brand)", "x", "SELECT p_brand k, CAST(sum(p_size) * 100 AS BIGINT) // count(*) v, 1::BIGINT w FROM part GROUP BY 1"),
    "a4_min": ("let x : Customer -> Money = min(Order.total by .customer)", "x", f"SELECT o_custkey::BIGINT k, min({TOTAL}) v, 1::BIGINT w FROM orders GROUP BY 1"),
    "a5_max": ("let x : Text -> Money = max(Customer.acctbal by .segment)", "x", f"SELECT c_mktsegment k, max({BAL}) v, 1::BIGINT w FROM customer GROUP BY 1"),
    "a6_distinct_count": ("let x : Supplier -> Int = count(distinct (Line.part by .supplier))", "x", "SELECT s_suppkey::BIGINT k, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey)::BIGINT v, 1::BIGINT w FROM supplier"),
    "a7_grand_total": ("let x : Unit -> Money = sum(Order.total by unit)", "x", f"SELECT 0::BIGINT k, sum({TOTAL})::BIGINT v, 1::BIGINT w FROM orders"),
    "a8_enum_totals": ("let x : OrderStatus -> Int = count((Order where .total > 400000) by .status)", "x", f"SELECT s k, (SELECT count(*) FROM orders WHERE o_orderstatus = s AND {TOTAL} > 40000000)::BIGINT v, 1::BIGINT w FROM (VALUES ('F'), ('O'), ('P')) t(s)"),
    "a9_having": ("let n : Customer -> Int = count(Order by .customer)\nlet x : Customer -> Int = n where > 14", "x", "SELECT o_custkey::BIGINT k, count(*)::BIGINT v, 1::BIGINT w FROM orders GROUP BY 1 HAVING count(*) > 14"),
    "u1_union": ("let x : Nation -> Text = ~(Customer . nation) . segment | ~(Supplier . nation) . name", "x", "SELECT c_nationkey::BIGINT k, c_mktsegment v, count(*)::BIGINT w FROM customer GROUP BY 1, 2 UNION ALL SELECT s_nationkey, s_name, count(*) FROM supplier GROUP BY 1, 2"),
    "u2_intersect": ("let a = (((Customer where .acctbal < 5000) . segment) by .nation)\nlet b = (((Customer where .acctbal > 3000) . segment) by .nation)\nlet x = a & b", "x", f"SELECT c_nationkey::BIGINT k, c_mktsegment v, least(count(*) FILTER ({BAL} < 500000), count(*) FILTER ({BAL} > 300000))::BIGINT w FROM customer GROUP BY 1, 2 HAVING w > 0"),
    "u3_distinct": ("let x : Nation -> Text = distinct (~(Customer . nation) . segment)", "x", "SELECT DISTINCT c_nationkey::BIGINT k, c_mktsegment v, 1::BIGINT w FROM customer"),
    "c1_match": ('let x : Order -> Text = match .status { F => "final", O => .priority, _ => "pending" }', "x", "SELECT o_orderkey::BIGINT k, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN o_orderpriority ELSE 'pending' END v, 1::BIGINT w FROM orders"),
    "c2_if": ("let x : Part -> Int = if .size > 25 then .size - 25 else 0 - .size", "x", "SELECT p_partkey::BIGINT k, CASE WHEN p_size > 25 THEN p_size - 25 ELSE -p_size END::BIGINT v, 1::BIGINT w FROM part"),
    "c2_if_related": ('let has = ~((Order where .total > 400000) . customer)\nlet x : Customer -> Text = if has then "large" else .segment', "x", f"SELECT c_custkey::BIGINT k, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE {TOTAL} > 40000000) THEN 'large' ELSE c_mktsegment END v, 1::BIGINT w FROM customer"),
    "f4_div": ("let x : Part -> Int = .size / (.size % 5)", "x", "SELECT p_partkey::BIGINT k, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size // (p_size % 5) END::BIGINT v, 1::BIGINT w FROM part"),
    "f6_concat": ('let x : Part -> Text = .brand ++ "/" ++ .kind', "x", "SELECT p_partkey::BIGINT k, p_brand || '/' || p_type v, 1::BIGINT w FROM part"),
    "f8_dates": ("let x : Order = Order where .placed >= 1995-01-01 & .placed < 1996-01-01", "x", "SELECT o_orderkey::BIGINT k, o_orderkey::BIGINT v, 1::BIGINT w FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01'"),
}

#: Nations are linked if a line's supplier and its order's customer are of them; the closure is taken over links of large lines.
RECURSION = """
let big : Line = Line where .qty >= 50 & .price > 95000
let hop : Nation -> Nation = distinct ((big . .supplier.nation) by .order.customer.nation)
let recursive reach : Nation -> Nation = hop | hop . reach
"""
RECURSION_SQL = f"""
WITH RECURSIVE h AS (SELECT DISTINCT c_nationkey::BIGINT a, s_nationkey::BIGINT b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 50 AND {PRICE} > 9500000),
r AS (SELECT a, b FROM h UNION SELECT h.a, r.b FROM h JOIN r ON h.b = r.a)
SELECT a k, b v, 1::BIGINT w FROM r
"""

EVENTS = """
event Forgive(least: Money)
event Cancel(s: OrderStatus)
event Open(n: Nation, name: Text)
event Give(names: Int -> Text)
on Forgive(least) => update Customer where .acctbal < least { acctbal: 0 }
on Cancel(s) => delete Order where .status = s
on Open(n, name) { new Customer { name: name, nation: n, acctbal: 1, segment: "NEW" } }
on Give(names) => new Region from names as (i, n) { name: n }
let by_nation : Nation -> Money = sum(Customer.acctbal by .nation)
let left : Customer -> Int = count(Order by .customer)
let segments : Text -> Int = count(Customer by .segment)
let regions : Region -> Text = .name
"""

#: name: (event and arguments, the view, SQL)
DISPATCHED: dict[str, tuple[tuple, str, str]] = {
    "e10_update": (("Forgive", 0), "by_nation", f"SELECT n_nationkey::BIGINT k, coalesce((SELECT sum(greatest({BAL}, 0)) FROM customer WHERE c_nationkey = n_nationkey), 0)::BIGINT v, 1::BIGINT w FROM nation"),
    "e12_delete": (("Cancel", "F"), "left", "SELECT c_custkey::BIGINT k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F')::BIGINT v, 1::BIGINT w FROM customer"),
    "e7_new": (("Open", 3, "someone"), "segments", "SELECT c_mktsegment k, count(*)::BIGINT v, 1::BIGINT w FROM customer GROUP BY 1 UNION ALL SELECT 'NEW', 1, 1"),
    "e9_new_from": (("Give", [[2, "b", 1], [1, "a", 1]]), "regions", "SELECT r_regionkey::BIGINT k, r_name v, 1::BIGINT w FROM region UNION ALL SELECT (SELECT max(r_regionkey) FROM region) + 1, 'a', 1 UNION ALL SELECT (SELECT max(r_regionkey) FROM region) + 2, 'b', 1"),
}


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("l").alias("k"), F.col("r").alias("v"), "w")


def _viewed(body: str, view: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: _named(Program(spark, SCHEMA + body, loaders(spark, folder)).view(view))


def _dispatched(event: tuple, view: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        app = App(spark, SCHEMA + EVENTS, loaders(spark, folder))
        app.dispatch(*event)
        return _named(app.view(view))

    return run


def step_delta(spark: SparkSession, folder: str) -> DataFrame:
    """The change of a view when every order of 1995 goes: a micro-batch of signed rows."""
    app = App(spark, SCHEMA + EVENTS, loaders(spark, folder))
    gone = app.program.frame("Order").where("year(placed) = 1995").withColumn("w", F.lit(-1).cast("long"))
    return _named(app.step("Order", gone, ["left"])["left"])


STEP_SQL = """
WITH c AS (SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) a, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) <> 1995) b FROM customer)
SELECT c_custkey::BIGINT k, a::BIGINT v, -1::BIGINT w FROM c WHERE a <> b UNION ALL SELECT c_custkey, b, 1 FROM c WHERE a <> b
"""


def fork(spark: SparkSession, folder: str) -> DataFrame:
    df = Program(spark, SCHEMA + "let x : Order -> Customer * OrderStatus = (.customer , .status)", loaders(spark, folder)).view("x")
    return df.select(F.col("l").alias("k"), F.col("r.fst").alias("v"), F.col("r.snd").alias("v2"), "w")


def levels(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of a nation in order of their balance: a nested level."""
    body = "let rows : Customer = Customer where .acctbal > 9000\nlet parent : Customer -> Nation = .nation\nlet place : Customer -> Money = .acctbal\nlet title : Customer -> Text = .name"
    got = App(spark, SCHEMA + body, loaders(spark, folder)).levels("rows", ["title"], order="place", parent="parent", desc=True)
    return got.select("id", "title", F.col("parent"), F.col("place").cast("long").alias("place"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["a1_sum"](spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{n: _viewed(b, v) for n, (b, v, _) in VIEWS.items()},
    "r1_recursion": _viewed(RECURSION, "reach"),
    **{n: _dispatched(e, v) for n, (e, v, _) in DISPATCHED.items()},
    "i1_step": step_delta,
    "j5_fork": fork,
    "v2_levels": levels,
}
ORACLES: dict[str, str] = {
    **{n: q for n, (_, _, q) in VIEWS.items()},
    "r1_recursion": RECURSION_SQL,
    **{n: q for n, (_, _, q) in DISPATCHED.items()},
    "i1_step": STEP_SQL,
    "j5_fork": "SELECT o_orderkey::BIGINT k, o_custkey::BIGINT v, o_orderstatus v2, 1::BIGINT w FROM orders",
    "v2_levels": f"SELECT c_custkey::BIGINT id, c_name title, c_nationkey::BIGINT parent, row_number() OVER (PARTITION BY c_nationkey ORDER BY {BAL} DESC, c_custkey) place FROM customer WHERE {BAL} > 900000",
}
