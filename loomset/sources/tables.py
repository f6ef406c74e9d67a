"""Parquet tables as entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """
type OrderStatus = F | O | P
type Flag = A | N | R
entity Region { name: Text }
entity Nation { name: Text, region: Region }
entity Customer { name: Text, nation: Nation, acctbal: Money, segment: Text }
entity Supplier { name: Text, nation: Nation, acctbal: Money }
entity Part { name: Text, brand: Text, kind: Text, size: Int, price: Money }
entity Order { customer: Customer, status: OrderStatus, total: Money, placed: Date, priority: Text }
entity Line { order: Order, part: Part, supplier: Supplier, qty: Int, price: Money, discount: Money, flag: Flag, shipped: Date }
entity Visit { user: Int, kind: Text, value: Money, day: Date }
"""


#: What names a stored column end in that is kept beside the field made of it, so that filters reach the scan.
STORED = "__stored"


def _cents(c: str) -> Column:
    return F.round(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) * 100).cast("long")


#: Stored columns by entity and field.
_STORED = {
    "Customer": {"acctbal": "c_acctbal"}, "Supplier": {"acctbal": "s_acctbal"}, "Part": {"price": "p_retailprice"}, "Order": {"total": "o_totalprice", "placed": "o_orderdate"},
    "Line": {"price": "l_extendedprice", "discount": "l_discount", "shipped": "l_shipdate"}, "Visit": {"value": "value", "day": "ts"},
}


def _columns() -> dict[str, tuple[str, dict[str, Column]]]:
    c, day = F.col, lambda x: F.to_date(x)
    return {
        "Region": ("region", {"id": c("r_regionkey"), "name": c("r_name")}),
        "Nation": ("nation", {"id": c("n_nationkey"), "name": c("n_name"), "region": c("n_regionkey")}),
        "Customer": ("customer", {"id": c("c_custkey"), "name": c("c_name"), "nation": c("c_nationkey"), "acctbal": _cents("c_acctbal"), "segment": c("c_mktsegment")}),
        "Supplier": ("supplier", {"id": c("s_suppkey"), "name": c("s_name"), "nation": c("s_nationkey"), "acctbal": _cents("s_acctbal")}),
        "Part": ("part", {"id": c("p_partkey"), "name": c("p_name"), "brand": c("p_brand"), "kind": c("p_type"), "size": c("p_size"), "price": _cents("p_retailprice")}),
        "Order": ("orders", {"id": c("o_orderkey"), "customer": c("o_custkey"), "status": c("o_orderstatus"), "total": _cents("o_totalprice"), "placed": day("o_orderdate"), "priority": c("o_orderpriority")}),
        "Line": ("lineitem", {"id": F.monotonically_increasing_id(), "order": c("l_orderkey"), "part": c("l_partkey"), "supplier": c("l_suppkey"), "qty": c("l_quantity").cast("long"), "price": _cents("l_extendedprice"), "discount": _cents("l_discount"), "flag": c("l_returnflag"), "shipped": day("l_shipdate")}),
        "Visit": ("events", {"id": c("event_id"), "user": c("user_id"), "kind": c("event_type"), "value": _cents("value"), "day": day("ts")}),
    }


def loaders(spark: SparkSession, folder: str) -> dict[str, Callable[[], DataFrame]]:
    def load(table: str, columns: dict[str, Column], stored: dict[str, str]) -> Callable[[], DataFrame]:
        return lambda: spark.read.parquet(f"{folder}/{table}.parquet").select(*[v.alias(k) for k, v in columns.items()], *[F.col(c).alias(f"{k}{STORED}") for k, c in stored.items()])

    return {e: load(t, c, _STORED.get(e, {})) for e, (t, c) in _columns().items()}
