"""Relations as DataFrames: columns l, r and w, the weight of a pair (0 never occurs in a result)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def consolidate(df: DataFrame) -> DataFrame:
    return df.groupBy("l", "r").agg(F.sum("w").alias("w")).where("w <> 0")


def compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs joined where a's right is b's left; weights multiply and add up."""
    y = b.select(F.col("l").alias("k"), F.col("r").alias("r2"), F.col("w").alias("w2"))
    return consolidate(a.join(y, F.col("r") == F.col("k")).select("l", F.col("r2").alias("r"), (F.col("w") * F.col("w2")).alias("w")))


def keys(b: DataFrame) -> DataFrame:
    return b.select(F.col("l").alias("k")).distinct()


def semijoin(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(F.col("l").alias("k")), F.col("r") == F.col("k"), "left_semi")


def antijoin(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(F.col("l").alias("k")), F.col("r") == F.col("k"), "left_anti")


def inverse(a: DataFrame) -> DataFrame:
    return a.select(F.col("r").alias("l"), F.col("l").alias("r"), "w")


def cokeyed(a: DataFrame, b: DataFrame, value, keep=None) -> DataFrame:
    """value(ra, rb) of pairs with one left; weights multiply. keep(ra, rb) drops pairs first."""
    y = b.select(F.col("l").alias("k"), F.col("r").alias("r2"), F.col("w").alias("w2"))
    j = a.join(y, F.col("l") == F.col("k"))
    if keep is not None:
        j = j.where(keep(F.col("r"), F.col("r2")))
    return consolidate(j.select("l", value(F.col("l"), F.col("r"), F.col("r2")).alias("r"), (F.col("w") * F.col("w2")).alias("w")))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return consolidate(a.unionByName(b))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return consolidate(a.unionByName(b.withColumn("w", -F.col("w"))))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The lesser weight of each pair, absent ones weighing 0; one aggregation instead of an outer join."""
    both = a.select("l", "r", F.col("w").alias("wa"), F.lit(0).cast("long").alias("wb")).unionByName(b.select("l", "r", F.lit(0).cast("long").alias("wa"), F.col("w").alias("wb")))
    return both.groupBy("l", "r").agg(F.least(F.sum("wa"), F.sum("wb")).alias("w")).where("w <> 0")


def distinct(a: DataFrame) -> DataFrame:
    return consolidate(a).where("w > 0").withColumn("w", F.lit(1).cast("long"))


def mapped(a: DataFrame, value: Column) -> DataFrame:
    return consolidate(a.select("l", value.alias("r"), "w"))


def fold(a: DataFrame, name: str, scale: int = 1) -> DataFrame:
    """One row a left: the weighted sum, count, mean (truncated, in cents), least or greatest right."""
    total, n = F.sum(F.col("r") * F.col("w") * scale) if name in ("sum", "avg") else None, F.sum("w")
    if name == "avg":
        out = a.groupBy("l").agg(total.alias("s"), n.alias("n")).where("n <> 0").select("l", F.expr("s div n").alias("r"))
    else:
        up = F.when(F.col("w") > 0, F.col("r"))
        out = a.groupBy("l").agg({"sum": total, "count": n, "min": F.min(up), "max": F.max(up)}[name].alias("r")).where("r is not null")
    return out.select("l", "r", F.lit(1).cast("long").alias("w"))


def totals(folded: DataFrame, domain: DataFrame) -> DataFrame:
    """0 for the keys of domain(l) that have no group; groups outside it stay."""
    d = domain.select(F.col("l").alias("d")).distinct()
    j = folded.join(d, F.col("l") == F.col("d"), "full_outer")
    return j.select(F.coalesce("l", "d").alias("l"), F.coalesce("r", F.lit(0).cast("long")).alias("r"), F.lit(1).cast("long").alias("w"))
