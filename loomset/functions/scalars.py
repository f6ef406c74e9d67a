"""Scalar operations: 64-bit arithmetic that wraps, division that is total, exact comparison of Int and Money."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

INT, MONEY, TEXT, DATE, UNIT = ("Int",), ("Money",), ("Text",), ("Date",), ("Unit",)


@contextmanager
def wrapping(spark: SparkSession):
    """Arithmetic analysed inside wraps instead of failing."""
    was = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", was)


def literal(kind: str, value) -> tuple[Column, tuple]:
    """Column and type of a literal."""
    if kind in ("int", "money"):
        return F.lit(value).cast("long"), INT if kind == "int" else MONEY
    if kind == "date":
        return F.lit(value), DATE
    return F.lit(value), TEXT if kind == "text" else ("atoms", (value,))


def same_scale(a: Column, ta: tuple, b: Column, tb: tuple) -> tuple[Column, Column]:
    """Both sides in cents, beyond 64 bits, if just one is Money."""
    if ta == tb or not {ta, tb} <= {INT, MONEY}:
        return a, b
    wide = lambda c, t: c.cast("decimal(38,0)") * (100 if t == INT else 1)
    return wide(a, ta), wide(b, tb)


def compare(op: str, a: Column, ta: tuple, b: Column, tb: tuple) -> Column:
    a, b = same_scale(a, ta, b, tb)
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def arithmetic(op: str, a: Column, ta: tuple, b: Column, tb: tuple) -> tuple[Column, tuple]:
    if op == "++":
        if not ta == tb == TEXT:
            raise TypeError("++ joins Text")
        return F.concat(a, b), TEXT
    if not {ta, tb} <= {INT, MONEY}:
        raise TypeError(f"{op} needs numbers")
    if op in "/%":
        if not ta == tb == INT:
            raise TypeError(f"{op} needs Int")
        out = F.call_function("div", a, b) if op == "/" else a % b
        return F.when(b == 0, F.when(a.isNotNull(), F.lit(0).cast("long"))).otherwise(out).cast("long"), INT
    if op == "*":
        if ta == tb == MONEY:
            raise TypeError("Money can't be multiplied by Money")
        return a * b, MONEY if MONEY in (ta, tb) else INT
    if ta != tb:
        a, b = (a * 100 if ta == INT else a), (b * 100 if tb == INT else b)
    return (a + b if op == "+" else a - b), MONEY if MONEY in (ta, tb) else INT


def reaches(op: str, stored: Column, t: tuple, kind: str, value) -> tuple[Column, ...]:
    """Conditions on the stored column (an amount, a time) that a field's comparison with a literal implies."""
    if t == MONEY and kind in ("int", "money"):
        cents = value * 100 if kind == "int" else value
        if abs(cents) >= 1 << 48:
            return ()
        least, most = stored >= (cents - 1) / 100, stored <= (cents + 1) / 100
    elif t == DATE and kind == "date":
        day = literal(kind, value)[0]
        least, most = stored >= day, stored < F.date_add(day, 1)
    else:
        return ()
    return {">": (least,), ">=": (least,), "<": (most,), "<=": (most,), "=": (least, most)}.get(op, ())
