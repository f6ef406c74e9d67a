"""Checks programs and lowers their relations to DataFrames.

Relations that are functions of an entity's row are kept as columns over one wide frame (Fn): all
co-keyed operators on them become one projection, a path over a reference becomes one left join that
further paths share, and absence is NULL. Everything else is a frame of weighted pairs (Rel).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import DATE, INT, MONEY, TEXT, UNIT, arithmetic, compare, literal, reaches, wrapping
from ..operators import relations as R
from ..operators.cutting import cut
from ..sources.lexer import SyntaxProblem
from ..sources.parser import parse
from ..sources.tables import STORED

BOOL = ("atoms", ("False", "True"))
NON_MONOTONE = {"distinct", "anti", "fold", "not"}


class CheckProblem(TypeError):
    pass


class NotFused(Exception):
    """The expression is no column over the row at hand."""


def sql_type(t: tuple) -> T.DataType:
    if t[0] == "pair":
        return T.StructType([T.StructField("fst", sql_type(t[1])), T.StructField("snd", sql_type(t[2]))])
    return {"Text": T.StringType(), "atoms": T.StringType(), "Date": T.DateType()}.get(t[0], T.LongType())


@dataclass
class Entity:
    name: str
    fields: dict[str, tuple]
    key: list[str] | None
    rows: list[dict] = field(default_factory=list)
    frame: DataFrame | None = None
    #: The frame with stored columns beside the fields made of them, while it is as it was loaded.
    scan: DataFrame | None = None


class Base:
    """A wide frame: an entity's rows, and what left joins on references, views and states add."""

    def __init__(self, program: Program, entity: str):
        self.program, self.entity = program, entity
        self.joins: dict[tuple, tuple[DataFrame, Column | None, dict[str, str]]] = {}
        self.key = F.col("e_id")

    def fields(self, key: Column, entity: str) -> dict[str, str]:
        rows = self.program.scan(entity)
        if str(key) == str(self.key) and entity == self.entity:
            return {f: f"e_{f}" for f in rows.columns}
        return self._join(("entity", str(key), entity), lambda: rows, key, rows.columns, "id")

    def view(self, key: Column, name: str, rel: Rel) -> Column:
        return F.col(self._join(("view", str(key), name), lambda: rel.df, key, ["l", "r"], "l")["r"])

    def state(self, name: str) -> Column:
        return F.col(self._join(("state",), self.program.state_frame, None, list(self.program.states), None)[name])

    def _join(self, what: tuple, frame, key: Column | None, columns: list[str], on: str | None) -> dict[str, str]:
        if what not in self.joins:
            n = len(self.joins)
            names = {c: f"j{n}_{c}" for c in columns}
            self.joins[what] = (frame().select(*[F.col(c).alias(x) for c, x in names.items()]), None if on is None else key == F.col(names[on]), names)
        return self.joins[what][2]

    def frame(self) -> DataFrame:
        df = self.program.scan(self.entity)
        df = df.select(*[F.col(c).alias(f"e_{c}") for c in df.columns])
        for other, on, _ in self.joins.values():
            df = df.crossJoin(F.broadcast(other)) if on is None else df.join(other, on, "left")  # the state is one row
        return df


@dataclass
class Cursor:
    base: Base
    key: Column
    type: tuple


@dataclass
class Fn:
    base: Base
    col: Column
    left: tuple
    right: tuple
    #: Conditions, never NULL, under which col is `value`; col is NULL otherwise. A scan takes them as filters.
    only: tuple[Column, ...] = ()
    value: Column | None = None
    #: The stored column that a field is made of.
    stored: Column | None = None

    def open(self) -> Column:
        return self.col if self.value is None else self.value


def gated(base: Base, only: tuple[Column, ...], value: Column, left: tuple, right: tuple) -> Fn:
    return Fn(base, F.when(reduce(Column.__and__, only), value), left, right, only, value)


@dataclass
class Rel:
    df: DataFrame
    left: tuple
    right: tuple
    functional: bool = False
    #: Pairs may come more than once; a fold needs no more than that.
    loose: bool = False


class Program:
    def __init__(self, spark: SparkSession, source: str, frames: dict[str, DataFrame] | None = None):
        self.spark, self.types, self.entities = spark, {"Int": INT, "Money": MONEY, "Text": TEXT, "Date": DATE, "Unit": UNIT, "Bool": BOOL}, {}
        self.states: dict[str, tuple] = {}
        self.state_values: dict[str, object] = {}
        self.lets: dict[str, tuple] = {}
        self.groups: dict[str, list[str]] = {}
        self.events: dict[str, dict[str, tuple]] = {}
        self.handlers: dict[str, tuple[list[str], list]] = {}
        self.seeds: dict[str, tuple[str, int]] = {}
        self.warnings: list[str] = []
        self._views: dict[str, Rel] = {}
        self._rounds: dict[str, Rel] = {}
        #: Names that an event's handler adds: a value's column and type.
        self.params: dict[str, tuple[Column, tuple]] = {}
        self.statements = parse(source)
        self._declare()
        #: Frames, or functions that load them when they are first read.
        self.loaders = dict(frames or {})

    # declarations

    def _unlike(self) -> None:
        """Refuses names that are declared twice, and constructors of two types."""
        seen: set[tuple[str, str]] = set()
        for s in self.statements:
            space = {"entity": "type", "type": "type", "let": "relation", "recursive": "relation", "rel": "relation", "state": "relation", "event": "event", "on": "handler", "seed": "relation"}.get(s[0])
            if space is None or s[0] == "seed" and s[1] == "_":
                continue
            if (space, s[1]) in seen or space == "type" and s[1] in self.types:
                raise CheckProblem(f"`{s[1]}` is declared twice")
            seen.add((space, s[1]))
            for c in s[2] if s[0] == "type" else ():
                if ("constructor", c) in seen:
                    raise CheckProblem(f"`{c}` is a constructor of two types")
                seen.add(("constructor", c))

    def _declare(self) -> None:
        self._unlike()
        for s in self.statements:
            if s[0] == "entity":
                self.types[s[1]] = self.types[f"{s[1]}ID"] = ("entity", s[1])
            elif s[0] == "type":
                self.types[s[1]] = ("atoms", tuple(sorted(s[2])))
        for s in self.statements:
            if s[0] == "entity":
                self.entities[s[1]] = Entity(s[1], {f: self.resolve(t) for f, t in s[2].items()}, s[3])
                for k in s[3] or []:
                    if k not in self.entities[s[1]].fields:
                        raise CheckProblem(f"`{s[1]}` has no field `{k}`")
        group: list[str] = []
        for s in self.statements:
            if s[0] != "recursive":
                group = []
            if s[0] == "rel":
                self.entities[s[2]].fields[s[1]] = self.resolve(s[3])
                self.lets[s[1]] = ("dot", ("name", s[2]), ("hop", s[1])), (("entity", s[2]), self.resolve(s[3]))
            elif s[0] == "state":
                self.states[s[1]] = self.resolve(s[2])
                self.state_values[s[1]] = None if s[3] is None else self.seeds[s[3][1]][1] if s[3][0] == "atom" and s[3][1] in self.seeds else s[3][1] * (100 if (self.states[s[1]], s[3][0]) == (MONEY, "int") else 1)
            elif s[0] == "seed":
                e = self.entities.get(s[2])
                if e is None:
                    raise CheckProblem(f"unknown entity `{s[2]}`")
                row = {"id": len(e.rows), **{f: self._seed_value(e, f, v) for f, v in s[3].items()}}
                if e.key and any(all(r.get(k) == row.get(k) for k in e.key) for r in e.rows):
                    raise CheckProblem(f"two `{e.name}` rows have one key")
                e.rows.append(row)
                if s[1] != "_":
                    self.seeds[s[1]] = (e.name, row["id"])
            elif s[0] == "let":
                self.lets[s[1]] = s[3], None if s[2] is None else tuple(map(self.resolve, s[2]))
            elif s[0] == "recursive":
                self.lets[s[1]] = s[3], tuple(map(self.resolve, s[2]))
                group.append(s[1])
                self.groups[s[1]] = group
            elif s[0] == "event":
                self.events[s[1]] = {p: ("relation", self.resolve(t[1]), self.resolve(t[2])) if t[0] == "relation" else self.resolve(t) for p, t in s[2].items()}
            elif s[0] == "on":
                if s[1] not in self.events:
                    raise CheckProblem(f"unknown event `{s[1]}`")
                self.handlers[s[1]] = s[2], s[3]
        for n, g in self.groups.items():
            self._stratified(self.lets[n][0], set(g), False)

    def _stratified(self, node, names: set[str], under: bool) -> None:
        if not isinstance(node, (tuple, list)) or not node:
            return
        if node[0] == "name" and node[1] in names and under:
            raise CheckProblem(f"`{node[1]}` recurs under negation or a fold")
        for x in node[1:] if isinstance(node, tuple) else node:
            self._stratified(x, names, under or node[0] in NON_MONOTONE)

    def _seed_value(self, e: Entity, f: str, v):
        if f not in e.fields:
            raise CheckProblem(f"`{e.name}` has no field `{f}`")
        t = e.fields[f]
        if v[0] == "name" and v[1] in self.seeds:
            if t != ("entity", self.seeds[v[1]][0]):
                raise CheckProblem(f"`{v[1]}` is no `{t[1]}`")
            return self.seeds[v[1]][1]
        if v[0] in ("name", "atom"):
            if t[0] != "atoms" or v[1] not in t[1]:
                raise CheckProblem(f"{v[1]} is not of {t}")
            return v[1]
        if t == MONEY and v[0] == "int":
            return v[1] * 100
        if {"int": INT, "money": MONEY, "text": TEXT, "date": DATE}.get(v[0]) != t:
            raise CheckProblem(f"`{f}` of `{e.name}` is {t}")
        return v[1]

    def resolve(self, t) -> tuple:
        if t[0] == "ref":
            if t[1] not in self.types:
                raise CheckProblem(f"unknown type `{t[1]}`")
            return self.types[t[1]]
        return ("pair", self.resolve(t[1]), self.resolve(t[2])) if t[0] == "pair" else t

    # frames

    def bind(self, entity: str, df: DataFrame) -> None:
        """df: id and the entity's fields; a null is a field that has no row."""
        e = self.entities[entity]
        columns = [F.col("id").cast("long").alias("id"), *[F.col(f).cast(sql_type(t)).alias(f) for f, t in e.fields.items()]]
        e.frame, kept = df.select(*columns), [c for c in df.columns if c.endswith(STORED)]
        e.scan = df.select(*columns, *kept) if kept else None
        self._views.clear()

    def frame(self, entity: str) -> DataFrame:
        e = self.entities[entity]
        if e.frame is None and entity in self.loaders:
            got = self.loaders[entity]
            self.bind(entity, got() if callable(got) else got)
        if e.frame is None:
            schema = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(f, sql_type(t)) for f, t in e.fields.items()]])
            e.frame = self.spark.createDataFrame([tuple(r.get(c) for c in ("id", *e.fields)) for r in e.rows], schema)
        return e.frame

    def scan(self, entity: str) -> DataFrame:
        """The entity's frame, with stored columns where there are any."""
        frame, e = self.frame(entity), self.entities[entity]
        return frame if e.scan is None else e.scan

    def state_frame(self) -> DataFrame:
        schema = T.StructType([T.StructField(s, sql_type(t)) for s, t in self.states.items()])
        return self.spark.createDataFrame([tuple(self.state_values[s] for s in self.states)], schema)

    def point(self, value: Column, right: tuple, left: tuple = UNIT, key: Column | None = None) -> Rel:
        df = self.spark.range(1).select((F.lit(0).cast("long") if key is None else key).alias("l"), value.alias("r"), F.lit(1).cast("long").alias("w"))
        return Rel(df.where("r is not null"), left, right, True)

    def rel(self, x: Fn | Rel) -> Rel:
        if isinstance(x, Rel):
            return Rel(R.consolidate(x.df), x.left, x.right, x.functional) if x.loose else x
        df = x.base.frame()
        for c in x.only:
            df = df.where(c)
        df = df.select(x.base.key.alias("l"), x.open().alias("r")).where("l is not null and r is not null")
        return Rel(df.withColumn("w", F.lit(1).cast("long")), x.left, x.right, True)

    # views

    def view(self, name: str) -> DataFrame:
        """l, r, w of a let."""
        if name not in self.lets:
            raise CheckProblem(f"unknown relation `{name}`")
        with wrapping(self.spark):
            return self._view(name).df

    def type_of(self, name: str) -> tuple[tuple, tuple]:
        with wrapping(self.spark):
            r = self._view(name)
        return r.left, r.right

    def _view(self, name: str) -> Rel:
        if name in self._rounds:
            return self._rounds[name]
        if name not in self._views:
            if name in self.groups:
                self._fixpoint(self.groups[name])
            else:
                node, declared = self.lets[name]
                got = self.rel(self.compile(node, self.cursor(declared[0]) if declared else None))
                if declared and not (self.fits(got.left, declared[0]) and self.fits(got.right, declared[1])):
                    raise CheckProblem(f"`{name}` is {got.left} -> {got.right}, not {declared[0]} -> {declared[1]}")
                if declared and (got.right, declared[1]) == (INT, MONEY):
                    got = Rel(got.df.withColumn("r", F.col("r") * 100), got.left, MONEY, got.functional)
                self._views[name] = Rel(got.df, *(declared or (got.left, got.right)), got.functional)
        return self._views[name]

    @staticmethod
    def fits(got: tuple, wanted: tuple) -> bool:
        return got == wanted or (got, wanted) == (INT, MONEY) or (got[0] == wanted[0] == "atoms" and set(got[1]) <= set(wanted[1]))

    def cursor(self, t: tuple | None) -> Cursor | None:
        if t is None or t[0] != "entity":
            return None
        b = Base(self, t[1])
        return Cursor(b, b.key, t)

    def _occurrences(self, node, names: set[str]) -> int:
        """The most recursive references that a union's term multiplies."""
        if not isinstance(node, (tuple, list)) or not node:
            return 0
        if node[0] == "name":
            return int(node[1] in names)
        parts = [self._occurrences(x, names) for x in (node[1:] if isinstance(node, tuple) else node)]
        return max(parts, default=0) if node[0] == "union" else sum(parts)

    def _fixpoint(self, group: list[str], most: int = 1000) -> None:
        """Least fixpoint of a group: semi-naive where each term has one recursive reference, else naive. Rounds are written."""
        names = set(group)
        linear = all(self._occurrences(self.lets[n][0], names) <= 1 for n in group)
        types = {n: self.lets[n][1] for n in group}
        empty = {n: Rel(self.spark.createDataFrame([], T.StructType([T.StructField("l", sql_type(a)), T.StructField("r", sql_type(b)), T.StructField("w", T.LongType())])), a, b) for n, (a, b) in types.items()}
        known, delta = dict(empty), dict(empty)
        try:
            for k in range(most):
                self._rounds = delta if linear and k else known
                fresh = {}
                for n in group:
                    got = self.rel(self.compile(self.lets[n][0], self.cursor(types[n][0])))
                    new = R.distinct(got.df).join(known[n].df.select("l", "r"), ["l", "r"], "left_anti")
                    fresh[n] = Rel(cut(new, f"round-{n}"), *types[n])
                if not any(r.df.head(1) for r in fresh.values()):
                    break
                known = {n: Rel(cut(known[n].df.unionByName(fresh[n].df), f"known-{n}"), *types[n]) for n in group}
                delta = fresh
            else:
                raise CheckProblem(f"{', '.join(group)} did not end after {most} rounds")
        finally:
            self._rounds = {}
        self._views.update(known)

    # expressions

    def domain(self, node) -> tuple | None:
        """The left type that an expression has of itself."""
        kind = node[0]
        if kind == "name":
            if node[1] in self.params:
                return None
            if node[1] in self.entities:
                return ("entity", node[1])
            if node[1] in self.lets:
                declared = self.lets[node[1]][1]
                return declared[0] if declared else self._view(node[1]).left
            if node[1] in self.seeds:
                return ("entity", self.seeds[node[1]][0])
            return None
        if kind in ("dot", "where", "fork", "union", "both", "anti", "in", "distinct", "fst", "snd"):
            return self.domain(node[1]) or (self.domain(node[2]) if kind in ("fork", "union", "both") else None)
        if kind in ("cmp", "math"):
            return self.domain(node[2]) or self.domain(node[3])
        return None

    def compile(self, node, cur: Cursor | None) -> Fn | Rel:
        own = self.domain(node)
        if own is not None and own[0] == "entity" and (cur is None or cur.type != own):
            cur = self.cursor(own)
        return getattr(self, f"_{node[0].replace('-', '_')}")(node, cur)

    def _live(self, cur: Cursor) -> Column:
        return F.col(cur.base.fields(cur.key, cur.type[1])["id"]) if cur.type[0] == "entity" else cur.key

    def _constant(self, value: Column, t: tuple, cur: Cursor | None) -> Fn | Rel:
        if cur is None:
            return self.point(value, t)
        return gated(cur.base, (self._live(cur).isNotNull(),), value, ("entity", cur.base.entity), t)

    def _literal(self, node, cur):
        if node[0] == "atom" and cur is None:
            return Rel(self.point(F.lit(node[1]), ("atoms", (node[1],)), key=F.lit(node[1])).df, ("atoms", (node[1],)), ("atoms", (node[1],)), True)
        return self._constant(*literal(*node), cur)

    _int = _money = _text = _date = _atom = _literal

    def _name(self, node, cur):
        n = node[1]
        left = None if cur is None else ("entity", cur.base.entity)
        if n in self.params and cur is not None:
            col, t = self.params[n]
            return Fn(cur.base, F.col(cur.base.fields(col, t[1])["id"]) if t[0] == "entity" else col, left, t)
        if n == "id" or n in self.entities:
            if cur is None:
                raise CheckProblem("`id` needs a domain")
            return Fn(cur.base, self._live(cur), left, cur.type)
        if n in self._rounds or n in self.groups:
            return self._at(n, self._view(n), cur)
        if n in self.lets:
            body, declared = self.lets[n]
            if cur is not None and self.domain(node) == cur.type:
                inner = self.compile(body, cur)
                if isinstance(inner, Fn) and inner.base is cur.base:
                    if declared and (inner.right, declared[1]) == (INT, MONEY):
                        inner = self._as(inner, MONEY)
                    return replace(inner, right=declared[1]) if declared else inner
            return self._at(n, self._view(n), cur)
        if n in self.states:
            return self._constant(cur.base.state(n), self.states[n], cur) if cur is not None else self.point(literal_of(self.state_values[n]), self.states[n])
        if n == "unit":
            return self._constant(F.lit(0).cast("long"), UNIT, cur)
        if n in self.seeds:
            e, i = self.seeds[n]
            t = ("entity", e)
            if cur is not None and cur.type == t:
                return Fn(cur.base, F.when(self._live(cur) == i, cur.key), left, t)
            return self._constant(F.lit(i).cast("long"), t, cur)
        for t in self.types.values():
            if t[0] == "atoms" and n in t[1]:
                return self._literal(("atom", n), cur)
        raise CheckProblem(f"unknown name `{n}`")

    def _at(self, name: str, rel: Rel, cur: Cursor | None) -> Fn | Rel:
        """A view read at a cursor: a join if it is a function, else the relation itself."""
        if cur is None or rel.left != cur.type:
            return rel
        if rel.functional:
            return Fn(cur.base, cur.base.view(cur.key, name, rel), ("entity", cur.base.entity), rel.right)
        if str(cur.key) == str(cur.base.key):
            return rel
        return self._composed(Fn(cur.base, cur.key, ("entity", cur.base.entity), cur.type), rel)

    def _path(self, node, cur):
        if cur is None:
            raise CheckProblem(f"`.{node[1]}` needs a row")
        if cur.type[0] == "entity" and node[1] in self.entities[cur.type[1]].fields:
            names = cur.base.fields(cur.key, cur.type[1])
            stored = names.get(f"{node[1]}{STORED}")
            return Fn(cur.base, F.col(names[node[1]]), ("entity", cur.base.entity), self.entities[cur.type[1]].fields[node[1]], stored=None if stored is None else F.col(stored))
        if node[1] in self.lets or node[1] in self.states or node[1] == "unit":
            return self._name(("name", node[1]), cur)
        raise CheckProblem(f"{cur.type} has no `{node[1]}`")

    def _composed(self, a: Fn | Rel, b: Fn | Rel) -> Rel:
        a, b = self.rel(a), self.rel(b)
        if a.right != b.left:
            raise CheckProblem(f"can't join {a.right} with {b.left}")
        return Rel(R.compose(a.df, b.df), a.left, b.right, a.functional and b.functional)

    def _dot(self, node, cur):
        a = self.compile(node[1], cur)
        step = ("path", node[2][1]) if node[2][0] == "hop" else node[2]
        if isinstance(a, Fn):
            # Rows that a filter drops keep their keys while they are joined: null keys would all go to one task.
            at = Cursor(a.base, a.open(), a.right)
            if node[2][0] == "hop":
                b = self._path(step, at)
            else:
                own = self.domain(step)
                b = self.compile(step, at if own is None or own == a.right else None)
            if isinstance(b, Fn) and b.base is a.base:
                return gated(a.base, (*a.only, *b.only), b.open(), a.left, b.right) if a.only else b
            # No column at the path: the relation itself, from its own keys, composed once.
            if node[2][0] == "hop":
                return self._composed(a, self._name(("name", step[1]), None))
            return self._composed(a, self.compile(step, self.cursor(a.right)))
        at = self.cursor(a.right)
        b = self._path(step, at) if node[2][0] == "hop" and at is not None else self._name(("name", node[2][1]), None) if node[2][0] == "hop" else self.compile(step, at)
        return self._composed(a, b)

    def _pairwise(self, a, b, value, right, keep=None, also=()):
        if isinstance(a, Fn) and isinstance(b, Fn) and a.base is b.base:
            x, y = a.open(), b.open()
            only = (*a.only, *b.only, x.isNotNull(), y.isNotNull())
            if keep is not None:
                only = (*only, *also, keep(x, y))
            return gated(a.base, only, value(a.base.key, x, y), a.left, right)
        a, b = self.rel(a), self.rel(b)
        if a.left != b.left:
            raise CheckProblem(f"{a.left} and {b.left} are not one key")
        return Rel(R.cokeyed(a.df, b.df, value, keep), a.left, right, a.functional and b.functional)

    def _both_sides(self, x, y, cur):
        a = self.compile(x, cur)
        if cur is None and isinstance(a, Fn):
            cur = Cursor(a.base, a.base.key, a.left)
        return a, self.compile(y, cur)

    def _fork(self, node, cur):
        a, b = self._both_sides(node[1], node[2], cur)
        return self._pairwise(a, b, lambda k, x, y: F.struct(x.alias("fst"), y.alias("snd")), ("pair", a.right, b.right))

    def _math(self, node, cur):
        a, b = self._both_sides(node[2], node[3], cur)
        try:
            _, t = arithmetic(node[1], F.lit(0), a.right, F.lit(0), b.right)
        except TypeError as e:
            raise CheckProblem(str(e)) from e
        return self._pairwise(a, b, lambda k, x, y: arithmetic(node[1], x, a.right, y, b.right)[0], t)

    def comparable(self, a: tuple, b: tuple) -> bool:
        return a == b or {a, b} <= {INT, MONEY} or a[0] == b[0] == "atoms"

    def _cmp(self, node, cur):
        a, b = self._both_sides(node[2], node[3], cur)
        if not self.comparable(a.right, b.right):
            raise CheckProblem(f"{a.right} and {b.right} can't be compared")
        return self._pairwise(a, b, lambda k, x, y: k, a.left, lambda x, y: compare(node[1], x, a.right, y, b.right), self._reach(a, node[1], node[3]))

    def _reach(self, a: Fn | Rel, op: str, v) -> tuple[Column, ...]:
        """What a comparison with a literal says of the stored column."""
        if isinstance(a, Fn) and a.stored is not None and v[0] in ("int", "money", "date"):
            return reaches(op, a.stored, a.right, *v)
        return ()

    def _members(self, t: tuple, values: list) -> list:
        for v in values:
            if v[0] == "atom" and (t[0] != "atoms" or v[1] not in t[1]):
                raise CheckProblem(f"{v[1]} is not of {t}")
        return [v[1] * 100 if t == MONEY and v[0] == "int" else v[1] for v in values]

    def _in(self, node, cur):
        a = self.compile(node[1], cur)
        values = self._members(a.right, node[2])
        a = a if isinstance(a, Fn) else self.rel(a)
        if isinstance(a, Fn):
            return gated(a.base, (*a.only, a.open().isNotNull(), a.open().isin(values)), a.base.key, a.left, a.left)
        return Rel(R.consolidate(a.df.where(F.col("r").isin(values)).select("l", F.col("l").alias("r"), "w")), a.left, a.left, a.functional)

    def _union(self, node, cur):
        a, b = self._both_sides(node[1], node[2], cur)
        t = self._joined(a, b)
        a, b = (self.rel(self._as(x, t[1])) for x in (a, b))
        return Rel(R.union(a.df, b.df), *t)

    @staticmethod
    def _as(x: Fn | Rel, t: tuple) -> Fn | Rel:
        """Int as Money, where that is what both sides join to."""
        if (x.right, t) != (INT, MONEY):
            return x
        if isinstance(x, Fn):
            return replace(x, col=x.col * 100, right=MONEY, value=x.open() * 100, stored=None)
        return replace(x, df=x.df.withColumn("r", F.col("r") * 100), right=MONEY)

    def _joined(self, a, b) -> tuple[tuple, tuple]:
        if a.left != b.left:
            raise CheckProblem(f"{a.left} and {b.left} are not one key")
        return a.left, self.join_types(a.right, b.right)

    def join_types(self, a: tuple, b: tuple) -> tuple:
        if a == b:
            return a
        if {a, b} <= {INT, MONEY}:
            return MONEY
        if a[0] == b[0] == "atoms":
            return ("atoms", tuple(sorted({*a[1], *b[1]})))
        raise CheckProblem(f"{a} and {b} don't join")

    def _both(self, node, cur):
        a, b = self._both_sides(node[1], node[2], cur)
        t = self._joined(a, b)
        a, b = self._as(a, t[1]), self._as(b, t[1])
        if isinstance(a, Fn) and isinstance(b, Fn) and a.base is b.base:
            return Fn(a.base, F.when(a.col == b.col, a.col), a.left, t[1])
        return Rel(R.intersect(self.rel(a).df, self.rel(b).df), *t, a.functional if isinstance(a, Rel) else True)

    def _anti(self, node, cur):
        a = self.compile(node[1], cur)
        if isinstance(a, Fn):
            try:
                return gated(a.base, (*a.only, a.open().isNotNull(), ~self.truth(node[2], Cursor(a.base, a.open(), a.right), False)), a.open(), a.left, a.right)
            except NotFused:
                pass
        a, b = self.rel(a), self._filter_relation(node[2], a.right)
        return Rel(R.antijoin(a.df, b.df), a.left, a.right, a.functional)

    def _distinct(self, node, cur):
        a = self.compile(node[1], cur)
        return a if isinstance(a, Fn) else Rel(R.distinct(a.df), a.left, a.right, a.functional)

    def _inverse(self, node, cur):
        own = self.domain(node[1]) or (None if cur is None else cur.type)
        a = self.rel(self.compile(node[1], self.cursor(own)))
        return Rel(R.inverse(a.df), a.right, a.left)

    def _side(self, node, cur):
        a = self.compile(node[1], cur)
        if a.right[0] != "pair":
            raise CheckProblem(f"`{node[0]}` needs a pair")
        t = a.right[1 if node[0] == "fst" else 2]
        return Fn(a.base, a.col[node[0]], a.left, t) if isinstance(a, Fn) else Rel(R.mapped(self.rel(a).df, F.col("r")[node[0]]), a.left, t, a.functional)

    _fst = _snd = _side

    # filters

    def _where(self, node, cur):
        a = self.compile(node[1], cur)
        a = a if isinstance(a, Fn) else self.rel(a)
        p = node[2]
        if p[0] in ("right", "right-in"):
            def keep(x: Column) -> Column:
                if p[0] == "right-in":
                    return x.isin(self._members(a.right, p[1]))
                v, t = literal(*p[2])
                if not self.comparable(a.right, t):
                    raise CheckProblem(f"{a.right} and {t} can't be compared")
                return compare(p[1], x, a.right, v, t)
            if isinstance(a, Fn):
                also = self._reach(a, p[1], p[2]) if p[0] == "right" else ()
                return gated(a.base, (*a.only, a.open().isNotNull(), *also, keep(a.open())), a.open(), a.left, a.right)
            return Rel(a.df.where(keep(F.col("r"))), a.left, a.right, a.functional)
        if isinstance(a, Fn):
            try:
                return gated(a.base, (*a.only, self.truth(p, Cursor(a.base, a.open(), a.right))), a.open(), a.left, a.right)
            except NotFused:
                pass
        a = self.rel(a)
        out = a.df
        for q in self._conjuncts(p):
            out = R.semijoin(out, self._filter_relation(q, a.right).df)
        return Rel(out, a.left, a.right, a.functional)

    def _conjuncts(self, p):
        return [*self._conjuncts(p[1]), *self._conjuncts(p[2])] if p[0] == "both" else [p]

    def _filter_relation(self, p, t: tuple) -> Rel:
        """The keyset that a filter on type t names."""
        cur = self.cursor(t)
        if cur is not None:
            try:
                return self.rel(gated(cur.base, (self.truth(p, cur),), cur.key, t, t))
            except NotFused:
                pass
        if p[0] == "union":
            sides = [self._filter_relation(x, t).df.select("l", F.col("l").alias("r"), "w") for x in p[1:3]]
            return Rel(R.distinct(sides[0].unionByName(sides[1])), t, t)
        if p[0] == "both" and cur is not None:
            return Rel(R.semijoin(self._filter_relation(p[1], t).df.select("l", F.col("l").alias("r"), "w"), self._filter_relation(p[2], t).df), t, t)
        b = self.rel(self.compile(p, cur))
        if b.left != t:
            raise CheckProblem(f"a filter on {t} can't be keyed by {b.left}")
        return Rel(b.df.where("r = 'True'"), b.left, b.right) if b.right == BOOL else b

    def truth(self, p, cur: Cursor, bools: bool = True) -> Column:
        """Whether a filter holds at the cursor; never NULL."""
        no = F.lit(False)
        if p[0] == "both":
            try:
                a, b = self.compile(p[1], cur), self.compile(p[2], cur)
            except NotFused:
                a = b = None
            if isinstance(a, Fn) and isinstance(b, Fn) and a.right == b.right != BOOL and a.right != cur.type and a.base is b.base is cur.base:
                return F.coalesce(a.col == b.col, no)
            return self.truth(p[1], cur, bools) & self.truth(p[2], cur, bools)
        if p[0] == "not":
            return ~self.truth(p[1], cur)
        if p[0] == "union":
            return self.truth(p[1], cur, bools) | self.truth(p[2], cur, bools)
        x = self.compile(p, cur)
        if not isinstance(x, Fn) or x.base is not cur.base:
            raise NotFused
        holds = reduce(Column.__and__, (*x.only, x.open().isNotNull()))
        return holds & (x.open() == "True") if bools and x.right == BOOL else holds

    def _not(self, node, cur):
        if cur is None:
            raise CheckProblem("`not` needs a row")
        left = ("entity", cur.base.entity)
        try:
            return Fn(cur.base, F.when(~self.truth(node[1], cur), cur.key), left, cur.type)
        except NotFused:
            every = self.rel(Fn(cur.base, self._live(cur), left, cur.type))
            return Rel(R.antijoin(every.df, self._filter_relation(node[1], cur.type).df), left, cur.type, True)

    # grouping

    def _by(self, node, cur):
        own = self.domain(node[1]) or self.domain(node[2])
        at = self.cursor(own) if own else cur
        x = self.compile(node[1], at)
        y = self.compile(node[2], Cursor(x.base, x.base.key, x.left) if isinstance(x, Fn) else self.cursor(x.left))
        if isinstance(x, Fn) and isinstance(y, Fn) and x.base is y.base:
            df = x.base.frame().select(y.col.alias("l"), x.col.alias("r")).where("l is not null and r is not null")
            return Rel(df.withColumn("w", F.lit(1).cast("long")), y.right, x.right, loose=True)
        x, y = self.rel(x), self.rel(y)
        if x.left != y.left:
            raise CheckProblem(f"{x.left} and {y.left} are not one key")
        return Rel(R.compose(R.inverse(y.df), x.df), y.right, x.right)

    def _fold(self, node, cur):
        own = self.domain(node[2])
        name, image = node[1], self.compile(node[2], cur if own is None else self.cursor(own))
        image = image if isinstance(image, Rel) else self.rel(image)
        if name != "count" and image.right not in (INT, MONEY):
            raise CheckProblem(f"`{name}` needs numbers")
        if image.right[0] == "pair":
            self.warnings.append(f"`{name}` over a pair keeps every pair")
        out = R.fold(image.df, name, 100 if name == "avg" and image.right == INT else 1)
        if name in ("count", "sum"):
            domain = None
            if image.left == UNIT:
                domain = self.spark.range(1).select(F.lit(0).cast("long").alias("l"))
            elif image.left[0] == "entity":
                domain = self.frame(image.left[1]).select(F.col("id").alias("l"))
            elif image.left[0] == "atoms":
                domain = self.spark.createDataFrame([(a,) for a in image.left[1]], "l string")
            out = out if domain is None else R.totals(out, domain)
        return Rel(out, image.left, {"count": INT, "avg": MONEY}.get(name, image.right), True)

    # choice

    def _match(self, node, cur):
        of = self.compile(node[1], cur)
        if isinstance(of, Fn) and cur is None:
            cur = Cursor(of.base, of.base.key, of.left)
        named = [p for p, _ in node[2] if p is not None]
        if any(p is None for p, _ in node[2][:-1]):
            raise CheckProblem("`_` comes last")
        self._members(of.right, [p for p in named if p[0] == "atom"])
        arms = [(p, self.compile(e, cur)) for p, e in node[2]]
        t = arms[0][1].right
        for _, a in arms[1:]:
            t = self.join_types(t, a.right)
        arms = [(p, self._as(a, t)) for p, a in arms]
        gates = lambda x: [F.coalesce(compare("=", x, of.right, *literal(*p)), F.lit(False)) for p in named]
        if isinstance(of, Fn) and all(isinstance(a, Fn) and a.base is of.base for _, a in arms) and len({p for p in named}) == len(named):
            out = F.lit(None)
            g = gates(of.col)
            for k, (p, a) in reversed(list(enumerate(arms))):
                out = a.col if p is None else F.when(g[k], a.col).otherwise(out)
            return Fn(of.base, out, of.left, t)
        left = arms[0][1].left
        out = None
        for k, (p, a) in enumerate(arms):
            whole = self.rel(of).df
            gate = whole.where(gates(F.col("r"))[k]) if p is not None else None
            for q in named if p is None else []:
                whole = whole.where(~F.coalesce(compare("=", F.col("r"), of.right, *literal(*q)), F.lit(False)))
            gate = (whole if gate is None else gate).select("l", F.col("l").alias("r"), "w")
            got = R.compose(gate, self.rel(a).df)
            out = got if out is None else R.union(out, got)
        return Rel(out, left, t)

    def _if(self, node, cur):
        if cur is None:
            own = self.domain(node[1])
            cur = self.cursor(own)
        if cur is not None:
            try:
                c = self.truth(node[1], cur)
                a, b = self.compile(node[2], cur), self.compile(node[3], cur)
                t = self.join_types(a.right, b.right)
                a, b = self._as(a, t), self._as(b, t)
                if isinstance(a, Fn) and isinstance(b, Fn):
                    return Fn(cur.base, F.when(c, a.col).otherwise(b.col), a.left, t)
                yes = self.rel(Fn(cur.base, F.when(c, cur.key), cur.type, cur.type)).df
                no = self.rel(Fn(cur.base, F.when(~c, cur.key), cur.type, cur.type)).df
                return Rel(R.union(R.compose(yes, self.rel(a).df), R.compose(no, self.rel(b).df)), cur.type, t)
            except NotFused:
                return self._if_related(node, cur)
        raise CheckProblem("`if` needs a condition on the row")

    def _if_related(self, node, cur):
        """The choice where the condition is a relation: rows that have a pair in it take the first arm."""
        a, b = self.compile(node[2], cur), self.compile(node[3], cur)
        t = self.join_types(a.right, b.right)
        a, b = self._as(a, t), self._as(b, t)
        every = self.rel(Fn(cur.base, self._live(cur), ("entity", cur.base.entity), cur.type)).df
        has = self._filter_relation(node[1], cur.type).df
        yes, no = R.compose(R.semijoin(every, has), self.rel(a).df), R.compose(R.antijoin(every, has), self.rel(b).df)
        return Rel(R.union(yes, no), cur.type, t)


def literal_of(v) -> Column:
    return F.lit(v)


__all__ = ["Program", "CheckProblem", "SyntaxProblem", "Rel"]
