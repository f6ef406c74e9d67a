"""Events: handlers that run as one transaction, the log, replay, snapshots, and exact changes of views."""

from __future__ import annotations

import datetime
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import INT, MONEY, UNIT, wrapping
from ..operators import relations as R
from ..operators.cutting import cut
from ..plans.program import Base, CheckProblem, Cursor, Entity, Fn, NotFused, Program, sql_type

#: Events after which changed tables are written, so that plans stay short.
WRITE_EVERY = 8


class Rejected(Exception):
    """The event does not apply; nothing was written or logged."""


class Invalid(Exception):
    """The event is no event of the program."""


@dataclass
class Change:
    kind: str  # new, update, delete
    entity: str
    rows: DataFrame


class App:
    def __init__(self, spark: SparkSession, source: str, frames: dict[str, DataFrame] | None = None):
        self.spark, self.source = spark, source
        self.program = Program(spark, source, frames)
        self.program.entities["Unit#"] = Entity("Unit#", {}, None, [{"id": 0}])
        self.next_id = {}
        for n, e in self.program.entities.items():
            self.next_id[n] = None if n in self.program.loaders else len(e.rows)  # counted when first needed
        self.log: list[dict] = []
        self.seq = 0
        #: The last batch of a stream that an entity's table holds.
        self.applied: dict[str, int] = {}
        self._age = 0

    # reading

    def view(self, name: str) -> DataFrame:
        return self.program.view(name)

    def levels(self, rows: str, attributes: list[str], order: str | None = None, parent: str | None = None, desc: bool = False) -> DataFrame:
        """A nesting level: rows of a keyset view with their parent, attribute views as columns, and their place among siblings."""
        from pyspark.sql import Window

        out = self.view(rows).select(F.col("l").alias("id"))
        for a in [*attributes, *([parent] if parent else []), *([order] if order else [])]:
            v = self.view(a)
            out = out.join(v.select(F.col("l").alias(f"k_{a}"), F.col("r").alias(a)), F.col("id") == F.col(f"k_{a}"), "inner" if a == parent else "left").drop(f"k_{a}")
        by = [F.col(order).desc() if desc else F.col(order).asc()] if order else []
        return out.withColumn("place", F.row_number().over(Window.partitionBy(*([parent] if parent else [F.lit(0)])).orderBy(*by, "id")))

    # transactions

    def dispatch(self, name: str, *args, watch: list[str] | tuple = (), replaying: dict | None = None) -> dict[str, DataFrame]:
        """Runs an event; returns the exact change (l, r, w) of each watched view."""
        if name not in self.program.handlers:
            raise Invalid(f"no handler for `{name}`")
        before = {v: self.view(v) for v in watch}
        changes: list[Change] = []
        states: dict[str, object] = {}
        ids = _Ids(self)
        with wrapping(self.spark):
            self._run(name, list(args), changes, states, ids)
            self._apply(changes, states)
        self.next_id = dict(ids)
        self.seq += 1
        self.log.append({"seq": self.seq, "name": name, "args": [_wire(a) for a in args]})
        return {v: R.minus(self.view(v), before[v]) for v in watch}

    def _check(self, name: str, params: dict, args: list) -> None:
        if len(params) != len(args):
            raise Invalid(f"`{name}` takes {len(params)} arguments")
        for (p, t), a in zip(params.items(), args):
            ok = {"relation": isinstance(a, list), "Text": isinstance(a, str), "Date": isinstance(a, datetime.date), "atoms": t[0] == "atoms" and a in t[1]}.get(t[0], isinstance(a, int) and not isinstance(a, bool) and -(1 << 63) <= a < 1 << 63)
            if not ok:
                raise Invalid(f"`{p}` of `{name}` can't be {a!r}")

    def _run(self, name: str, args: list, changes: list[Change], states: dict, ids: dict, depth: int = 0) -> None:
        if depth > 64:
            raise Invalid("events call each other in a circle")
        params, body = self.program.handlers[name]
        kinds = self.program.events[name]
        self._check(name, kinds, args)
        self._scopes = getattr(self, "_scopes", [])
        self._scopes.append((dict(zip(params, args)), dict(zip(params, kinds.values())), {}))
        kept = self.program.params
        try:
            self._enter()
            for action in body:
                self._act(action, changes, states, ids, depth)
        finally:
            self._scopes.pop()
            self.program.params = kept

    def _enter(self) -> None:
        values, kinds, made = self._scopes[-1]
        self.program.params = {p: (F.lit(v).cast(sql_type(kinds[p])), kinds[p]) for p, v in values.items() if kinds[p][0] != "relation"}
        self._made = made

    def _unit(self) -> Cursor:
        b = Base(self.program, "Unit#")
        return Cursor(b, b.key, UNIT)

    def _holds(self, node) -> bool:
        if node[0] == "both":
            return self._holds(node[1]) and self._holds(node[2])
        if node[0] == "union":
            return self._holds(node[1]) or self._holds(node[2])
        if node[0] == "not":
            return not self._holds(node[1])
        cur = self._unit()
        try:
            return bool(cur.base.frame().select(self.program.truth(node, cur).alias("x")).first()["x"]) if self._fuses(node, cur) else self._any(node)
        except NotFused:
            return self._any(node)

    def _fuses(self, node, cur: Cursor) -> bool:
        x = self.program.compile(node, cur)
        return isinstance(x, Fn) and x.base is cur.base

    def _any(self, node) -> bool:
        return bool(self.program.rel(self.program.compile(node, None)).df.head(1))

    def _value(self, node):
        if node[0] == "name" and node[1] in self._made:
            return self._made[node[1]]
        if node[0] in ("cmp", "not", "both", "union") or (node[0] == "in"):
            return "True" if self._holds(node) else "False"
        cur = self._unit()
        x = self.program.compile(node, cur)
        row = cur.base.frame().select(x.col.alias("x")).first()
        if row is None or row["x"] is None:
            raise Rejected("a value reads something absent")
        return row["x"]

    def _scaled(self, entity: str, f: str, node, value):
        e = self.program.entities[entity]
        if f not in e.fields:
            raise Invalid(f"`{entity}` has no field `{f}`")
        cur = self._unit()
        if e.fields[f] == MONEY and node[0] != "name":
            x = self.program.compile(node, cur)
            return value * 100 if x.right == INT else value
        return value

    def _act(self, a, changes, states, ids, depth) -> None:
        kind = a[0]
        if kind == "new":
            _, bound, entity, fields = a
            e = self.program.entities[entity]
            if e.key and not set(e.key) <= set(fields):
                raise Invalid(f"a new `{entity}` needs its whole key")
            row = {f: self._scaled(entity, f, v, self._value(v)) for f, v in fields.items()}
            row["id"] = ids[entity]
            ids[entity] += 1
            if bound:
                self._made[bound] = row["id"]
            changes.append(Change("new", entity, self._rows(entity, [row])))
        elif kind == "new-from":
            self._bulk(a, changes, ids)
        elif kind in ("update", "delete"):
            entity, keyset = self._target(a[1])
            b = keyset.base
            if kind == "delete":
                changes.append(Change("delete", entity, b.frame().select(keyset.col.alias("id")).where("id is not null")))
                return
            cur = Cursor(b, b.key, ("entity", entity))
            new = {}
            for f, v in a[2].items():
                if f in (self.program.entities[entity].key or []):
                    raise Invalid(f"`{f}` is in the key of `{entity}`")
                t = self.program.entities[entity].fields.get(f)
                if t is None:
                    raise Invalid(f"`{entity}` has no field `{f}`")
                if v[0] == "name" and v[1] in self._made:
                    new[f] = F.lit(self._made[v[1]])
                elif v[0] in ("cmp", "not", "both", "union", "in"):
                    new[f] = F.when(self.program.truth(v, cur), F.lit("True")).otherwise(F.lit("False"))
                else:
                    x = self.program.compile(v, cur)
                    new[f] = x.col * 100 if (x.right, t) == (INT, MONEY) else x.col
            rows = b.frame().select(keyset.col.alias("id"), *[c.alias(f"n_{f}") for f, c in new.items()]).where("id is not null")
            absent = rows.where(" or ".join(f"n_{f} is null" for f in new))
            if absent.head(1):
                raise Rejected("a value reads something absent")
            changes.append(Change("update", entity, rows))
        elif kind == "set":
            if a[1] not in self.program.states:
                raise Invalid(f"no state `{a[1]}`")
            states[a[1]] = self._value(a[2])
        elif kind == "do":
            args = [self._value(x) for x in a[2]]
            self._run(a[1], args, changes, states, ids, depth + 1)
            self._enter_again()
        elif kind == "if":
            for x in a[2] if self._holds(a[1]) else a[3]:
                self._act(x, changes, states, ids, depth)
        elif kind == "reject":
            raise Rejected(a[1])

    def _enter_again(self) -> None:
        made = self._scopes[-1][2]
        self._enter()
        self._made = made

    def _target(self, node) -> tuple[str, Fn]:
        if node[0] == "name" and node[1] in self._made:
            raise Invalid("a row made here is written by its own `new`")
        if node[0] == "name" and node[1] in self.program.params:
            col, t = self.program.params[node[1]]
            b = Base(self.program, t[1])
            return t[1], Fn(b, F.when(b.key == col, b.key), t, t)
        x = self.program.compile(node, None)
        if x.right[0] != "entity" or x.left != x.right:
            raise Invalid("a target is a set of rows")
        if isinstance(x, Fn):
            if str(x.col) != str(x.base.key) and x.base.frame().where(x.col != x.base.key).head(1):
                raise Invalid("a target is a set of rows")
            return x.right[1], x
        x = self.program.rel(x)
        if x.df.where("l <> r").head(1):
            raise Invalid("a target is a set of rows")
        x.df = R.distinct(x.df)
        name = x.right[1]
        b = Base(self.program, name)
        self.program._views["target#"] = x
        return name, Fn(b, F.when(b.view(b.key, "target#", x).isNotNull(), b.key), x.right, x.right)

    def _rows(self, entity: str, rows: list[dict]) -> DataFrame:
        e = self.program.entities[entity]
        schema = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(f, sql_type(t)) for f, t in e.fields.items()]])
        return self.spark.createDataFrame([tuple(r.get(c) for c in ("id", *e.fields)) for r in rows], schema)

    def _bulk(self, a, changes, ids) -> None:
        """One row for each pair of a relation argument, in key order."""
        _, entity, rel, k, v, fields = a
        kind = self._scopes[-1][1].get(rel)
        if kind is None or kind[0] != "relation":
            raise Invalid(f"`{rel}` is no relation")
        pairs = sorted((x, y) for x, y, w in self._scopes[-1][0][rel] if w > 0)
        arg = Entity("Arg#", {"k": kind[1], "v": kind[2]}, None, [{"id": i, "k": x, "v": y} for i, (x, y) in enumerate(pairs)])
        self.program.entities["Arg#"] = arg
        kept = self.program.params
        b = Base(self.program, "Arg#")
        self.program.params = kept | {k: (F.col("e_k"), kind[1]), v: (F.col("e_v"), kind[2])}
        try:
            cur = Cursor(b, b.key, ("entity", "Arg#"))
            e = self.program.entities[entity]
            cols = {}
            for f, x in fields.items():
                got = self.program.compile(x, cur)
                cols[f] = got.col * 100 if (got.right, e.fields[f]) == (INT, MONEY) else got.col
            rows = b.frame().select((F.col("e_id") + ids[entity]).alias("id"), *[(cols[f] if f in cols else F.lit(None)).cast(sql_type(t)).alias(f) for f, t in e.fields.items()])
            if cols and rows.where(" or ".join(f"{f} is null" for f in cols)).head(1):
                raise Rejected("a value reads something absent")
            changes.append(Change("new", entity, cut(rows, "bulk")))
            ids[entity] += len(pairs)
        finally:
            self.program.params = kept
            del self.program.entities["Arg#"]

    def _apply(self, changes: list[Change], states: dict) -> None:
        """Changes in statement order, over the state that all of them have read."""
        frames = {c.entity: self.program.frame(c.entity) for c in changes}
        for c in changes:
            now = frames[c.entity]
            if c.kind == "new":
                key = self.program.entities[c.entity].key
                if key and now.join(c.rows.select(*key), key, "left_semi").head(1) or key and c.rows.groupBy(*key).count().where("count > 1").head(1):
                    raise Rejected(f"a `{c.entity}` with this {' and '.join(f'`{k}`' for k in key)} already exists")
                frames[c.entity] = now.unionByName(c.rows)
            elif c.kind == "delete":
                frames[c.entity] = now.join(c.rows, "id", "left_anti")
            else:
                rows = c.rows.withColumnRenamed("id", "n_id")
                fields = [f[2:] for f in c.rows.columns if f.startswith("n_")]
                j = now.join(rows, F.col("id") == F.col("n_id"), "left")
                frames[c.entity] = j.select(*[F.when(F.col("n_id").isNotNull(), F.col(f"n_{f}")).otherwise(F.col(f)).alias(f) if f in fields else F.col(f) for f in now.columns])
        self._age += 1
        for n, df in frames.items():
            self.program.bind(n, cut(df, f"table-{n}") if self._age % WRITE_EVERY == 0 else df)
        self.program.state_values.update(states)
        self.program._views.clear()

    # base changes from elsewhere

    def step(self, entity: str, signed: DataFrame, watch: list[str]) -> dict[str, DataFrame]:
        """signed: id, fields and w: rows that come (1) and go (-1); returns the watched views' changes."""
        with wrapping(self.spark):
            before = {v: self.view(v) for v in watch}
            now = self.program.frame(entity)
            gone = signed.where("w < 0").select("id")
            come = signed.where("w > 0").select(*now.columns)
            self.program.bind(entity, cut(now.join(gone, "id", "left_anti").unionByName(come), f"table-{entity}"))
            self.program._views.clear()
            top = come.agg(F.max("id")).first()[0]
            if top is not None and self.next_id[entity] is not None:  # else it is counted when first needed
                self.next_id[entity] = max(self.next_id[entity], top + 1)
            return {v: R.minus(self.view(v), before[v]) for v in watch}

    def follow(self, stream: DataFrame, entity: str, watch: list[str], out: str, checkpoint: str):
        """A streaming query: each micro-batch of signed rows is one step; view changes go to out/<view>/batch_number=n.

        Tables and the number of the batch that they hold are snapshot together to out/_state; after a restart, follow on with
        an app restored from there. A batch that was not snapshot is applied again, over the changes it wrote.
        """
        if entity not in self.applied and _holds_file(self.spark, f"{out}/_state/meta.json"):
            raise Invalid(f"batches were applied before: restore from {out}/_state")

        def batch(df: DataFrame, n: int) -> None:
            if n <= self.applied.get(entity, -1):
                return
            for v, delta in self.step(entity, df, watch).items():
                delta.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/{v}/batch_number={n}")
            self.applied[entity] = n
            self.snapshot(f"{out}/_state")

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    # log and snapshots

    def log_since(self, cursor: int) -> list[dict]:
        return [x for x in self.log if x["seq"] > cursor]

    @classmethod
    def replay(cls, spark: SparkSession, source: str, log: list[dict], frames: dict[str, DataFrame] | None = None) -> App:
        app = cls(spark, source, frames)
        for x in log:
            if x["seq"] != app.seq + 1:
                raise Invalid(f"event {x['seq']} is out of order")
            app.dispatch(x["name"], *[_unwire(a) for a in x["args"]])
        return app

    def snapshot(self, path: str) -> None:
        """Writes every table to a folder of its own below path, and then, in one small file, which folder holds and what numbers follow.

        The tables of earlier snapshots stay, since frames of a restored app may read them; a writer that dies leaves the last snapshot in force.
        """
        folder = f"at-{self.seq}-{uuid.uuid4().hex}"
        for n in self.program.entities:
            if not n.endswith("#"):
                self.program.frame(n).write.parquet(f"{path}/{folder}/{n}")
        ids = _Ids(self)
        meta = {"folder": folder, "next_id": {n: ids[n] for n in self.next_id}, "seq": self.seq, "applied": self.applied, "states": {k: _wire(v) for k, v in self.program.state_values.items()}}
        _put(self.spark, f"{path}/meta.json", json.dumps(meta))

    @classmethod
    def restore(cls, spark: SparkSession, source: str, path: str) -> App:
        app = cls(spark, source)
        meta = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/meta.json", wholetext=True).collect()))  # one small file
        for n in app.program.entities:
            if not n.endswith("#"):
                df = spark.read.parquet(f"{path}/{meta['folder']}/{n}")
                top = df.agg(F.max("id")).first()[0]
                if top is not None and top >= meta["next_id"][n]:
                    raise Invalid(f"`{n}` has ids beyond its counter")
                app.program.bind(n, df)
        app.next_id, app.seq, app.applied = meta["next_id"], meta["seq"], meta["applied"]
        app.program.state_values.update({k: _unwire(v) for k, v in meta["states"].items()})
        return app


def _holds_file(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file to whatever store Spark reads the path from, and puts it in place by a rename."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = at.getFileSystem(conf)
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at):
        fs.delete(at, False)
    fs.rename(new, at)


class _Ids(dict):
    """The ids that come next; those of loaded tables follow the largest one there."""

    def __init__(self, app: App):
        super().__init__(app.next_id)
        self.app = app

    def __getitem__(self, entity: str) -> int:
        if super().__getitem__(entity) is None:
            top = self.app.program.frame(entity).agg(F.max("id")).first()[0]
            self[entity] = 0 if top is None else top + 1
        return super().__getitem__(entity)


def _wire(v):
    return {"d": v.isoformat()} if isinstance(v, datetime.date) else v


def _unwire(v):
    return datetime.date.fromisoformat(v["d"]) if isinstance(v, dict) else v


__all__ = ["App", "Rejected", "Invalid", "CheckProblem"]
