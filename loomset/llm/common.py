"""What the operators share: word counting, shared folders, cut lineage, Arrow limits, and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, as a Java regular expression.
WS = r"[\x20\x09-\x0D]+"
#: Used only where the session names no shared folder, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints/loomset"
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []
_open = threading.local()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which only a local master may leave unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    if scope := getattr(_open, "scope", None):
        scope.paths.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the session is gone; the folder's owner clears it
            return


class Cut:
    """A DataFrame written to the shared folder and read back: lineage ends here, and lost executors lose nothing."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark, self.path = df.sparkSession, shared_path(df.sparkSession, tag)
        was = self.spark.conf.get(CLEANED, None)
        self.spark.conf.set(CLEANED, "true")  # the write's shuffles go with it, not when the driver next collects its garbage
        try:
            df.write.option("compression", "zstd").parquet(self.path)
        finally:
            self.spark.conf.unset(CLEANED) if was is None else self.spark.conf.set(CLEANED, was)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def cut(df: DataFrame, tag: str) -> DataFrame:
    return Cut(df, tag).df


class Scratch:
    """What this thread writes to the shared folder while it is open goes when it closes, but for what is kept."""

    def __enter__(self) -> Scratch:
        self.paths: list[tuple[SparkSession, str]] = []
        self.outer, _open.scope = getattr(_open, "scope", None), self
        return self

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """df, written, so that it needs nothing else that goes; an outer scope may still drop it."""
        kept = Cut(df, tag)
        own = self.paths.pop()
        if self.outer:
            self.outer.paths.append(own)
        return kept.df

    def __exit__(self, *_) -> None:
        _open.scope = self.outer
        for spark, path in self.paths:
            drop_path(spark, path)


def ship(spark: SparkSession) -> None:
    """Spark hands this subpackage to its Python workers, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).parent
    d = tempfile.mkdtemp()  # the driver serves it to the executors for as long as it lives
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    with zipfile.ZipFile(f"{d}/loomset_llm.zip", "w") as z:
        z.write(here.parent / "__init__.py", f"{here.parent.name}/__init__.py")
        for p in here.glob("*.py"):
            z.write(p, f"{here.parent.name}/{here.name}/{p.name}")
    spark.sparkContext.addPyFile(f"{d}/loomset_llm.zip")
    _shipped.add(app)


def bound_arrow(spark: SparkSession) -> None:
    """Batches that Python workers hold stay small however long the texts are."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def n_words(text: Column) -> Column:
    """Number of maximal runs of [^\\x20\\x09-\\x0D]; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), WS)
    first = (F.get(parts, F.lit(0)) == "").cast("long")
    last = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("long")
    return F.size(parts).cast("long") - first - last


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds; each writes its edges to the shared folder. Only
    counts and one checksum of a round reach the driver.
    """
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    now = Cut(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    seen = None
    while True:
        e = now.df
        sides = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sides.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        mid = Cut(large, tag)
        small_low = mid.df.groupBy("a").agg(F.min("b").alias("m"))
        joined = mid.df.join(small_low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_low.select("a", "m")).where("a <> b").distinct()
        after = Cut(small, tag)
        mark = after.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now.drop()
        mid.drop()
        now = after
        if mark == seen:
            break
        seen = mark
    e = now.df
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(
        e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component")))


#: Members of an open list that are all compared; longer lists are parted first.
#: Lists made of an open list's members may be WIDEN times as long, so that few rounds are left for what doesn't part.
SHORT, WIDEN = 16, 4


def listed_members(rows: DataFrame, info: DataFrame) -> DataFrame:
    """Members of lists of more than one: rows' and info's columns, c (members), r (the central one: least by u, n, k)."""
    written = Cut(rows.join(info, "k"), "members")
    members = written.df
    lists = members.groupBy("t").agg(F.count("*").alias("c"), F.min(F.struct("u", "n", "k")).alias("r"), F.min("q").alias("q")).where("c > 1 and not q").select("t", "c", F.col("r.k").alias("r"))
    out = cut(members.drop("q").join(lists, "t"), "lists")
    written.drop()
    return out


def with_component(listed: DataFrame, part: DataFrame) -> DataFrame:
    return listed.join(part.select(F.col("node").alias("k"), "component"), "k", "left").withColumn("component", F.coalesce("component", "k"))


def _ordered(pairs: DataFrame, fits) -> DataFrame:
    """a > b of the pairs of members (x, y) that fit."""
    return pairs.where(fits(F.col("x"), F.col("y"))).select(F.greatest("x.k", "y.k").alias("a"), F.least("x.k", "y.k").alias("b"))


def stars(listed: DataFrame, columns: list[str], fits) -> DataFrame:
    """Each member of a list with its central one."""
    centre = listed.where("k = r").select(F.col("t").alias("ct"), F.struct(*columns).alias("y"))
    rest = listed.where("k <> r").select("t", F.struct(*columns).alias("x"))
    return _ordered(rest.join(centre, F.col("t") == F.col("ct")).select("x", "y"), fits)


def _inside(listed: DataFrame, columns: list[str], fits) -> DataFrame:
    """Pairs of short lists."""
    few = listed.groupBy("t").agg(F.collect_list(F.struct(*columns)).alias("m"))
    few = few.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y")).where(F.col("x.k") > F.col("y.k"))
    return _ordered(few, fits)


def settle(rows: DataFrame, info: DataFrame, columns: list[str], fits, links, narrower) -> DataFrame:
    """node, component: the components of members of lists that link, without squaring long lists.

    rows: t (list), k (member), q (needs a member without q in its list) and more; info: of each k u (least for members
    amidst their copies), n, and the columns that fits(x, y) reads, structs of `columns`; links(pairs(a, b)) keeps those that link.
    Each member is compared with its list's central one. Of a list that still holds several components, all pairs of
    different ones are compared if it is short; else narrower(members, round) gives rows of new lists, in which
    every two of its members that may link and aren't both of one component meet again.
    """
    listed = listed_members(rows, info)
    tried = cut(stars(listed, columns, fits).distinct(), "pairs")
    every = links(tried)
    part = cut(components(every), "parts")
    columns, apart = [*columns, "component"], lambda x, y: fits(x, y) & (x["component"] != y["component"])
    short, k = SHORT, 0
    while listed is not None:
        found = cut(with_component(listed, part), "members")
        split = found.where("c > 2").groupBy("t").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("t")
        left = cut(found.join(split, "t", "left_semi"), "open")
        if not left.head(1):
            break
        new = _inside(left.where(F.col("c") <= short), columns, apart)
        long = left.where(F.col("c") > short)
        listed = None
        if long.head(1):
            listed = listed_members(narrower(long, k), info)
            new = new.unionByName(stars(with_component(listed, part), columns, apart))
        new = cut(new.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(new)
        got = links(new)
        if got.head(1):
            every = every.unionByName(got)
            part = cut(components(every), "parts")
        short, k = short * WIDEN, k + 1
    return part
