"""N-gram Jaccard self-join with prefixes under several global token orders.

A document is its set of distinct word shingles. Sets that are equal form a class and are handled once.
Two linked sets share a token among the first |s| - ceil(t |s|) + 1 of each, whatever the order of
tokens, so candidates must do so under every order: the first order puts tokens that are rare in the
corpus first (by counts of hashed buckets over all documents: a table of a fixed size) and finds
candidates by its inverted lists; pairs must then pass the prefixes under two further, hashed orders
before their sets are fetched and intersected. Up to the smaller of two prefixes' last hashes both sets
are known, so what one lacks there of the other also bounds their intersection.

Lists are not expanded into pairs. Each member of a list is compared with the most central one, which has the
fewest tokens of its own, and what links is joined to components. In a list of up to SHORT members (more in later
rounds) that holds several components, all pairs of different ones are compared. A longer one is parted by size, then
by what its members have different from their central one (`apart`), where copies of it that went
different ways share little, and so on until no list is open: no link between components is lost, and lists
of copies aren't squared.

Defined results: texts without words, and null texts, have no shingles and are linked with nothing;
shorter texts than a shingle have their whole sequence as one; a null doc_id is kept, and names no
component if others have one; rows that repeat a doc_id are documents of their own. Sets are told
apart by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Cut, Scratch, bound_arrow, cut, documents, settle

BUCKETS, CHUNKS, SALTS, REMEMBERED = 1 << 18, 256, 64, 400_000
#: Ids of documents that a broadcast may hold; more are met by a shuffle.
BROADCAST = 1_000_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _scramble(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[k]
    return h ^ (h >> np.uint64(29))


class _WordHashes(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[w] = out = xxhash.xxh3_64_intdigest(w)
        return out


_hashes = _WordHashes()


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + n]) * _MIX[i % 4]
        out ^= out >> np.uint64(32)
    return np.unique(out)


def set_key(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def rare_first(s: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The prefix under the corpus order: ascending bucket count, then hash."""
    k = prefix_length(len(s), percent)
    c = counts[(s & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64)
    order = np.lexsort((s, c))[:k]
    return s[order]


def by_hash(s: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The prefix under a hashed order: its smallest hashes, ascending, as 32 bits."""
    k = prefix_length(len(s), percent)
    h = (_scramble(s, order) >> np.uint64(32)).astype(np.uint32)
    return np.sort(h if k >= len(h) else np.partition(h, k - 1)[:k])


def prefixes(s: np.ndarray, percent: int) -> bytes:
    """The prefixes under the further orders, one after the other."""
    return b"".join([by_hash(s, order, percent).tobytes() for order in (1, 2)])


def may_link(a: np.ndarray, na: int, b: np.ndarray, nb: int, percent: int) -> bool:
    """False if the prefixes a and b of sets of these sizes, under the further orders, rule a link out.

    Equal 32-bit hashes of different tokens only make what is lacking seem less.
    """
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    needed = -(-percent * (na + nb) // (100 + percent))
    for x, y in zip(np.split(a, 2), np.split(b, 2)):
        last = min(x[-1], y[-1])
        x, y = x[: np.searchsorted(x, last, "right")], y[: np.searchsorted(y, last, "right")]
        if not len(x) or not len(y):
            return False
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        back = np.minimum(np.searchsorted(x, y), len(x) - 1)
        both = y[at] == x
        if not both.any() or na - (len(x) - both.sum()) < needed or nb - (x[back] != y).sum() < needed:
            return False
    return True


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (len(a) + len(b) - both)


def bucket_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Documents (shingles) by hashed bucket, over all rows of docs(text)."""
    per = BUCKETS // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            got = [shingles(t.as_buffer().to_pybytes(), size) for t in batch.column(0)]
            c += np.bincount((np.concatenate(got) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS) if got else 0
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([c[i * per : (i + 1) * per].tobytes() for i in range(CHUNKS)], pa.binary())], names=["chunk", "c"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[k] = total.get(k, 0) + np.frombuffer(c.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["chunk", "c"])

    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select("text").mapInArrow(count, "chunk int, c binary").repartition("chunk").mapInArrow(add, "chunk int, c binary").collect():  # CHUNKS rows
        out[r["chunk"] * per : (r["chunk"] + 1) * per] += np.frombuffer(r["c"], np.int64)
    return out


def apart(x: np.ndarray, r: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """What x must share with a set that it links with, seen from r: tokens, and a mark for those that only meet a neighbour of r.

    Both x and y are told by what they differ in from r: then |x ^ y| = |dx| + |dy| - 2 |dx & dy|. If x or y
    isn't linked with r, a link of x and y needs a token that both differ in. Tokens that r lacks
    come first in the order, the rarer ones of the corpus before the others; of r's, which others lack, the
    more frequent ones come first, since the rare ones are lacking everywhere. Bounds, with b = (100 - percent) / (100 + percent):
    a neighbour y of r shares more than (|dy| + b (|r| - |y|)) / 2 such tokens with any x that isn't one, and so do two sets
    that aren't; x shares at least |dx| - b (|x| + |y|) of them with a neighbour. A common token that r lacks
    is also the first of all common tokens, so it lies in the prefix that the sizes alone call for.
    """
    own, lost = np.setdiff1d(x, r, assume_unique=True), np.setdiff1d(r, x, assume_unique=True)
    d, n, m = len(own) + len(lost), len(x), len(r)
    near = 100 * (n - len(own)) >= percent * (m + len(own))
    short = -(-(d * (100 + percent) + (100 - percent) * (n - m)) // (2 * (100 + percent)))
    whole = short
    if not near and 10000 * m >= percent * percent * n:
        whole = min(d, (100 - percent) * (percent * n + 100 * min(n, m)) // (percent * (100 + percent)) + 1)
        whole = max(short, whole)
    most = prefix_length(n, percent)

    def first(s: np.ndarray, k: int, way: int) -> np.ndarray:
        return s[np.lexsort((s, way * counts[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]))[: max(k, 0)]]

    mine = first(own, min(whole, most), 1)
    theirs = first(lost, whole - len(own), -1) if len(own) < most else lost[:0]
    return np.concatenate([mine, theirs]), np.arange(len(mine) + len(theirs)) >= max(short, 0)


def _bounded(ids: DataFrame) -> DataFrame:
    """ids, broadcast if there are few enough, so that texts needn't be shuffled to meet them."""
    return F.broadcast(ids) if ids.count() <= BROADCAST else ids


def similar(docs: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row; documents link at 100 |a & b| >= percent |a | b|."""
    every, of_class = _classes(docs, size, percent, id_col, text_col)
    return every.join(of_class, F.col("k") == F.col("ck"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _classes(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h (hash of the text), n, k), and classes: ck, the component's component_id, and its node."""
    spark = docs.sparkSession
    bound_arrow(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = bucket_counts(d, size)
    shared = spark.sparkContext.broadcast(counts)
    often = int(counts.mean()) + max(int(counts.sum()) // 100_000, 100)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, ks, ps, qs = [], [], [], []
            for t in batch.column(2):
                s = shingles(t.as_buffer().to_pybytes(), size)
                ns.append(len(s))
                ks.append(set_key(s) if len(s) else None)
                ps.append(rare_first(s, shared.value, percent).tobytes() if len(s) else None)
                qs.append(prefixes(s, percent) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(ks, pa.int64()), pa.array(ps, pa.binary()), pa.array(qs, pa.binary())], names=["doc_id", "h", "n", "k", "p", "q"])

    made = Cut(d.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(keys, "doc_id long, h long, n long, k long, p binary, q binary"), "sets")
    every = cut(made.df.select("doc_id", "h", "n", "k"), "documents")
    # Prefixes of one document for each class: the others are not shuffled.
    firsts = every.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"))
    of_first = made.df.where("k is not null").select(F.col("k").alias("fk"), F.col("doc_id").alias("fd"), "p", "q")
    classes = cut(firsts.join(of_first, (F.col("k") == F.col("fk")) & F.col("first").eqNullSafe(F.col("fd"))).dropDuplicates(["k"]).select("k", "first", "n", "p", "q"), "classes")
    made.drop()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(p.as_buffer(), np.uint64) for p in batch.column(2)]
            times = np.array([len(x) for x in lists], np.int64)
            t = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
            k = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), times)
            salt = np.where(shared.value[(t & np.uint64(BUCKETS - 1)).astype(np.int64)] > often, k % SALTS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64)), pa.array(salt.astype(np.int32)), pa.array(k), pa.array(np.repeat(batch.column(1).to_numpy(zero_copy_only=False), times).astype(np.int32))], names=["t", "salt", "k", "n"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by token: those whose token another row here has, and those of salted tokens."""
        held = None
        for batch in chain(batches, [None]):
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)] if batch is not None else [np.zeros(0, x) for x in (np.int64, np.int32, np.int64, np.int32)]
            if batch is not None and not len(rows[0]):
                continue
            before = held[1] if held else False
            t, salt, k, n = ([np.append(h, r) for h, r in zip(held[0], rows)] if held else rows)
            if not len(t):
                return
            same = t[1:] == t[:-1]
            keep = np.append(before, same) | np.append(same, False) | (salt >= 0)
            if batch is not None:
                held = [x[-1:] for x in (t, salt, k, n)], bool(same[-1]) if len(same) else before
                t, k, n, keep = t[:-1], k[:-1], n[:-1], keep[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(k[keep]), pa.array(n[keep])], names=["t", "k", "n"])

    token_rows = classes.select("k", "n", "p").mapInArrow(tokens, "t long, salt int, k long, n int")
    kept = cut(token_rows.repartition("t", "salt").sortWithinPartitions("t").mapInArrow(met, "t long, k long, n int"), "tokens")
    # A set with few tokens of its own stands amidst its copies: it is compared with the others first.
    info = cut(kept.groupBy("k").agg(F.first("n").alias("n"), F.count("*").alias("c")).select("k", "n", F.floor(F.col("c") * -1000 / (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).cast("int").alias("u")), "ranks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            got = [shingles(t.as_buffer().to_pybytes(), size) for t in batch.column(0)]
            got = {set_key(s): s for s in got}
            new = [k for k in got if k not in seen]
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([got[k].tobytes() for k in new], pa.binary())], names=["k", "s"])

    def whole_sets(of: DataFrame) -> DataFrame:
        """a, b, sa, sb of pairs(a, b)."""
        ends = of.select(F.col("a").alias("k")).union(of.select("b")).distinct()
        firsts = cut(classes.join(ends, "k", "left_semi").select(F.col("first").alias("fd")).distinct(), "firsts")
        whole = cut(d.join(_bounded(firsts), F.col("doc_id").eqNullSafe(F.col("fd")), "left_semi").select("text").mapInArrow(sets, "k long, s binary"), "whole")
        if whole.count() > whole.select("k").distinct().count():  # rows that repeat a document
            whole = cut(whole.dropDuplicates(["k"]), "whole")
        x, y = whole.select(F.col("k").alias("a"), F.col("s").alias("sa")), whole.select(F.col("k").alias("b"), F.col("s").alias("sb"))
        return of.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "sa", "sb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    def rule_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            ok = [may_link(np.frombuffer(x.as_buffer(), np.uint32), m, np.frombuffer(y.as_buffer(), np.uint32), n, percent) for x, m, y, n in zip(batch.column(3), na, batch.column(5), nb)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    def links(of: DataFrame) -> DataFrame:
        x, y = (classes.select(F.col("k").alias(e), F.col("n").alias(f"n{e}"), F.col("q").alias(f"q{e}")) for e in "ab")
        of = Cut(of.join(x, "a").join(y, "b").select("a", "b", "na", "qa", "nb", "qb").mapInArrow(rule_out, "a long, b long"), "kept-pairs")
        out = cut(whole_sets(of.df).mapInArrow(verify, "a long, b long"), "links")
        of.drop()
        return out

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [apart(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), shared.value, percent) for x, y in zip(batch.column(2), batch.column(3))]
            times = [len(t) for t, _ in got]
            k, r = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), times) for i in (0, 1))
            t = np.concatenate([t for t, _ in got]) if got else np.zeros(0, np.uint64)
            t = _scramble(t ^ (r.astype(np.uint64) * _MIX[3]), 1)
            yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64)), pa.array(k), pa.array(np.concatenate([q for _, q in got]) if got else np.zeros(0, bool), pa.bool_())], names=["t", "k", "q"])

    fits = lambda x, y: (x["n"] * 100 >= y["n"] * percent) & (y["n"] * 100 >= x["n"] * percent)

    def narrower(long: DataFrame, k: int) -> DataFrame:
        """Lists parted by size first (sets that link are in one band of sizes, or in bands that follow each other), then by differences."""
        if k == 0:
            band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-9))).cast("int")
            both = F.explode(F.array(F.struct(band.alias("band"), F.lit(False).alias("q")), F.struct((band + 1).alias("band"), F.lit(True).alias("q"))))
            return long.select("t", "k", both.alias("z")).select(F.xxhash64("t", "z.band").alias("t"), "k", "z.q")
        stars = cut(long.select(F.col("k").alias("a"), F.col("r").alias("b")).where("a <> b").distinct(), "open-stars")
        return whole_sets(stars).mapInArrow(differences, "t long, k long, q boolean")

    part = settle(kept.select("t", "k", F.lit(False).alias("q")), info, ["k", "n"], fits, links, narrower)
    of_class = classes.select("k", "first").join(part, F.col("k") == F.col("node"), "left")
    least = of_class.where("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    of_class = of_class.join(least, "component", "left").select(F.col("k").alias("ck"), F.coalesce("least", "first").alias("component_id"), F.coalesce("component", "k").alias("node"))
    return every, of_class


def one_of_each(docs: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of linked documents, and all rows without words.

    The row that stays is the first by doc_id (null first), then by a hash of its text, then by a hash of all its columns.
    """
    with Scratch() as made:
        every, of_class = _classes(docs, size, percent, id_col, text_col)
        rows = cut(every.where("k is not null").join(of_class, F.col("k") == F.col("ck")).groupBy("node", "doc_id", "h").agg(F.count("*").alias("c")), "groups")
        firsts = rows.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("m"), F.sum("c").alias("c")).where("c > 1").select(F.col("node").alias("fn"), "m")
        gone = rows.join(firsts, F.col("node") == F.col("fn"))
        first = F.col("m.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("m.h") == F.col("h"))
        gone = made.keep(gone.select(F.col("doc_id").alias("gd"), F.col("h").alias("gh"), first.alias("first"), "c").where("not first or c > 1"), "gone")
    own = [F.col(id_col).cast("long").alias("gd"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("gh")]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *own)
    on = lambda g: F.col("keyed.gd").eqNullSafe(F.col(f"{g}.gd")) & (F.col("keyed.gh") == F.col(f"{g}.gh"))
    stay = keyed.alias("keyed").join(_bounded(gone).alias("gone"), on("gone"), "left_anti").select("doc")
    # Rows of the first of a group that come more than once.
    same = keyed.alias("keyed").join(_bounded(gone.where("first")).alias("same"), on("same"), "left_semi")
    same = same.withColumn("place", F.row_number().over(Window.partitionBy("gd", "gh").orderBy(F.xxhash64(F.to_json("doc"))))).where("place = 1").select("doc")
    return stay.unionByName(same).select("doc.*")


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar(documents(spark, sf_dir), size=4, percent=85)
