"""Packing into windows of a fixed length by non-negative least squares.

Whole windows are cut from each document; what is left has a length below the window, so the histogram
of lengths is bounded whatever the corpus. Combinations of up to three lengths that fill a window are
enumerated, their repeat counts solved by non-negative least squares against the histogram, rounded,
and what remains of the histogram is packed greedily (longest first). The plan is a bounded table; each
piece finds its place by its rank among the pieces of its length, which is counted in hash buckets and
never in one task.

Defined results: a null text is empty and has only the end id; rows that repeat a doc_id are packed as
documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_arrow, cut, documents
from .tokens import ids_of

WINDOW, END = 2048, 1
#: Second lengths tried with each first length, for combinations of three.
TRIPLES, ROUNDS = 24, 400
#: About so many pieces of a length are ranked by one task.
BUCKET = 512


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to the window, from the lengths that occur."""
    has = np.zeros(window + 1, bool)
    has[lengths] = True
    rows = [[window, 0, 0]] if has[window] else []
    a = lengths[(lengths * 2 <= window)]
    a = a[has[window - a]]
    rows += np.stack([window - a, a, np.zeros_like(a)], axis=1).tolist()
    for x in lengths[lengths * 3 <= window].tolist():
        b = np.unique(np.linspace(x, (window - x) // 2, TRIPLES).astype(int))
        c = window - x - b
        ok = has[b] & has[c]
        rows += np.stack([c[ok], b[ok], np.full(int(ok.sum()), x)], axis=1).tolist()
    return np.array(rows, np.int64).reshape(-1, 3)


def repeats(combos: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """x >= 0 that brings the lengths used by x of each combination near counts, by accelerated projected gradient."""
    x = np.zeros(len(combos))
    if not len(combos):
        return x
    use = (combos > 0).astype(float)
    scale = np.maximum(counts, 1.0)
    weight = 1.0 / scale  # an error counts by its share of the length's pieces
    touched = np.bincount(combos.ravel(), use.ravel(), minlength=len(counts))
    step = 1.0 / max((weight[combos] * use * touched[combos]).sum(axis=1).max(), 1e-12)
    y, t = x.copy(), 1.0
    for _ in range(ROUNDS):
        off = (np.bincount(combos.ravel(), (use * y[:, None]).ravel(), minlength=len(counts)) - counts) * weight
        new = np.maximum(0.0, y - step * (off[combos] * use).sum(axis=1))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> dict[str, np.ndarray]:
    """Columns length, lo, hi (ranks of that length), first (sequence), mult (slots of that length a sequence), offset."""
    left = np.zeros(window + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    combos = combinations(np.flatnonzero(left), window)
    x = repeats(combos, left.astype(float))
    used, rows, first = np.zeros(window + 1, np.int64), [], 0

    def take(lengths: list[int], times: int) -> None:
        nonlocal first
        offset = 0
        for n in sorted(set(lengths), reverse=True):
            m = lengths.count(n)
            rows.append((n, used[n], used[n] + times * m, first, m, offset))
            used[n] += times * m
            left[n] -= times * m
            offset += n * m
        first += times

    for i in np.argsort(-x, kind="stable").tolist():
        lengths = [n for n in combos[i].tolist() if n]
        times = min([int(round(x[i])), *(int(left[n]) // lengths.count(n) for n in lengths)])
        if times > 0:
            take(lengths, times)
    while left.any():
        lengths, space = [], window
        here = left.copy()
        while space:
            fits = np.flatnonzero(here[: space + 1])
            if not len(fits):
                break
            n = int(fits[-1])
            m = int(min(here[n], space // n))
            lengths += [n] * m
            here[n] -= m
            space -= n * m
        take(lengths, min(int(left[n]) // lengths.count(n) for n in set(lengths)))
    order = sorted(rows)
    return {k: np.array([r[i] for r in order], np.int64) for i, k in enumerate(("length", "lo", "hi", "first", "mult", "offset"))}


def pieces(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids): whole windows of each document, then its rest."""
    bound_arrow(docs.sparkSession)
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tail = ids_of(tokenizer, True), np.array([end], "<u4")
        for batch in batches:
            rows, arrays = [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                a = np.concatenate([ids(text.as_py()), tail])
                for s in range(0, len(a), window):
                    p = a[s : s + window]
                    rows.append((d, s, len(p), zlib.crc32(p), len(a)))
                    if with_ids:
                        arrays.append(p.tolist())
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays(cols + [pa.array(arrays, pa.list_(pa.int64()))] * with_ids, names=[*names, *["ids"] * with_ids])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(cut_up, ", ".join(f"{n} long" for n in names) + ", ids array<long>" * with_ids)


def place(parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """parts (doc_id, start, length, ids_crc32, doc_tokens) with sequence_id and offset."""
    spark = parts.sparkSession
    histogram = parts.groupBy("length").count()
    found = {int(r["length"]): int(r["count"]) for r in histogram.collect()}  # at most `window` rows
    if not found:
        return parts.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    p = spark.sparkContext.broadcast(plan(found, window))
    counts = spark.createDataFrame([(n, c // BUCKET + 1) for n, c in found.items()], "n long, buckets long")
    rows = parts.join(F.broadcast(counts), F.col("length") == F.col("n")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("buckets")))
    rows = rows.drop("n", "buckets")
    sizes = rows.groupBy("length", "bucket").agg(F.count("*").alias("c"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("length").alias("l"), F.col("bucket").alias("b"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    rows = rows.join(base, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b"))).withColumn("rank", F.col("base") + rank)
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    out = (*names[:5], "sequence_id", "offset")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = p.value
        shift = 1 << 48
        keys = t["length"] * shift + t["lo"]
        for batch in batches:
            n, r = batch.column(2).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, n * shift + r, side="right") - 1
            q, slot = np.divmod(r - t["lo"][at], t["mult"][at])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(t["first"][at] + q), pa.array(t["offset"][at] + slot * n)], names=list(out))

    return rows.select(*names).mapInArrow(put, ", ".join(f"{c} long" for c in out))


def pack(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, **options) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return place(cut(pieces(docs, tokenizer, window=window, **options), "pieces"), window)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, *, window: int = WINDOW, **options) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, for documents with unique doc_ids; each is at most a window long."""
    parts = pieces(docs, tokenizer, window=window, with_ids=True, **options).select("doc_id", "start", "ids")
    at = placed.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), "sequence_id", "offset")
    got = parts.join(at, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("start") == F.col("s")))
    return got.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
