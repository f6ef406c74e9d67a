"""Token ids in word-aligned files (Simple-8b).

A 64-bit word holds a 4-bit selector (its top bits) and 60 bits of ids: SLOTS[s] ids of 60 // SLOTS[s]
bits each, the first id lowest. Selector ESCAPE says that the next word is one raw id. Every block of
BLOCK ids begins a new word; the word offset of each block is kept, so that any stretch is decoded from
its own blocks, a selector at a time.

Files are Parquet rows of one chunk each (whole documents, in ascending doc_id order): part, chunk,
base (ids before it in its part), doc_ids, lengths, offsets (of blocks) and the words. Spark's
committer writes them, so a lost executor leaves no half file.

Defined results: a null or empty text has only the end id; null doc_ids come first; rows that repeat a
doc_id follow each other; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_arrow, documents, shared_path
from .tokens import ids_of

#: Ids in a word, by selector.
SLOTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
BLOCK = 4096
#: A chunk ends with the document that reaches so many ids.
CHUNK = 1 << 17
END = 1


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids (unsigned, below 2**64) to (words, word offset of each block)."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    best = np.full(n, len(SLOTS) - 1, np.int8)
    room = BLOCK - np.arange(n, dtype=np.int32) % BLOCK
    for s in range(len(SLOTS) - 2, -1, -1):  # fewer and fewer starts fit more ids
        k = SLOTS[s]
        fit = ids < np.uint64(1 << 60 // k)
        have = 1
        while have < k:  # from here on so many ids fit
            more = min(have, k - have)
            fit[: max(n - more, 0)] &= fit[more:]
            fit[max(n - more, 0) :] = False
            have += more
        fit &= room >= k
        if not fit.any():
            break
        best[fit] = s
    steps = np.array(SLOTS, np.int64)[best].tolist()
    starts, i = [], 0
    add = starts.append
    while i < n:
        add(i)
        i += steps[i]
    starts = np.array(starts, np.int64)
    sel = best[starts].astype(np.int64)
    escaped = (sel == len(SLOTS) - 1) & (ids[starts] >> np.uint64(60) != 0)
    place = np.arange(len(starts)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(starts) + int(escaped.sum()), np.uint64)
    for s, k in enumerate(SLOTS):
        mine = np.flatnonzero((sel == s) & ~escaped)
        if len(mine):
            first, word = starts[mine], np.full(len(mine), s << 60, np.uint64)
            for i in range(k):
                word |= ids[first + i] << np.uint64(i * (60 // k))
            words[place[mine]] = word
    words[place[escaped]] = np.uint64(ESCAPE << 60)
    words[place[escaped] + 1] = ids[starts[escaped]]
    first = np.searchsorted(starts, np.arange(0, n, BLOCK))
    return words, place[first]


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of words that begin a block."""
    if not len(words):
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    if (sel == ESCAPE).any():  # a raw word can look like anything, so flags are settled in order
        heads, i, marks = [], 0, sel.tolist()
        while i < len(marks):
            heads.append(i)
            i += 2 if marks[i] == ESCAPE else 1
        heads = np.array(heads)
    else:
        heads = np.arange(len(words))
    sel = sel[heads]
    counts = np.array([*SLOTS, 0, 1])[sel]
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]), np.uint64)
    for s, k in enumerate(SLOTS):
        mine = np.flatnonzero(sel == s)
        if len(mine):
            bits = np.uint64(60 // k)
            got = (words[heads[mine]][:, None] >> (np.arange(k, dtype=np.uint64) * bits)) & np.uint64((1 << (60 // k)) - 1)
            out[(ends[mine] - k)[:, None] + np.arange(k)] = got
    mine = np.flatnonzero(sel == ESCAPE)
    out[ends[mine] - 1] = words[heads[mine] + 1]
    return out


def decode_range(words: np.ndarray, offsets: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a chunk, from their own blocks only."""
    if start >= stop:
        return np.zeros(0, np.uint64)
    a, b = start // BLOCK, (stop - 1) // BLOCK
    end = offsets[b + 1] if b + 1 < len(offsets) else len(words)
    return decode(words[offsets[a] : end])[start - a * BLOCK : stop - a * BLOCK]


_SCHEMA = "part int, chunk int, base long, n_ids long, doc_ids array<long>, lengths array<long>, offsets array<long>, words binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str, *, keeps_space: bool = False, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    spark = docs.sparkSession
    bound_arrow(spark)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, chunk, base = ids_of(tokenizer, keeps_space), TaskContext.get().partitionId(), 0, 0
        names, arrays, held = [], [], 0
        tail = np.array([end], "<u4")

        def out():
            nonlocal chunk, base, names, arrays, held
            flat = np.concatenate(arrays)
            words, offsets = encode(flat)
            row = {"part": part, "chunk": chunk, "base": base, "n_ids": len(flat), "doc_ids": names, "lengths": [len(a) for a in arrays], "offsets": offsets.tolist(), "words": words.astype("<u8").tobytes()}
            chunk, base, names, arrays, held = chunk + 1, base + len(flat), [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_arrow)

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                a = np.concatenate([ids(text.as_py()), tail])
                names.append(d)
                arrays.append(a)
                held += len(a)
                if held >= CHUNK:
                    yield out()
        if names:
            yield out()

    _arrow = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("base", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("words", pa.binary())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(chunks, _SCHEMA).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of each document, decoded from the files."""
    rows = spark.read.schema(_SCHEMA).parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))  # a row for each file part
    rows = rows.join(parts, F.col("part") == F.col("p")).select((F.col("part_start") + F.col("base")).alias("start"), "doc_ids", "lengths", "offsets", "words")
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.uint32()))] * with_ids
    arrow = pa.schema([(k, pa.list_(pa.int64()) if k == "ids" else t) for k, t in kinds])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, docs, lengths, offsets, words in zip(*(batch.column(i) for i in range(5))):
                flat = decode(np.frombuffer(words.as_buffer(), "<u8")).astype("<u4")
                lengths = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(lengths)
                cuts = [flat[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]
                cols = [docs.values, pa.array(start.as_py() + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(c) for c in cuts], pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), flat.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op3_token_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "ids")
    write_ids(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(spark, path, with_ids=False)
