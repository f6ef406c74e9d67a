"""Language-model scores from a subword lattice.

A word is spelled by pieces of an existing vocabulary, its first piece bearing the word mark. All
segmentations count: the forward recursion, in log space, adds their probabilities up. The vocabulary's
own scores, frozen, weigh the pieces (they are ranks, so piece r has a share in proportion to
1 / (r + 50)). A text's probability is the product over its words and its end, whose share is that of
ends among the training tokens. If asked for, `passes` of expectation maximisation over all distinct
training words bring the scores to the corpus, and `whole_words` adds an arc over the whole word that
has the word's own training count; pieces then spell the words that weren't met before, and each distinct
training word counts once in a pass. The query asks for both, with one pass, in which the vocabulary's
scores weigh all segmentations of the training words.

Distinct words are counted with partial sums, scored once, and brought back to the documents: words
that make up at least one part in HOT of all tokens (so at most HOT words) by broadcast, all others by
a join on their hash. Words that share a hash go with the first kind.

Defined results: a null text is empty and has only its end; a null doc_id is in training; rows that
repeat a doc_id are scored one by one; if training is empty, all counts are 0 and words are spelled.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, cut, documents

HOT, FLUSH, PRIOR, MARK = 1 << 16, 400_000, 200.0, "▁"
_MULTIPLY, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LOG10 = math.log(10)


def _hash(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


class Pieces:
    """A vocabulary's pieces, found by a rolling hash of their code points."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int]):
        self.texts = [t for t, _ in pieces]
        rank = np.array([-s for _, s in pieces], float)
        p = 1.0 / (rank - rank.min() + 50.0)
        self.logp = np.log(p / p.sum())
        self.byte_ids = np.array(byte_ids)
        spelled = [i for i in range(len(pieces)) if i not in set(byte_ids)]
        self.most = max(len(self.texts[i]) for i in spelled)
        h = np.array([self._of(self.texts[i]) for i in spelled], np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.index = h[order], np.array(spelled)[order]
        self.bits = 22
        slot = self._slot(self.hashes)
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.table[slot] = np.arange(len(slot))
        self.crowded = bool((self.table[slot] != np.arange(len(slot))).any())

    @staticmethod
    def _of(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_MULTIPLY) + ord(c) + 1) % (1 << 64)
        return h

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (((h ^ (h >> np.uint64(29))) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 for none."""
        at = self.table[self._slot(h)]
        hit = (at >= 0) & (self.hashes[at] == h)
        out = np.where(hit, self.index[at], -1)
        if self.crowded:
            miss = np.flatnonzero(~hit & (at >= 0))
            if len(miss):
                k = np.minimum(np.searchsorted(self.hashes, h[miss]), len(self.hashes) - 1)
                out[miss] = np.where(self.hashes[k] == h[miss], self.index[k], -1)
        return out

    def arcs(self, cps: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) over words of one length, given as rows of code points."""
        n, length = cps.shape
        points = cps.astype(np.uint64) + np.uint64(1)
        for j in range(length):
            h = np.zeros(n, np.uint64)
            for e in range(j + 1, min(length, j + self.most) + 1):
                h = h * _MULTIPLY + points[:, e - 1]
                piece = self.find(h)
                rows = np.flatnonzero(piece >= 0)
                if len(rows):
                    yield j, e, rows, piece[rows]
                if e == j + 1 and len(rows) < n:  # characters that are no piece are spelled by bytes
                    yield j, e, np.flatnonzero(piece < 0), np.full(n - len(rows), -1)

    def byte_cost(self, cps: np.ndarray, logp: np.ndarray) -> np.ndarray:
        by_byte = logp[self.byte_ids]
        found, where = np.unique(cps, return_inverse=True)
        return np.array([by_byte[list(chr(c).encode("utf-8", "surrogatepass"))].sum() for c in found.tolist()])[where]

    def forward(self, cps: np.ndarray, logp: np.ndarray, counts: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each row; adds expected piece counts, times the rows' weights, to counts."""
        n, length = cps.shape
        arcs, kept = self.arcs(cps), []
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0.0
        for j, e, rows, piece in arcs:
            lp = logp[piece] if piece[0] >= 0 else self.byte_cost(cps[rows, j], logp)
            if counts is not None:
                kept.append((j, e, rows, piece, lp))
            alpha[e, rows] = np.logaddexp(alpha[e, rows], alpha[j, rows] + lp)
        if counts is not None:
            beta = np.full((length + 1, n), -np.inf)
            beta[length] = 0.0
            for j, e, rows, piece, lp in reversed(kept):
                b = beta[e, rows] + lp
                beta[j, rows] = np.logaddexp(beta[j, rows], b)
                got = np.exp(alpha[j, rows] + b - alpha[length, rows]) * weight[rows]
                if piece[0] >= 0:
                    counts += np.bincount(piece, got, minlength=len(counts))
        return alpha[length]

    def words(self, words: list[bytes], logp: np.ndarray, counts: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
        out, by_length = np.zeros(len(words)), defaultdict(list)
        texts = [MARK + w.decode("utf-8", "replace") for w in words]
        for i, t in enumerate(texts):
            by_length[len(t)].append(i)
        for length, at in by_length.items():
            for k in range(0, len(at), step := max(1, 400_000 // length)):
                some = np.array(at[k : k + step])
                cps = np.frombuffer("".join([texts[i] for i in some]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(some), length)
                out[some] = self.forward(cps, logp, counts, None if weight is None else weight[some])
        return out


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Batches of about so many rows: words of one length are worked on together."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def vocabulary(path: str) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    use = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]
    pieces = [(sp.id_to_piece(i), sp.get_score(i) if not sp.is_byte(i) else -float(len(use))) for i in use]
    return Pieces(pieces, [k for k, i in enumerate(use) if sp.is_byte(i)])


def word_counts(docs: DataFrame, learns: Column) -> DataFrame:
    """word (bytes), n_train, n_all; the words are lower-cased in A-Z."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def out():
            cols = list(zip(*seen.values())) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], names=["word", "n_train", "n_all"])

        for batch in batches:
            for text, train in zip(batch.column(0), batch.column(1).to_pylist()):
                t = int(train)
                for w in text.as_buffer().to_pybytes().lower().split():
                    c = seen.get(w)
                    if c is None:
                        seen[w] = [t, 1]
                    else:
                        c[0] += t
                        c[1] += 1
            if len(seen) >= FLUSH:
                yield out()
                seen.clear()
        yield out()

    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), learns.alias("train"))
    return rows.mapInArrow(count, "word binary, n_train long, n_all long").groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def expected(counts: DataFrame, pieces: Pieces, once: bool = False) -> np.ndarray:
    """Expected piece counts over all training words (once: distinct ones); one vector a task, added up by position."""
    shared = counts.sparkSession.sparkContext.broadcast(pieces)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        total = np.zeros(len(p.texts))
        for batch in _gathered(batches):
            p.words(batch.column(0).to_pylist(), p.logp, total, batch.column(1).to_numpy(zero_copy_only=False).astype(float))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

    times = F.lit(1).cast("long").alias("n_train") if once else F.col("n_train")
    got = counts.where("n_train > 0").select("word", times).mapInArrow(add, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # at most a row a piece
    out = np.zeros(len(pieces.texts))
    for r in got:
        out[r["piece"]] = r["n"]
    return out


def lattice_score(docs: DataFrame, learns: Column, vocabulary_path: str, *, passes: int = 0, whole_words: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, learned (from), n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    bound_arrow(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), learns.alias("train"))
    counts = cut(word_counts(d, F.col("train")), "words")
    ends = d.where("train").count()
    t = counts.agg(F.sum("n_train"), F.sum((F.col("n_train") > 0).cast("long")), F.sum("n_all")).first()
    n, v = (t[0] or 0) + ends, (t[1] or 0) + (ends > 0)
    pieces = vocabulary(vocabulary_path)
    prior = np.exp(pieces.logp)
    for _ in range(passes):
        e = expected(counts, pieces, whole_words)
        pieces.logp = np.log((e + PRIOR * prior) / (e.sum() + PRIOR))
    shared = spark.sparkContext.broadcast(pieces)
    known = n / (n + v) if n and whole_words else 0.0  # Witten-Bell: the share of words that were met before
    p_end = (ends + 1) / (n + 2)  # each token is the end or a word
    log_word = math.log1p(-p_end)
    log_known, log_new = (math.log(known) if known else -math.inf), math.log(1 - known)
    base = lambda c: math.log10((c + 1) / (n + v + 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in _gathered(batches):
            words = batch.column(0).to_pylist()
            c = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            with np.errstate(divide="ignore"):
                whole = log_known + np.log(c / max(n - ends, 1)) if known else np.full(len(c), -np.inf)
            s = (log_word + np.logaddexp(whole, log_new + p.words(words, p.logp))) / _LOG10
            b = np.log10((c + 1) / (n + v + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_hash(w) for w in words], pa.int64()), pa.array((c > 0).astype(np.int64)), batch.column(2), pa.array(b), pa.array(s)], names=["word", "h", "known", "n_all", "b", "s"])

    table = cut(counts.select("word", "n_train", "n_all").mapInArrow(scored, "word binary, h long, known long, n_all long, b double, s double"), "scores")
    twins = table.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    often = table.where(F.col("n_all") >= max((t[2] or 0) / HOT, 2))
    hot_rows = often.unionByName(table.join(twins, "h", "left_semi")).select("word", "known", "b", "s").collect()  # at most HOT, and words that share a hash
    hot = spark.sparkContext.broadcast({bytes(r["word"]): (r["known"], r["b"], r["s"]) for r in hot_rows})
    end = (1 if ends else 0, base(ends), math.log10(p_end))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, uid = hot.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths, keys, times, first = [], [], [], []
            for text, doc, train in zip(batch.column(1), batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                words = text.as_buffer().to_pybytes().lower().split()
                k, b, s, rare = *end, {}
                for w in words:
                    x = table.get(w)
                    if x is None:
                        rare[w] = rare.get(w, 0) + 1
                    else:
                        k += x[0]
                        b += x[1]
                        s += x[2]
                lengths.append(max(len(rare), 1))
                keys += [_hash(w) for w in rare] or [None]
                times += rare.values() if rare else [0]
                first.append((uid, doc, train, len(words) + 1, k, b, s))
                uid += 1
            lengths = np.array(lengths, np.int64)
            heads = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
            cols = list(zip(*first)) or [()] * 7
            ids = np.repeat(np.array(cols[0], np.int64), lengths)
            sparse = np.full(len(ids), -1, np.int64)
            sparse[heads] = np.arange(len(heads))
            at = pa.array(sparse, mask=sparse < 0)
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys, pa.int64()), pa.array(times, pa.int32()), *(pa.array(c, k).take(at) for c, k in zip(cols[1:], kinds))], names=["uid", "h", "n", "doc_id", "train", "n_tokens", "k", "b", "s"])

    rows = d.mapInArrow(split, "uid long, h long, n int, doc_id long, train boolean, n_tokens long, k long, b double, s double")
    rare = table.where(F.col("n_all") < max((t[2] or 0) / HOT, 2)).select(F.col("h").alias("w_h"), F.col("known").alias("w_k"), F.col("b").alias("w_b"), F.col("s").alias("w_s"))
    zero = lambda a, x: F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col("n") * F.col(x), F.lit(0))
    got = rows.join(rare, F.col("h") == F.col("w_h"), "left").groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("train").alias("learned"), F.max("n_tokens").alias("n_tokens"),
        F.sum(zero("k", "w_k")).alias("n_known"), F.sum(zero("b", "w_b")).alias("base_score"), F.sum(zero("s", "w_s")).alias("score"))
    return got.select("doc_id", "learned", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lattice_scores(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    got = lattice_score(documents(spark, sf_dir), ~held, public_tokenizers.path("piece_bpe_32k.model"), passes=1, whole_words=True)
    return got.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
