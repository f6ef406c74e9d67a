"""Language identification by prediction by partial matching.

Per language, a tree of byte contexts (orders 0 to ORDER) holds symbol counts. A byte costs
-log2(count / (total + distinct)) in the longest context that knows it, and -log2(distinct / (total +
distinct)) for each longer known context that doesn't (escape, method C); below order 0 all 256 bytes
are alike. Statistics are frozen, and contexts begin at the space before a word, so a word's code
length is the same wherever it stands: it is found once and looked up afterwards, and a text's code
length is the exact sum over its words. The shortest code wins.

Trees are learned from a bounded sample: about `sample_chars` characters of each language. Different
texts are chosen by hash, at least one of each language; of one longer than `sample_chars`, a stretch
of that length whose place its hash gives. Every whole text is coded.

Defined results: null texts and texts without a letter give `und` with score 0, as do all texts if
there is nothing to learn from; ties go to the language first by code point; rows that repeat a doc_id
are predicted one by one.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, documents

ORDER, SAMPLE_CHARS, REMEMBERED = 4, 400_000, 300_000


def _letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Trees:
    """Context trees of all languages: context bytes to, per language, (counts by symbol, total)."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.langs, self.order = sorted(texts), order
        self.at: list[dict[bytes, dict[int, int]]] = []
        for lang in self.langs:
            words: dict[bytes, int] = defaultdict(int)
            for t in texts[lang]:
                for w in t.lower().encode().split():
                    words[w] += 1
            tree: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))
            for w, c in words.items():
                b = b" " + w + b" "
                for i in range(1, len(b)):
                    for k in range(min(order, i) + 1):
                        tree[b[i - k : i]][b[i]] += c
            self.at.append({c: dict(s) for c, s in tree.items()})

    def bits(self, context: bytes, symbol: int) -> list[float]:
        out = []
        for tree in self.at:
            cost = 0.0
            for k in range(len(context), -1, -1):
                seen = tree.get(context[len(context) - k :])
                if not seen:
                    continue
                n, d = sum(seen.values()), len(seen)
                if symbol in seen:
                    cost -= math.log2(seen[symbol] / (n + d))
                    break
                cost -= math.log2(d / (n + d))
            else:
                cost += 8.0
            out.append(cost)
        return out


class Coder:
    """Code lengths of texts, by language."""

    def __init__(self, trees: Trees):
        self.trees = trees
        self.grams: dict[bytes, np.ndarray] = {}
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((1024, len(trees.langs)))

    def word(self, w: bytes) -> np.ndarray:
        b, k, total = b" " + w + b" ", self.trees.order, np.zeros(len(self.trees.langs))
        for i in range(1, len(b)):
            g = b[max(0, i - k) : i + 1]
            v = self.grams.get(g)
            if v is None:
                if len(self.grams) >= REMEMBERED:
                    self.grams.clear()
                v = self.grams[g] = np.array(self.trees.bits(g[:-1], g[-1]))
            total += v
        return total

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().encode().split()
        if len(self.rows) + len(words) > REMEMBERED:
            self.rows.clear()
        rows = self.rows
        for w in set(words).difference(rows):
            i = rows[w] = len(rows)
            if i >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[i] = self.word(w)
        return self.table[[rows[w] for w in words]].sum(axis=0)


def learn(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Trees:
    """docs: (doc_id, text, lang) to learn from. Takes about sample_chars characters of each language."""
    h = F.xxhash64(F.lit("langid"), "text")
    d = docs.where("text is not null and lang is not null").select("lang", "text", h.alias("h"), F.length("text").alias("n"))
    # Sizes are those of different texts, so that copies neither crowd the sample nor thin it out; no text is shuffled.
    one = d.select("lang", "h", F.least("n", F.lit(sample_chars)).alias("n")).groupBy("lang", "h").agg(F.max("n").alias("n"))
    place = F.pmod(F.col("h"), F.lit(1 << 30))
    sizes = one.groupBy("lang").agg(F.sum("n").alias("all_chars"), F.min(F.struct(place, "h"))["h"].alias("least"))
    sizes = sizes.select(F.col("lang").alias("l"), "least", (F.lit(float(sample_chars)) / F.greatest("all_chars", F.lit(1)) * (1 << 30)).alias("below"))
    start = F.pmod(F.xxhash64("h"), F.greatest(F.col("n") - sample_chars, F.lit(0)) + 1).cast("int") + 1
    # One row a language, as many as there are trees on the driver.
    picked = d.join(F.broadcast(sizes), F.col("lang") == F.col("l")).where((place < F.col("below")) | (F.col("h") == F.col("least")))
    picked = picked.select("lang", "h", F.substr("text", start, F.lit(sample_chars)).alias("text")).dropDuplicates(["lang", "h"])
    texts: dict[str, list[str]] = defaultdict(list)
    for r in picked.orderBy("lang", "h").collect():  # about sample_chars a language
        texts[r["lang"]].append(r["text"])
    return Trees(texts)


def identify(docs: DataFrame, trees: Trees, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (probability of the language, all being equally likely before)."""
    spark = docs.sparkSession
    bound_arrow(spark)
    model = spark.sparkContext.broadcast(trees)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model.value)
        langs = coder.trees.langs
        for batch in batches:
            found, scores = [], []
            for text in batch.column(1):
                t = text.as_py()
                if not langs or t is None or not _letter(t):
                    found.append("und")
                    scores.append(0.0)
                    continue
                bits = coder(t)
                best = int(bits.argmin())
                found.append(langs[best])
                scores.append(float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predict, "doc_id long, lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    trees = learn(docs.where(~held).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), trees).select("doc_id", held.alias("held_out"), "lang_pred", "score")
