"""Quality classifier by co-training.

Two views of a document: its text (words that occur, and the shape of the text) and its metadata
(language, source, length). A logistic regression for each view is trained on labelled documents; over
ROUNDS rounds, each view scores all other documents and hands those of which it is confident, with its
verdict, to the other view. Confidence is the probability calibrated on labelled documents kept aside,
so that a view that knows nothing hands over nothing. The calibrated views are combined by a last
logistic regression, and all documents are scored by it. The same is done for toxicity; a document is
rejected if its quality is unlikely or its toxicity likely.

Lessons stay on the executors: of the documents that one view is sure of, each task adds up the
features that the other view reads, by verdict and by what the other view thinks of them now (BINS).
The sums' means, weighted by their documents, are training rows, so a round brings to the driver at
most a number for each feature, verdict and bin. All lessons together weigh LESSONS of the labelled
documents if every document is one, at every size.

Labelled documents are a bounded sample, taken by hash of the doc_id: `labelled` of them. All other
documents, those with further labels too, count as unlabelled; every one of them takes part in every
round. Features that fewer than MIN_DOCS labelled documents have are not read. Every whole text is
scored.

Defined results: null texts count as empty; null metadata are values of their own; several labels of a
document give the lower quality and the higher toxicity; without both classes among the labels, scores
are 0.5 and nothing is rejected on that account; rows that repeat a doc_id are scored one by one, and
the one whose text has the least hash learns the label.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, cut, documents

LABELLED, ROUNDS, CONFIDENT, MIN_DOCS, LESSONS = 8000, 3, 0.97, 3, 0.25
#: Bounds of a view's score (log odds) that part its lessons.
BINS = (-2.0, 0.0, 2.0)
#: Sums of features are whole numbers of this part, so that they don't depend on their order.
UNIT = 1 << 20
WORD_VALUE, SHAPE_VALUE = 0.3, 3.0
REJECT_QUALITY, REJECT_TOXIC = 0.5, 0.4
_UPPER, _DIGITS, _SYMBOLS = string.ascii_uppercase.encode(), string.digits.encode(), b"#*$%&|<>@^~=_+{}[]\\"
_bare = re.compile(rb"[^\W_]+|[^\x00-\x7f]+").findall


def words_of(text: str) -> set[bytes]:
    return set(_bare(text.lower().encode()))


def shape(text: str) -> list[float]:
    """Rates that need no words: capitals, digits, symbols, exclamation marks, repeated words and lines, word length."""
    b = text.encode()
    words, lines = b.split(), [x for x in b.split(b"\n") if x.strip()]
    n, letters = max(len(words), 1), max(sum(map(len, words)), 1)
    without = lambda chars: (len(b) - len(b.translate(None, chars))) / letters
    return [min(1.0, 5 * without(_UPPER)), min(1.0, 10 * without(_DIGITS)), min(1.0, 10 * without(_SYMBOLS)), min(1.0, 10 * without(b"!")), min(1.0, 10 * without(b"?;:")),
            1 - len(set(words)) / n, 1 - len(set(lines)) / max(len(lines), 1), min(2.0, letters / n / 8), 1.0 if len(words) < 5 else 0.0, min(1.0, n / len(lines) / 400) if lines else 0.0, min(1.0, len(b) and text.count("http") * 50 / letters)]


def about(lang: str | None, source: str | None, n_chars: int | None) -> list[str]:
    size = "none" if n_chars is None else str(max(int(n_chars), 0).bit_length())
    return [f"lang={lang}", f"source={source}", f"size={size}", f"lang={lang}&size={size}"]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Rows:
    """Sparse rows: row numbers, feature numbers, and values."""

    def __init__(self, at: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, width: int):
        self.at, self.col, self.val, self.n, self.width = at.astype(np.int32), col.astype(np.int32), val.astype(np.float32), n, width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.val * w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.at], minlength=self.width)

    def under(self, other: "Rows") -> "Rows":
        return Rows(*(np.concatenate([getattr(self, k), getattr(other, k) + (self.n if k == "at" else 0)]) for k in ("at", "col", "val")), self.n + other.n, self.width)


def logistic(x: Rows, y: np.ndarray, weight: np.ndarray, l2: float, start: np.ndarray | None = None, steps: int = 150) -> np.ndarray:
    """Weights, the last one the bias; full-batch steps scaled per feature."""
    w, b, g2, gb2 = np.zeros(x.width), 0.0, np.full(x.width, 1e-8), 1e-8
    if start is not None:
        w, b = start[:-1].copy(), float(start[-1])
    total = max(weight.sum(), 1e-9)
    for _ in range(steps):
        off = (_sigmoid(x.dot(w) + b) - y) * weight / total
        g, gb = x.back(off) + l2 * w / total, off.sum()
        g2 += g * g
        gb2 += gb * gb
        w -= 0.3 * g / np.sqrt(g2)
        b -= 0.3 * gb / np.sqrt(gb2)
    return np.append(w, b)


def platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b so that sigmoid(a * s + b) fits y; a is not below 0."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * s + b)
        g, h = np.array([((p - y) * s).sum() + 0.1 * (a - 1), (p - y).sum()]), p * (1 - p) + 1e-6
        m = np.array([[(h * s * s).sum() + 0.1, (h * s).sum()], [(h * s).sum(), h.sum()]])
        step = np.linalg.solve(m, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return max(a, 0.0), b


class Views:
    """Feature numbers of both views, fixed by the labelled documents."""

    def __init__(self, words: list[bytes], values: list[str]):
        self.words = {w: i for i, w in enumerate(sorted(words))}
        self.values = {v: i for i, v in enumerate(sorted(values))}
        self.n_shape = len(shape(""))
        self.widths = len(self.words) + self.n_shape, len(self.values)

    def content(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at = [self.words[w] for w in words_of(text) & self.words.keys()]
        s = shape(text)
        return np.array(at + list(range(len(self.words), self.widths[0])), np.int32), np.array([WORD_VALUE] * len(at) + [SHAPE_VALUE * v for v in s])

    def meta(self, m: tuple) -> tuple[np.ndarray, np.ndarray]:
        at = [self.values[v] for v in about(*m) if v in self.values]
        return np.array(at, np.int32), np.ones(len(at))

    def rows(self, words: pa.ListArray, shapes: np.ndarray, values: pa.ListArray) -> tuple[Rows, Rows]:
        """Both views of documents, from the numbers of their words and values, and their shapes."""
        n = len(shapes)
        at = lambda x: np.repeat(np.arange(n), x.value_lengths().to_numpy(zero_copy_only=False))
        flat = lambda x: x.flatten().to_numpy(zero_copy_only=False)
        col = np.concatenate([flat(words), np.tile(np.arange(len(self.words), self.widths[0]), n)])
        val = np.concatenate([np.full(len(col) - shapes.size, WORD_VALUE), SHAPE_VALUE * shapes.ravel()])
        return Rows(np.concatenate([at(words), np.repeat(np.arange(n), self.n_shape)]), col, val, n, self.widths[0]), Rows(at(values), flat(values), np.ones(len(flat(values))), n, self.widths[1])


class CoTrained:
    """One target: weights of both views, their calibrations, and how they combine."""

    def __init__(self, y: np.ndarray):
        self.known = bool(0 < y.sum() < len(y))
        self.w, self.cal = [None, None], [(0.0, 0.0)] * 2

    def train(self, x: tuple[Rows, Rows], y: np.ndarray, lessons: list | None = None) -> None:
        """Views anew, from labelled documents and each view's lessons (rows, verdicts, weights)."""
        if not self.known:
            return
        aside = np.arange(len(y)) % 4 == 3
        for v, l2 in enumerate((1.0, 3.0)):
            rows, yy, use = x[v], y, (~aside).astype(float)
            if lessons:
                more, verdicts, weights = lessons[v]
                rows, yy, use = rows.under(more), np.concatenate([yy, verdicts]), np.concatenate([use, weights])
            self.w[v] = logistic(rows, yy, use, l2, self.w[v], 60 if lessons else 150)
            self.cal[v] = platt((x[v].dot(self.w[v][:-1]) + self.w[v][-1])[aside], y[aside])

    def scores(self, x: tuple[Rows, Rows]) -> list[np.ndarray]:
        return [a * (r.dot(w[:-1]) + w[-1]) + b for r, w, (a, b) in zip(x, self.w, self.cal)]

    def combine(self, x: tuple[Rows, Rows], y: np.ndarray) -> None:
        if not self.known:
            return
        aside = np.arange(len(y)) % 4 == 3
        s = [v[aside] for v in self.scores(x)]
        self.prior = np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
        n = len(s[0])
        both = Rows(np.repeat(np.arange(n), 2), np.tile([0, 1], n), np.stack([s[0], s[1] - self.prior], axis=1).ravel(), n, 2)
        mix = logistic(both, y[aside].astype(float), np.ones(n), 1.0)
        self.mix = np.maximum(mix[:2], 0), mix[2]

    def __call__(self, content: tuple, meta: tuple) -> float:
        if not self.known:
            return 0.5
        s = [a * ((v[1] * w[v[0]]).sum() + w[-1]) + b for (a, b), w, v in zip(self.cal, self.w, (content, meta))]
        return float(_sigmoid(self.mix[0][0] * s[0] + self.mix[0][1] * (s[1] - self.prior) + self.mix[1]))


def _cast() -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars")]


def _needed(docs: DataFrame) -> DataFrame:
    return docs.select(*_cast())


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, pa.Table]:
    """The ids of the sample, and what its documents are: words, shape, values, quality, toxic."""
    one = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    picked = one.orderBy(F.xxhash64(F.lit("co-training"), "doc_id"), "doc_id").limit(most)
    columns = ["text", "lang", "source", "n_chars"]
    rows = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), *columns)).alias("x"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(3)]
            metas = zip(*(batch.column(i).to_pylist() for i in (4, 5, 6)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(q > 0) for q in batch.column(1).to_pylist()]), pa.array([float(t > 0) for t in batch.column(2).to_pylist()]),
                                              pa.array([sorted(words_of(t)) for t in texts], pa.list_(pa.binary())), pa.array([shape(t) for t in texts], pa.list_(pa.float64())), pa.array([about(*m) for m in metas], pa.list_(pa.string()))],
                                             names=["doc_id", "quality", "toxic", "words", "shape", "values"])

    got = rows.select("doc_id", "quality", "toxic", *[f"x.{c}" for c in columns]).mapInArrow(read, "doc_id long, quality double, toxic double, words array<binary>, shape array<double>, values array<string>")
    return picked.select("doc_id"), got.toArrow().sort_by("doc_id").combine_chunks()  # at most `most` documents


def _numbered(lists: pa.ChunkedArray, number: dict) -> pa.ListArray:
    """Lists of words as lists of their numbers, without those that have none."""
    whole = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    coded = whole.flatten().dictionary_encode()
    of = np.fromiter((number.get(w.as_py(), -1) for w in coded.dictionary), np.int64, len(coded.dictionary))
    col = of[coded.indices.to_numpy()] if len(of) else np.zeros(0, np.int64)
    at = np.repeat(np.arange(len(whole)), whole.value_lengths().to_numpy(zero_copy_only=False))[col >= 0]
    ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(whole)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(col[col >= 0], pa.int32()))


def _frequent(lists: pa.ChunkedArray) -> list:
    if not len(lists):
        return []
    counted = pa.compute.value_counts(pa.compute.list_flatten(lists))
    return counted.field("values").filter(pa.compute.greater_equal(counted.field("counts"), MIN_DOCS)).to_pylist()  # rare ones, which are most, are no objects


def features(docs: DataFrame, views: Views) -> DataFrame:
    """words, shape, values: of each row the numbers of what views know, and its shape."""
    shared = docs.sparkSession.sparkContext.broadcast(views)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = shared.value
        for batch in batches:
            words, shapes = [], []
            for text in batch.column(1):
                t = text.as_py()
                words.append(sorted(views.words[w] for w in words_of(t) & views.words.keys()))
                shapes.append(shape(t))
            values = [sorted(views.meta(m)[0].tolist()) for m in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int32())), pa.array(shapes, pa.list_(pa.float32())), pa.array(values, pa.list_(pa.int32()))], names=["words", "shape", "values"])

    return docs.mapInArrow(read, "words array<int>, shape array<float>, values array<int>")


def lessons(table: DataFrame, views: Views, targets: list[CoTrained]) -> list[list[tuple[Rows, np.ndarray, np.ndarray]]]:
    """For each target and view: mean rows of what the other view is sure of, verdicts, and numbers of documents."""
    shared = table.sparkSession.sparkContext.broadcast((views, targets))
    n_bins = len(BINS) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, targets = shared.value
        # The last column of a sum counts documents.
        sums = {(t, v): np.zeros((2 * n_bins, views.widths[v] + 1), np.int64) for t in range(len(targets)) for v in (0, 1) if targets[t].known}
        for batch in batches:
            shapes = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, views.n_shape)
            x = views.rows(batch.column(0), shapes, batch.column(2))
            whole = [np.rint(r.val.astype(float) * UNIT).astype(np.int64) for r in x]
            for t, target in enumerate(targets):
                if not target.known:
                    continue
                s = target.scores(x)
                for v in (0, 1):
                    p = _sigmoid(s[1 - v])
                    sure = (p >= CONFIDENT) | (p <= 1 - CONFIDENT)
                    group = (p > 0.5) * n_bins + np.digitize(s[v], BINS)
                    keep = sure[x[v].at]
                    np.add.at(sums[t, v], (group[x[v].at[keep]], x[v].col[keep]), whole[v][keep])
                    np.add.at(sums[t, v], (group[sure], views.widths[v]), 1)
        for (t, v), m in sums.items():
            g, f = np.nonzero(m)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), t), pa.int32()), pa.array(np.full(len(g), v), pa.int32()), pa.array(g, pa.int32()), pa.array(f, pa.int32()), pa.array(m[g, f], pa.int64())], names=["t", "v", "g", "f", "n"])

    got = table.mapInArrow(add, "t int, v int, g int, f int, n long").groupBy("t", "v", "g", "f").agg(F.sum(F.col("n").cast("double")).alias("n")).toArrow()  # a number for each feature, verdict and bin
    t, v, g, f, n = (got.column(c).to_numpy() for c in ("t", "v", "g", "f", "n"))
    out = []
    for k in range(len(targets)):
        out.append([])
        for view, width in enumerate(views.widths):
            mine = (t == k) & (v == view)
            order = np.lexsort((f[mine], g[mine]))
            gg, ff, nn = g[mine][order], f[mine][order], n[mine][order]
            docs = np.zeros(2 * n_bins)
            docs[gg[ff == width]] = nn[ff == width]
            at = ff < width
            rows = Rows(gg[at], ff[at], nn[at] / UNIT / docs[gg[at]], 2 * n_bins, width)
            out[-1].append((rows, (np.arange(2 * n_bins) >= n_bins).astype(float), docs))
    return out


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> tuple[Views, CoTrained, CoTrained]:
    bound_arrow(docs.sparkSession)
    d = _needed(docs)
    picked, got = _labelled(d, labels, labelled)
    views = Views(_frequent(got["words"]), _frequent(got["values"]))
    shapes = np.array(got["shape"].to_pylist(), float).reshape(len(got), views.n_shape)
    x = views.rows(_numbered(got["words"], views.words), shapes, _numbered(got["values"], views.values))
    given = [got["quality"].to_numpy(), got["toxic"].to_numpy()]
    del got, shapes  # the driver holds the sample's words no longer than until they are numbered
    pa.default_memory_pool().release_unused()
    targets = [CoTrained(y) for y in given]
    for target, y in zip(targets, given):
        target.train(x, y)
    if any(t.known for t in targets):
        rest = cut(features(d.join(F.broadcast(picked), "doc_id", "left_anti"), views), "features")
        n = max(rest.count(), 1)
        for _ in range(rounds):
            taught = lessons(rest, views, targets)
            for target, y, mine in zip(targets, given, taught):
                target.train(x, y, [(rows, verdicts, LESSONS * len(y) * docs / n) for rows, verdicts, docs in mine])
    for target, y in zip(targets, given):
        target.combine(x, y)
    return views, *targets


def score(docs: DataFrame, model: tuple[Views, CoTrained, CoTrained], carry: bool = False) -> DataFrame:
    """doc_id, quality, toxic (probabilities), kept; if carry, the struct `doc` of the row's columns too."""
    spark = docs.sparkSession
    bound_arrow(spark)
    shared = spark.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, quality, toxic = shared.value
        for batch in batches:
            q, t = [], []
            for text, *m in zip(batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3, 4))):
                c, v = views.content(text.as_py()), views.meta(tuple(m))
                q.append(quality(c, v))
                t.append(toxic(c, v))
            kept = [(not quality.known or a >= REJECT_QUALITY) and (not toxic.known or b <= REJECT_TOXIC) for a, b in zip(q, t)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(q, pa.float64()), pa.array(t, pa.float64()), pa.array(kept, pa.bool_()), *([batch.column(5)] if carry else [])], names=names)

    names = ["doc_id", "quality", "toxic", "kept", *["doc"] * carry]
    rows = _needed(docs)
    out = "doc_id long, quality double, toxic double, kept boolean"
    if carry:
        whole = F.struct(*[F.col(c) for c in docs.columns]).alias("doc")
        rows = docs.select(whole).select("doc.*", "doc").select(*_cast(), "doc")
        out += f", doc {docs.select(whole).schema['doc'].dataType.simpleString()}"
    return rows.mapInArrow(rate, out)


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected."""
    return score(docs, fit(docs, labels), carry=True).where("kept").select("doc.*")


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
