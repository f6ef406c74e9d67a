"""Mixing sources to target weights (DataFrame functions only).

Each row gets a hash-random key. Rows of a source are ordered by key; key ranges (the key's leading
digits) give buckets whose word sums, summed up over the buckets before, are the distributed prefix
sums. A source's budget is cut exactly: whole epochs first, then the rows before the cut, and the row
that the cut falls into gives the words that are still missing.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; rows that
repeat an id count as rows of their own; an empty table gives an empty result; sources without words
get target 0. Columns that are carried along can have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, cut, documents, n_words

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2.0, "mix-1"
#: Hexadecimal digits of the key that name a bucket: 4,096 key ranges in each source.
DIGITS = 3


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(src, source_size) to (src, source_size, target): one row a source.

    Weights repeat over the sources in code-point order. A target stops at cap times its source's size;
    with sources ordered by size per weight, the level at which the others share the rest is the first
    that no later source's cap undercuts.
    """
    name = Window.orderBy(F.col("src").asc_nulls_last())
    filled = Window.orderBy("full_at", F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("src", "source_size", w.alias("w")).withColumn("most", F.col("source_size") * cap)
    s = s.withColumn("full_at", F.col("most") / F.col("w"))
    s = s.select("*", F.coalesce(F.sum("most").over(filled), F.lit(0.0)).alias("given"), F.coalesce(F.sum("w").over(filled), F.lit(0.0)).alias("w_given"),
                 (F.sum("source_size").over(every) * share).alias("all_words"), F.sum("w").over(every).alias("all_w"))
    level = (F.col("all_words") - F.col("given")) / (F.col("all_w") - F.col("w_given"))
    s = s.withColumn("open", F.when(level <= F.col("full_at"), F.struct("full_at", F.col("src").isNull().alias("last"), "src", level.alias("level"))))
    s = s.withColumn("level", F.coalesce(F.min("open").over(every)["level"], F.max("full_at").over(every)))
    return s.select("src", "source_size", F.least(F.col("most"), F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS,
        share: float = SHARE, cap: float = CAP, seed: str = SEED, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs (whole passes over the source), and struct `row` of the carried columns."""
    ident = F.col(id_col)
    rows = docs.select(
        ident.alias("doc_id"), F.col(source_col).alias("src"), n_words(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))).alias("key"),
        *([F.struct(*[F.col(c) for c in carry]).alias("row")] if carry else []),
    ).withColumn("bucket", F.substring("key", 1, DIGITS))
    rows = cut(rows, "mix-rows")
    buckets = rows.groupBy("src", "bucket").agg(F.sum("size").alias("b_size"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("src", "bucket", F.coalesce(F.sum("b_size").over(before), F.lit(0)).alias("b_before"))
    goals = targets(buckets.groupBy("src").agg(F.sum("b_size").alias("source_size")), weights, share, cap)
    goals = goals.select(F.col("src").alias("g_src"), "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("budget"))
    offsets = offsets.join(goals, F.col("src").eqNullSafe(F.col("g_src"))).select(F.col("src").alias("o_src"), F.col("bucket").alias("o_bucket"), "b_before", "source_size", "target", "budget")
    at = rows.join(offsets, F.col("src").eqNullSafe(F.col("o_src")) & (F.col("bucket") == F.col("o_bucket")))
    inside = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("before", F.col("b_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(1)).cast("long")
    at = at.withColumn("epochs", epochs)
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest))
    taken = (F.col("epochs") * F.col("size") + part).cast("long")
    return at.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "epochs", *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole copy, and the cut row's leading words (joined by single spaces).

    Rows without words come as often as their source's whole epochs.
    """
    names = docs.columns
    text_col = options.get("text_col", "text")
    m = mix(docs, carry=names, **options)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.col("epochs")).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)).cast("int")
    m = m.select("row", whole.alias("whole"), part.alias("part"))
    copies = m.where("whole > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("whole"))).alias("part"))
    rest = m.where("part > 0").select("row", "part")
    words = F.filter(F.split(F.col(f"row.`{text_col}`"), WS), lambda x: x != "")
    text = F.when(F.col("part") > 0, F.concat_ws(" ", F.slice(words, 1, F.greatest("part", F.lit(1))))).otherwise(F.col(f"row.`{text_col}`"))
    return copies.unionByName(rest).select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names])


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = """
WITH d AS (SELECT doc_id, source AS src, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                  md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size,
             CAST(CASE (row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w FROM d GROUP BY src),
r AS (SELECT *, source_size * 2.0e0 AS most, source_size * 2.0e0 / w AS full_at FROM s),
f AS (SELECT *, coalesce(sum(most) OVER b, 0.0e0) AS given, coalesce(sum(w) OVER b, 0.0e0) AS w_given,
             sum(source_size) OVER () * 1.5e0 AS all_words, sum(w) OVER () AS all_w
      FROM r WINDOW b AS (ORDER BY full_at, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CASE WHEN (all_words - given) / (all_w - w_given) <= full_at THEN (all_words - given) / (all_w - w_given) END AS lev FROM f),
t AS (SELECT src, source_size, least(most, coalesce((SELECT lev FROM l WHERE lev IS NOT NULL ORDER BY full_at, src NULLS LAST LIMIT 1), max(full_at) OVER ()) * w) AS target FROM l),
b AS (SELECT *, CAST(floor(target + 0.5e0) AS BIGINT) AS budget FROM t),
e AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.budget, CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 1 END AS epochs,
             coalesce(sum(d.size) OVER (PARTITION BY d.src ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN b ON d.src IS NOT DISTINCT FROM b.src)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM e
"""
