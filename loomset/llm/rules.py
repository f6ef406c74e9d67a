"""Quality rules with adaptive thresholds (DataFrame functions only).

Counts of each text are made in place, without a shuffle of words: five-word windows are hashed into
an array of the row, and only rows in which a hash repeats sort it to find the words covered. For each
language and source, mergeable quantile sketches of the rates give fences for each rate; they
replace fixed cutoffs and are joined back to filter. Groups under `min_group` rows use their
language's sketch, and languages under it the sketch of all rows.

Defined results: a null text has no words and fails; null languages and sources are groups of their
own; an empty table gives no rows; rows that repeat a doc_id are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, cut, documents

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rates whose fences stand around the median by SPREAD times the smaller gap to a quartile (so that up to a quarter of bad rows
#: moves nothing), plus a slack: that below the median (None: no fence there) and that above.
MIDDLES = {"symbol_rate": (None, 0.02), "upper_rate": (None, 0.1), "word_length": (1.2, 1.2)}
#: Rates that are 0 for most rows: the 0.98 quantile of rows that pass the fixed rules, plus its gap from the median, plus a slack.
TAILS = {"dup_line_rate": 0.1, "repeat_rate": 0.08}
SPREAD, QUARTILES, FAR = 6.0, [0.25, 0.5, 0.75], [0.5, 0.98]
#: Fences of more groups than this are joined by shuffle, each group's rows dealt over SALTS tasks.
FEW_GROUPS, SALTS = 100_000, 64
MIN_GROUP, ACCURACY, MIN_WORDS, MAX_REPEAT_PERCENT = 50, 1000, 10, 20


def _gone(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper of the whole text."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    inner = F.trim(F.col("t"), F.lit(SPACE))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WS))
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    d = d.select("doc_id", "lang", "source", (F.length("t") - _gone(F.col("t"), SPACE)).cast("long").alias("word_chars"), _gone(F.col("t"), SYMBOLS).alias("n_symbols"), _gone(F.col("t"), UPPER).alias("n_upper"),
                 lines.alias("lines"), F.transform(words, lambda w: F.xxhash64(w)).alias("h"))
    kept = ["doc_id", "lang", "source", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_words"]
    d = d.withColumns({"n_lines": F.size("lines").cast("long"), "n_words": F.size("h").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")})
    # A window's hash is made of its words' hashes.
    grams = F.when(F.col("n_words") >= 5, F.transform(F.slice("h", 1, F.greatest(F.col("n_words") - 4, F.lit(0)).cast("int")), lambda x, i: F.xxhash64(x, *[F.get(F.col("h"), i + k) for k in range(1, 5)])))
    d = d.select(*kept, F.coalesce(grams, F.array().cast("array<bigint>")).alias("g"))
    twice = F.size(F.array_distinct("g")) < F.size("g")
    d = d.select(*kept, F.when(twice, F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"))
    same = lambda x, i, k: F.coalesce(F.get(F.col("s"), i + k)["x"] == x["x"], F.lit(False))
    hits = F.filter("s", lambda x, i: same(x, i, 1) | ((i > 0) & same(x, i, -1)))
    d = d.select(*kept, F.sort_array(F.transform(hits, lambda x: x["i"])).alias("p"))
    spans = F.transform("p", lambda x, i: F.least(F.lit(5), F.coalesce(F.get(F.col("p"), i + 1) - x, F.lit(5))))
    return d.select(*kept, F.coalesce(F.aggregate(spans, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))


def _rates(c: DataFrame) -> DataFrame:
    n, chars, lines = (F.greatest(F.col(x), F.lit(1)).cast("double") for x in ("n_words", "word_chars", "n_lines"))
    return c.withColumns({"symbol_rate": F.col("n_symbols") / chars, "upper_rate": F.col("n_upper") / chars, "dup_line_rate": F.col("n_dup_lines") / lines, "repeat_rate": F.col("n_repeat_words") / n, "word_length": F.col("word_chars") / n})


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _sketches(c: DataFrame, by: list[str], tag: str) -> DataFrame:
    q = [F.percentile_approx(r, QUARTILES, ACCURACY).alias(f"{r}_{tag}") for r in MIDDLES]
    q += [F.percentile_approx(F.when(~_base_failed(), F.col(r)), FAR, ACCURACY).alias(f"{r}_{tag}") for r in TAILS]
    return c.groupBy(*by).agg(F.count("*").alias(f"rows_{tag}"), *q)


def judge(c: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Counts with fences, base_failed and kept; fences come from all rows of c that have MIN_WORDS."""
    c = cut(_rates(c), "rates")
    usual = c.where(f"n_words >= {MIN_WORDS}")
    by_source = _sketches(usual, ["lang", "source"], "g").withColumnsRenamed({"lang": "lang_g", "source": "source_g"})
    by_lang = _sketches(usual, ["lang"], "l").withColumnsRenamed({"lang": "lang_l"})
    fences = by_source.join(by_lang, F.col("lang_g").eqNullSafe(F.col("lang_l"))).crossJoin(F.broadcast(_sketches(usual, [], "a")))  # one row
    pick = lambda r: F.when(F.col("rows_g") >= min_group, F.col(f"{r}_g")).when(F.col("rows_l") >= min_group, F.col(f"{r}_l")).otherwise(F.col(f"{r}_a"))
    picked = {}
    for r, (below, above) in MIDDLES.items():
        q = pick(r)
        gap = SPREAD * F.least(q[1] - q[0], q[2] - q[1])
        picked[f"{r}_most"] = q[1] + gap + above
        if below is not None:
            picked[f"{r}_least"] = q[1] - gap - below
    for r, slack in TAILS.items():
        q = pick(r)
        picked[f"{r}_most"] = 2 * q[1] - q[0] + slack
    fences = cut(fences.select("lang_g", "source_g", *[v.alias(k) for k, v in picked.items()]), "fences")
    same = F.col("lang").eqNullSafe(F.col("lang_g")) & F.col("source").eqNullSafe(F.col("source_g"))
    if fences.count() <= FEW_GROUPS:
        d = c.join(F.broadcast(fences), same, "left")
    else:
        dealt = c.withColumn("salt", F.pmod(F.xxhash64("doc_id", "word_chars", "n_words"), F.lit(SALTS)))
        copies = fences.withColumn("salt_g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        d = dealt.join(copies, same & (F.col("salt") == F.col("salt_g")), "left").drop("salt", "salt_g")
    ok = F.lit(True)
    for k in picked:
        r = F.col(k.rsplit("_", 1)[0])
        ok = ok & F.coalesce(r <= F.col(k) if k.endswith("_most") else r >= F.col(k), F.lit(True))
    return d.withColumn("base_failed", _base_failed()).withColumn("kept", ~_base_failed() & ok).drop("lang_g", "source_g")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(counts(documents(spark, sf_dir))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
