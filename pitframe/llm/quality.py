"""Quality rules with adaptive thresholds, DataFrame functions only (operator 2).

Each document gets base counts and four integer rates. For every language and source a quantile sketch of each rate is
kept over the texts that pass the base rule: counts of log-linear buckets of 32 steps an octave, so that a stored value is at
most 1/32 below the true one. Sketches merge by adding counts: a group with fewer than ``min_rows`` such texts uses the
sketch merged over its language, or over everything.

The limits come from the group's sketch alone: an upper quantile, moved out by ``spread`` times its distance from the median
(and likewise down for letters a word, where both too few and too many are odd). ``RULES`` gives the level of the quantile and the spread of
each rate; no limit is a constant. Letters are spread around a median, so the quartiles are moved out far. Symbols are missing
from most texts: where fewer than an eighth of a group has any, texts with symbols are the odd ones, and where they are usual the limit
follows their own spread. Repeated lines and words also occur in good texts; only the group's last hundredth goes. A document is kept if the
bucket of each of its rates lies within the limits.

Defined cases: a null or empty text has no words and fails the base rule; null languages and sources are groups of
their own; if no text passes the base rule none is kept; repeated rows are judged one by one; an empty table gives an empty result;
other columns are not carried. Three-word windows are compared by a 64-bit hash within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: rate -> level of the upper quantile in hundredths, spread; rates are thousandths, letters a word are hundredths
RULES = {"letters_rate": (75, 12), "symbol_rate": (88, 8), "dup_line_rate": (99, 0), "repeat_rate": (99, 0)}


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Counts of each whole text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    # the steps are separate projections so that arrays used in lambdas are computed once
    rows = docs.select(F.col(id_col), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(
        id_col,
        *keep,
        _words(F.col("text")).alias("words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: F.length(F.translate(line, " \t\x0b\f\r", "")) > 0).alias("lines"),
    )
    counts = [F.col(k) for k in (id_col, *keep, "word_chars", "n_symbols")]
    rows = rows.select(
        *counts,
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))), F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))).alias("windows"),
    )
    counts += [F.col(k) for k in ("n_words", "n_lines", "n_dup_lines")]
    empty = F.array().cast("array<struct<x:bigint,i:int>>")
    rows = rows.select(*counts, F.when(F.size("windows") > F.size(F.array_distinct("windows")), F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(empty).alias("sorted"))
    again = F.filter("sorted", lambda e, k: (F.get("sorted", k - 1)["x"] == e["x"]) | (F.get("sorted", k + 1)["x"] == e["x"]))
    rows = rows.select(*counts, F.sort_array(F.transform(again, lambda e: e["i"])).alias("starts"))
    covered = F.transform("starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - p, F.lit(3))))
    return rows.select(*counts, F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))


def _rates(counts: DataFrame) -> DataFrame:
    per = lambda part, whole, unit: F.when(F.col(whole) > 0, F.expr(f"{part} * {unit} div {whole}")).otherwise(F.lit(0)).cast("long")
    return counts.withColumns({"letters_rate": per("word_chars", "n_words", 100), "symbol_rate": per("n_symbols", "n_words", 1000), "dup_line_rate": per("n_dup_lines", "n_lines", 1000), "repeat_rate": per("n_repeat_words", "n_words", 1000)})


def _bucket(value: str) -> Column:
    """The least value of the bucket: the leading six bits are kept."""
    shift = f"greatest(length(bin({value})) - 6, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {shift}), {shift})")


def sketches(rates: DataFrame, keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(keys, rate, bucket, n): the quantile sketch of each group and rate; adding n over groups merges sketches."""
    long = rates.select(*keys, F.expr(f"stack({len(RULES)}, {', '.join(f"'{r}', {r}" for r in RULES)}) as (rate, value)"))
    return long.select(*keys, "rate", _bucket("value").alias("bucket")).groupBy(*keys, "rate", "bucket").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, total, low, mid, high): the least buckets at or below which a quarter, half, and the rate's level of the rows lie."""
    by = W.partitionBy(*keys, "rate")
    level = F.create_map(*(x for r, (q, _) in RULES.items() for x in (F.lit(r), F.lit(q))))[F.col("rate")]
    ranked = sketch.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("total", F.sum("n").over(by))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket")))
    return ranked.groupBy(*keys, "rate").agg(F.max("total").alias("total"), at(F.lit(25)).alias("low"), at(F.lit(50)).alias("mid"), at(level).alias("high"))


def limits(sketch: DataFrame, min_rows: int) -> DataFrame:
    """(lang, source, letters_rate_lo, and each rate's _hi) for every group, from the narrowest sketch with enough rows."""
    own = _quantiles(sketch, ["lang", "source"])
    lang = _quantiles(sketch.groupBy("lang", "rate", "bucket").agg(F.sum("n").alias("n")), ["lang"])
    whole = _quantiles(sketch.groupBy("rate", "bucket").agg(F.sum("n").alias("n")), [])
    a, b, c = own.alias("a"), lang.alias("b"), whole.alias("c")
    joined = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.rate") == F.col("b.rate"))).join(c, F.col("a.rate") == F.col("c.rate"))
    pick = lambda q: F.when(F.col("a.total") >= min_rows, F.col(f"a.{q}")).when(F.col("b.total") >= min_rows, F.col(f"b.{q}")).otherwise(F.col(f"c.{q}"))
    chosen = joined.select("a.lang", "a.source", "a.rate", *(pick(q).alias(q) for q in ("low", "mid", "high")))
    spread = F.create_map(*(x for r, (_, w) in RULES.items() for x in (F.lit(r), F.lit(w))))[F.col("rate")]
    wide = chosen.withColumn("lo", F.col("low") - spread * (F.col("mid") - F.col("low"))).withColumn("hi", F.col("high") + spread * (F.col("high") - F.col("mid")))
    high = [F.max(F.when(F.col("rate") == r, F.col("hi"))).alias(f"{r}_hi") for r in RULES]
    return wide.groupBy("lang", "source").agg(F.max(F.when(F.col("rate") == "letters_rate", F.col("lo"))).alias("letters_rate_lo"), *high)


def quality(docs: DataFrame, *, min_rows: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Base counts, base_failed and kept of every document."""
    named = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = common.cut(_rates(base_counts(named, id_col, text_col)).withColumn("base_failed", failed))
    own = limits(sketches(counts.filter("not base_failed")), min_rows)
    d, f = counts.alias("d"), own.alias("f")
    # groups of languages and sources with a text that passes: never more rows than the sketch has groups
    joined = d.join(f, F.col("d.lang").eqNullSafe(F.col("f.lang")) & F.col("d.source").eqNullSafe(F.col("f.source")), "left")
    within = _bucket("letters_rate") >= F.col("letters_rate_lo")
    for r in RULES:
        within &= _bucket(r) <= F.col(f"{r}_hi")
    return joined.select(f"d.{id_col}", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"))
