"""Statistics of a text as DataFrame expressions; used by the quality rules and the quality classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of, upto, words_of

#: Words of a window in which repeats are looked for.
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]+"

RATIOS = ("symbols_per_char", "repeat_share", "dup_line_share", "upper_share", "digit_share", "mark_share", "word_length", "distinct_share", "words_per_line", "top_mark_share", "log_words")


def _repeat_words(words: Column) -> Column:
    """Words that stand in a window of WINDOW words found twice or more in the text.

    Hashes of the windows tell texts without any repeat, which are most; the others compare the windows themselves.
    """
    n = F.size(words) - F.lit(WINDOW - 1)

    def window(i):
        return [F.get(words, i + k) for k in range(WINDOW)]

    def covered(rows):
        twice = F.filter(rows, lambda x, i: (F.get(rows, i - 1)["g"] == x["g"]) | (F.get(rows, i + 1)["g"] == x["g"]))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")), lambda a: a["n"])

    def exact(_):
        return let(F.sort_array(F.transform(upto(n), lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("g"), i.alias("i")))), covered)

    hashes = F.transform(upto(n), lambda i: F.xxhash64(*window(i)))
    return F.when(n < 2, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(h))))


def _count(col: str, pattern: str) -> Column:
    """Characters that a class matches. Taking out the few that match costs much less than taking out all others."""
    return F.length(col) - F.length(F.regexp_replace(col, pattern, ""))


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of each whole text; a null text counts as empty."""
    text = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t"))
    split = text.select("doc_id", "t", words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    joined = split.select("doc_id", "w", "lines", F.array_join("w", "").alias("chars"))
    counts = joined.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length("chars").cast("long").alias("word_chars"),
        _count("chars", SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        _count("chars", r"[A-Z]+").alias("n_upper"),
        _count("chars", r"[0-9]+").alias("n_digits"),
        _count("chars", r"[!-/:-@\[-`{-~]+").alias("n_marks"),
        _count("chars", r"[!?]+").alias("n_shouts"),
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per("n_symbols", "word_chars").alias("symbols_per_char"),
        per("n_repeat_words", "n_words").alias("repeat_share"),
        per("n_dup_lines", "n_lines").alias("dup_line_share"),
        per("n_upper", "word_chars").alias("upper_share"),
        per("n_digits", "word_chars").alias("digit_share"),
        per("n_marks", "word_chars").alias("mark_share"),
        per("word_chars", "n_words").alias("word_length"),
        per("n_distinct", "n_words").alias("distinct_share"),
        per("n_words", "n_lines").alias("words_per_line"),
        per("n_shouts", "word_chars").alias("top_mark_share"),
        F.log1p("n_words").alias("log_words"),
    )
