"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Each rule bounds a ratio of a document (length of words, symbols, stop words, lines). The table is
plain data, so a deployment can pass its own. There is no shuffle and no user function; a document of
any length is one row of the projection.

Defined cases: a null or empty text has no words and fails (too short); columns beside the text are
carried along, and repeated rows are judged alike.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import WORD, let, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Frequent function words of the four languages, lower case.
STOP_WORDS = {
    "en": "the and of to in is that was for with as on are be this from it by at or not have you",
    "de": "und die der das den dem des ist nicht von zu mit auf für ein eine einer im als sich",
    "fr": "de la le les et des un une est que en pour dans sur par elle il ne pas au",
    "es": "de la el los las que y en un una por con para del se no es su lo",
}


class Rule(NamedTuple):
    """A document passes while low <= numerator / denominator <= high."""

    name: str
    numerator: str
    denominator: str
    low: float | None
    high: float | None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.10),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.05, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.40),
)


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words inside a window of `window` words that occurs twice or more in the array; first occurrences count.

    Windows are compared by a 64-bit hash. Only texts with two equal windows are sorted.
    """
    n = F.size(tokens)
    hashes = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(tokens, i, window)))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc.n + F.least(F.lit(window), i - acc.last)).alias("n"))
        return F.aggregate(at, start, step, lambda acc: acc.n)

    def places(ordered: Column) -> Column:
        twin = lambda e, j: (F.get(ordered, j - 1).h == e.h) | (F.get(ordered, j + 1).h == e.h)
        return F.sort_array(F.transform(F.filter(ordered, twin), lambda e: e.i))

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(let(ordered, places)))

    return F.when(n >= window, let(hashes, count)).otherwise(F.lit(0))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_stop_words, n_lines, n_dup_lines and n_repeat_words, all long."""
    stop = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    body = F.coalesce(F.col(text), F.lit(""))
    is_stop = lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(stop)
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
    out = df.withColumns({"_words": words(body), "_lines": lines}).withColumns(
        {
            "n_words": F.size("_words"),
            "word_chars": F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")),
            "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")),
            "n_stop_words": F.size(F.filter("_words", is_stop)),
            "n_lines": F.size("_lines"),
            "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
            "n_repeat_words": repeated_words(F.col("_words")),
        }
    )
    counts = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")
    return out.drop("_words", "_lines").withColumns({c: F.col(c).cast("long") for c in counts})


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression over measured()."""
    verdict = F.lit(True)
    for r in rules:
        # Multiplied out: there is no division, so an empty denominator needs no case of its own.
        if r.low is not None:
            verdict &= F.col(r.numerator) >= F.lit(r.low) * F.col(r.denominator)
        if r.high is not None:
            verdict &= F.col(r.numerator) <= F.lit(r.high) * F.col(r.denominator)
    return verdict


def judge_quality(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with the measures, base_failed and kept. Column names that clash with the measures are replaced."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured(df, text).withColumn("base_failed", failed).withColumn("kept", ~failed & passes(rules))


def only_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that judge_quality keeps, with the columns of df.

    A filter on computed columns would be moved below them and compute each of them again for each of its uses, inside lambdas even
    for each word. A row number that the filter also reads stays where it is, and so does the filter.
    """
    rows = measured(df.select(F.struct("*").alias("_doc"), F.col(text).alias("_text")), "_text")
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.filter(~failed & passes(rules) & (F.col("_row") >= 0)).select("_doc.*")
