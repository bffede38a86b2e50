"""Line-first cleaning: rules for single lines, then a verdict on what is left of the document.

All of it is column expressions on one row, so nothing is shuffled and no Python runs. A text is split into lines and
words once; the rest is array functions, whose cost grows as n log n with the length of a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import lower_ascii

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# How a line of prose ends, what stands between the entries of a menu, and phrases of pages' frames.
LINE_END = r"[.!?:;,\x{2026}\x{3002}\x{FF01}\x{FF1F}\"')\]\x{00BB}\x{201C}\x{201D}\x{2019}-][\x20\x09-\x0D]*$"
MENU = r"[|>\x{00BB}\x{00B7}\x{2022}]"
BOILERPLATE = ("accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service",
               "all rights reserved", "enable javascript", "javascript is disabled", "skip to content",
               "subscribe to our newsletter", "share on facebook", "click here to", "lorem ipsum", "back to top",
               "sign in to", "add to cart")

SYMBOL_SHARE = 0.1  # symbols per word of a line
MENU_WORDS = 4  # words between two menu marks, at most, in a line of navigation
END_WORDS = 40  # longer lines may stop anywhere, as cut-off prose does
MAX_LOST = 0.5  # share of the words that a kept document may lose
MIN_WORDS = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where a lambda uses it for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    """The words of a text, an empty array for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _count(line: Column, pattern: str) -> Column:
    return F.regexp_count(line, F.lit(pattern))


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def line_verdicts(line: Column, words: Column) -> dict[str, Column]:
    """Which rules a line of so many words breaks. Lines without a word break none.

    ``punctuation``: more than ``SYMBOL_SHARE`` symbols per word, or a line of 3 to ``END_WORDS`` words that ends like no
    prose. ``navigation``: two menu marks or more and at most ``MENU_WORDS`` words for each. ``boilerplate``: a phrase of
    a page's frame in a line of at most 30 words.
    """
    marks, low, phrase = _count(line, MENU), lower_ascii(line), F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | F.contains(low, F.lit(p))
    return {
        "punctuation": (_symbols(line) > F.lit(SYMBOL_SHARE) * words) | (words.between(3, END_WORDS) & ~line.rlike(LINE_END)),
        "navigation": (marks >= 2) & (words <= MENU_WORDS * marks),
        "boilerplate": (words <= 30) & phrase,
    }


def _judged(line: Column) -> Column:
    def judge(words: Column) -> Column:
        broken = F.lit(False)
        for rule in line_verdicts(line, words).values():
            broken = broken | rule
        return F.struct(line.alias("line"), words.alias("words"), ((words > 0) & broken).alias("bad"))

    return let(_count(line, WORD), judge)


def repeated_window_words(words: Column, size: int = 3) -> Column:
    """How many words lie in windows of ``size`` words that the text holds twice or more.

    The windows' hashes are sorted with their places; equal ones then are neighbours, and the words they cover are
    counted along the sorted places, ``size`` at most from one to the next.
    """
    last = F.size(words) - size
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(places, lambda i: F.struct(
        F.xxhash64(*[F.get(words, i + j) for j in range(size)]).alias("h"), i.alias("p")))

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def step(acc: Column, p: Column) -> Column:
        return F.struct((acc["n"] + F.least(p - acc["last"], F.lit(size))).alias("n"), p.alias("last"))

    start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
    return F.aggregate(let(F.sort_array(windows), repeated), start, step, lambda acc: acc["n"].cast("bigint"))


def text_measures(text: Column) -> Column:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text, zeros for NULL.

    ``word_chars`` are the code points within words, ``n_symbols`` those of ``SYMBOLS``, ``n_dup_lines`` the lines with
    a word that equal an earlier line, ``n_repeat_words`` the words in repeated windows of three.
    """
    text = F.coalesce(text, F.lit(""))
    chars = F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return let(words_of(text), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), chars.cast("bigint").alias("word_chars"),
        _symbols(text).cast("bigint").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("bigint").alias("n_dup_lines"),
        repeated_window_words(w).alias("n_repeat_words")))


def clean_lines(text: Column) -> Column:
    """``text`` without the lines that break a rule, ``kept_words`` left in it and ``lost_lines`` removed."""
    judged = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _judged)
    return let(judged, lambda lines: let(F.filter(lines, lambda x: ~x["bad"]), lambda good: F.struct(
        F.array_join(F.transform(good, lambda x: x["line"]), "\n").alias("text"),
        F.aggregate(good, F.lit(0).cast("bigint"), lambda n, x: n + x["words"]).alias("kept_words"),
        (F.size(lines) - F.size(good)).cast("bigint").alias("lost_lines"))))


def apply_quality_rules(docs: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST,
                        min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with one more column ``quality``.

    It holds the measures of ``text_measures``, the cleaned ``text``, ``kept_words``, ``lost_lines``, ``base_failed``
    (fewer than ``min_words`` words, or more than half of them in repeated windows) and ``kept``: the base did not fail
    and cleaning took at most ``max_lost`` of the words.

    A NULL or empty text has no words and is not kept. Repeated rows and NULL elsewhere make no difference; other
    columns stay as they are, whatever their names, but ``quality`` is replaced. An empty table gives an empty one.
    """
    measured = docs.withColumn("quality", F.struct(text_measures(F.col(text_col)).alias("m"),
                                                   clean_lines(F.col(text_col)).alias("c")))
    m, c = F.col("quality")["m"], F.col("quality")["c"]
    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    kept = ~failed & (m["n_words"] - c["kept_words"] <= F.lit(float(max_lost)) * m["n_words"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return measured.withColumn("quality", F.struct(
        *[m[n].alias(n) for n in names], c["text"].alias("text"), c["kept_words"].alias("kept_words"),
        c["lost_lines"].alias("lost_lines"), failed.alias("base_failed"), kept.alias("kept")))
