"""Line-first cleaning with Spark expressions only.

Each line is held against rules on punctuation, navigation and boilerplate. Lines that fail go;
a document that loses too much of its text with them goes as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.scratch import without

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
REPEATED_PER_CENT = 20
#: A line fails with more symbols, shouted words or repeated words than one in so many words.
WORDS_PER_SYMBOL, WORDS_PER_SHOUT, WORDS_PER_STUTTER = 4, 4, 4
#: A short line without an end mark is taken for a menu entry.
MENU_WORDS = 3
LOST_PER_CENT = 60
END_MARKS = r"[.!?:;…。！？][\"'”’»)\]]*$"
#: Fixed phrases of notices, looked for in lines of any case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "is licensed", "released under the", "general public license", "copyright (c)", "©",
    "cookie policy", "accept cookies", "use cookies", "privacy policy", "terms of use", "terms of service",
    "subscribe to our", "sign up for", "share this", "read more", "click here", "enable javascript", "lorem ipsum", "skip to content",
)
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept", "cleaned_text")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


def count_symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of five words that the text has twice or more.

    Windows become (hash, place), and equal hashes are neighbours once sorted; the places of those
    windows, in order, each add the words that the one before doesn't hold.
    """

    def covered(places: Column) -> Column:
        added = F.transform(
            places, lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(places, i - 1)))
        )
        return F.aggregate(added, F.lit(0), lambda a, b: a + b)

    def alike(windows: Column) -> Column:
        twice = F.filter(
            windows,
            lambda w, i: F.coalesce(F.get(windows, i - 1)["h"] == w["h"], F.lit(False)) | F.coalesce(F.get(windows, i + 1)["h"] == w["h"], F.lit(False)),
        )
        return let(F.array_sort(F.transform(twice, lambda w: w["p"])), covered)

    def sorted_windows(own: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(own) - WINDOW)
        windows = F.transform(places, lambda p: F.struct(F.xxhash64(*[F.get(own, p + k) for k in range(WINDOW)]).alias("h"), p.alias("p")))
        return let(F.array_sort(windows), alike)

    return let(words, lambda own: F.when(F.size(own) <= WINDOW, F.lit(0)).otherwise(sorted_windows(own)))


def line_fails(line: Column) -> Column:
    """Whether a line with words breaks a rule."""
    lower = F.lower(line)

    def by_words(words: Column) -> Column:
        n = F.size(words)
        symbols = count_symbols(line) * WORDS_PER_SYMBOL > n
        shouts = F.size(F.filter(words, lambda w: w.endswith("!!"))) * WORDS_PER_SHOUT > n
        stutter = F.size(F.filter(words, lambda w, i: F.coalesce(F.get(words, i - 1) == w, F.lit(False)))) * WORDS_PER_STUTTER > n
        menu = (n <= MENU_WORDS) & ~line.rlike(END_MARKS)
        notice = F.lit(False)
        for phrase in BOILERPLATE:
            notice = notice | lower.contains(phrase)
        return symbols | shouts | stutter | menu | notice

    return let(words_of(line), by_words)


def clean_lines(docs: DataFrame, text: str = "text", lost_per_cent: int = LOST_PER_CENT) -> DataFrame:
    """The rows with the figures of the text, `kept`, and `cleaned_text`, the text without failing lines.

    base_failed: fewer than 10 words, or over 20 per cent of them in repeated windows. kept: not
    that, and no more than `lost_per_cent` of the characters in words stand in failing lines. Lines
    without words stay and count for nothing. A null text has no words, so it isn't kept; its cleaned
    text is null. Repeated rows are judged each. The new columns take the place of columns of those names.
    """
    own = F.col(f"`{text}`")
    lines = F.filter(F.split(own, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    judged = F.transform(
        F.split(own, "\n", -1),
        lambda x: F.struct(x.alias("line"), (x.rlike(r"[^\x20\x09-\x0D]") & line_fails(x)).alias("fails")),
    )
    base = without(docs, *[c for c in COLUMNS if c.lower() != text.lower()], "__lines", "__words")
    counted = base.withColumns(
        {
            "n_words": F.coalesce(F.size(words_of(own)), F.lit(0)).cast("bigint"),
            "word_chars": F.coalesce(word_chars(own), F.lit(0)).cast("bigint"),
            "n_symbols": F.coalesce(count_symbols(own), F.lit(0)).cast("bigint"),
            "n_dup_lines": F.coalesce(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("bigint"),
            "n_repeat_words": F.coalesce(repeated_words(words_of(own)), F.lit(0)).cast("bigint"),
            "__lines": judged,
        }
    )
    counted = counted.withColumn("n_words", F.greatest("n_words", F.lit(0)))
    failed = F.filter("__lines", lambda x: x["fails"])
    lost = F.aggregate(failed, F.lit(0).cast("bigint"), lambda a, x: a + word_chars(x["line"]))
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PER_CENT * F.col("n_words"))
    stay = F.array_join(F.transform(F.filter("__lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
    return (
        counted.withColumn("lost_chars", F.coalesce(lost, F.lit(0)))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= lost_per_cent * F.col("word_chars")))
        .withColumn("cleaned_text", stay)
        .drop("__lines")
    )
