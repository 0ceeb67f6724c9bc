"""Quality rules: clean a text line by line, then reject documents that lose too much.

Everything here is SQL functions over one row: no shuffle, one scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barograph.llm.textbatch import BLANKS, GAP, WORD
from barograph.operators.once import computed_once

#: Sentence punctuation: prose has some in every line of more than ``BARE_WORDS`` words.
SENTENCE = r"[.,;:!?…。，！？،؟।]"
SYMBOLS = r"[#*$%&|<>]"
BOILERPLATE = r"[Cc]ookie|[Pp]rivacy [Pp]olicy|[Tt]erms [Oo]f ([Uu]se|[Ss]ervice)|[Aa]ll [Rr]ights [Rr]eserved|[Jj]ava[Ss]cript|[Nn]ewsletter|[Cc]lick [Hh]ere|[Rr]ead [Mm]ore|[Ll]orem [Ii]psum"

BARE_WORDS = 20
#: A line fails with more than this share of symbols among its characters.
SYMBOL_SHARE = 0.04
#: ... or with this many ``|`` or ``>`` standing alone as words, and so many of every 100 words.
BARS, BARS_PERCENT = 3, 20
#: ... or with more than this share of words ending in ``!!``.
SHOUT_SHARE = 0.3
#: ... or if it names something every site has and is no longer than this.
BOILERPLATE_CHARS = 200
#: A document goes if its failing lines have more than this share of its characters.
LOST_SHARE = 0.5

LEAST_WORDS = 50


def line_failure(line: Column) -> Column:
    """Why a line is taken out: punctuation, navigation or boilerplate; null if it stays. Blank lines stay.

    A plain search for the signs of a rule comes before its patterns: most lines have none and cost no more.
    """
    length, words = F.length(line), F.regexp_count(line, F.lit(WORD))
    bars = F.regexp_count(line, F.lit(r" [|>](?= )"))
    has = lambda *signs: reduce(lambda a, b: a | b, [line.contains(x) for x in signs])
    return (
        F.when(has("!!") & (F.regexp_count(line, F.lit(r"!!(?=[\x20\x09-\x0D]|$)")) > SHOUT_SHARE * words), "punctuation")
        .when(has(*"#*$%&|<>") & (F.regexp_count(line, F.lit(SYMBOLS)) > SYMBOL_SHARE * length), "punctuation")
        .when(has(" | ", " > ") & (bars >= BARS) & (100 * bars >= BARS_PERCENT * words), "navigation")
        .when((length <= BOILERPLATE_CHARS) & line.rlike(BOILERPLATE), "boilerplate")
        .when(~line.rlike(SENTENCE) & (words > BARE_WORDS), "punctuation")
    )


def _repeat_words(hashes: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text; each counts once."""
    ordered = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(1), F.size(hashes)).alias("i")))
    beside = lambda all_, x, j, step: F.coalesce(F.get(all_, j + step)["h"] == x["h"], F.lit(False))
    # a one-element array and a lambda around it bind a name to the costly array, so that it is worked out once
    twice = F.transform(F.array(ordered), lambda all_: F.sort_array(F.transform(F.filter(all_, lambda x, j: beside(all_, x, j, -1) | beside(all_, x, j, 1)), lambda x: x["i"])))
    covered = F.transform(twice, lambda at: F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(F.get(covered, F.lit(0)))


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts, a verdict and the cleaned text.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines, lost_chars (long),
    base_failed, kept (boolean) and cleaned_text. A null text counts as empty: no words, base_failed, not kept,
    cleaned text empty. Blank lines never fail. Repeated rows are judged alike. Columns of these names that
    ``docs`` already has are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "lost_chars", "base_failed", "kept", "cleaned_text"]
    kept = [c for c in docs.columns if c == text or c not in made]
    # the caller's row goes along as one struct, so that none of its names meets one used here
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"))
    body = F.coalesce(F.col("__row").getField(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(BLANKS))
    df = computed_once(
        docs,
        {
            "__words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP)),
            "__lines": F.split(body, "\n"),
            "word_chars": F.length(F.regexp_replace(body, GAP, "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
        },
    )
    words, spoken = F.col("__words"), F.filter("__lines", lambda x: x.rlike(WORD))
    df = df.select(
        *docs.columns,
        "word_chars",
        "n_symbols",
        F.size(words).cast("long").alias("n_words"),
        F.size("__lines").cast("long").alias("__n_lines"),
        F.transform(F.array(spoken), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("__n_dup"),
        F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).alias("__h"),
        F.filter("__lines", lambda x: line_failure(x).isNotNull()).alias("__failed"),
    )
    df = computed_once(df, {"__hashes": F.col("__h"), "__out": F.col("__failed"), "n_dup_lines": F.get("__n_dup", F.lit(0))}).drop("__h", "__failed", "__n_dup")
    df = df.withColumn("__repeats", _repeat_words(F.col("__hashes")))
    df = df.withColumn("__lost", F.aggregate("__out", F.lit(0).cast("long"), lambda n, x: n + F.length(x)))
    df = computed_once(df, {"n_repeat_words": F.col("__repeats"), "n_failed_lines": F.size("__out").cast("long"), "lost_chars": F.col("__lost")})
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # line breaks count for nothing, so a text of failing lines alone loses all of it
    df = df.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("lost_chars") <= LOST_SHARE * (F.length(body) - F.col("__n_lines") + 1)))
    cleaned = F.array_join(F.filter(F.split(body, "\n"), lambda x: line_failure(x).isNull()), "\n")
    df = df.withColumn("cleaned_text", F.when(F.col("n_failed_lines") == 0, body).otherwise(cleaned))
    return df.select(*[F.col(f"__row.`{c}`") for c in kept], *(c for c in made if c not in kept))
