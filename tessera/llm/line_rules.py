"""Quality rules, line first: judge each line, drop failures, then judge the loss.

Every line of a text is tested on its own:

* punctuation: a short line (under ``short_words`` words) without a closing
  mark, or a line with at least as many ``!`` as half its words, or a line in
  which symbols make up over ``max_symbol_share`` of the characters;
* navigation: ``min_separators`` menu separators or more, one for at most
  every four words;
* boilerplate: a phrase of :data:`BOILERPLATE`.

Lines without a word always stay and never count. A document fails the method
when the words of failed lines are over ``max_lost_share`` of its words. The
document-level base rules (too few words, repeated eight-word windows) come on
top. All of it is built-in Column expressions: one scan, no shuffle.

Defined cases: a null text counts as empty, has zero in every count and is
rejected (under 20 words); repeated rows each get the same verdict; an empty
table gives an empty table; other columns are neither read nor returned by
:func:`judge`, and :func:`clean` returns exactly the columns it was given.
Windows are compared by a 64-bit hash of their eight words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS

#: The symbols and menu separators that count, and tell-tale phrases.
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›>•·"
BOILERPLATE = (
    "all rights reserved",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "accept cookies",
    "terms of use",
    "terms of service",
    "enable javascript",
    "licensed under",
    "copyright ©",
    "subscribe to our newsletter",
    "click here",
    "lorem ipsum",
)
CLOSING = ".!?:;…\"'”’»)]"
WHITE = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class LineRules:
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    short_words: int = 4
    max_symbol_share: float = 0.1
    min_separators: int = 3
    max_lost_share: float = 0.5


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS), "")


def _window_hashes(words: Column, width: int) -> Column:
    """A hash of each run of ``width`` words."""
    each = lambda ws: F.transform(ws, lambda _, i: F.xxhash64(F.slice(ws, i + 1, F.lit(width))))
    return _let(words, lambda ws: F.slice(each(ws), F.lit(1), F.greatest(F.size(ws) - (width - 1), F.lit(0))))


def _repeat_words(windows: Column, width: int) -> Column:
    """Words that lie in windows found twice or more, from the window hashes."""

    def covered(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        same = F.transform(
            ordered,
            lambda x, i: F.when(
                F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce((i < last) & (F.get(ordered, i + 1)["h"] == x["h"]), F.lit(False)),
                x["i"],
            ),
        )
        return _let(F.sort_array(F.array_compact(same)), gaps)

    def gaps(at: Column) -> Column:
        n = F.greatest(F.size(at) - 1, F.lit(0))
        steps = F.zip_with(F.slice(at, F.lit(1), n), F.slice(at, F.lit(2), n), lambda a, b: F.least(b - a, F.lit(width)))
        return F.aggregate(steps, F.lit(width).cast("long"), lambda total, x: total + x)

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(ordered, covered)).otherwise(F.lit(0).cast("long"))


def _count(text: Column, marks: str) -> Column:
    """How many of the characters ``marks`` are in the text."""
    return F.length(text) - F.length(F.translate(text, marks, ""))


def _phrase(text: Column) -> Column:
    """Whether a lower-case text holds a boilerplate phrase."""
    found = F.lit(False)
    for x in BOILERPLATE:
        found = found | text.contains(x)
    return found


def _failed(lines: Column, text: Column, rules: LineRules, wanted: bool = True) -> Column:
    """The lines that fail, or those that don't.

    What the whole text lacks is found once, bound ahead of the lines, so that
    rules about it are not tried on each of them.
    """
    has = F.struct(
        F.contains(text, F.lit("!")).alias("bang"),
        text.rlike("[#*$%&|<>]").alias("symbol"),
        text.rlike("[|»›>•·]").alias("separator"),
        _phrase(F.lower(text)).alias("phrase"),
    )

    def keep(line: Column, has: Column) -> Column:
        fails = line.rlike(r"[^\x20\x09-\x0D]") & _line_fails(line, has, rules)
        return fails if wanted else ~fails

    return _let(has, lambda h: F.filter(lines, lambda x: keep(x, h)))


def _line_fails(line: Column, has: Column, rules: LineRules) -> Column:
    n = F.size(_words(line))
    closed = F.substring(F.rtrim(line, F.lit(WHITE)), -1, 1).isin(*list(CLOSING))
    return (
        (~closed & (n < rules.short_words))
        | (has["bang"] & (2 * _count(line, "!") > n))
        | (has["symbol"] & (_count(line, SYMBOLS) > rules.max_symbol_share * F.length(F.translate(line, WHITE, ""))))
        | (has["separator"] & (_count(line, SEPARATORS) >= rules.min_separators) & (4 * _count(line, SEPARATORS) >= n))
        | (has["phrase"] & _phrase(F.lower(line)))
    )


def _measured(docs: DataFrame, text_col: str, rules: LineRules, carried: list[Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.select(*carried, text.alias("__text"), _words(text).alias("__words"), F.split(text, "\n").alias("__all_lines"))
    two = one.select(
        "*",
        F.filter("__all_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    three = two.select(
        "*",
        _window_hashes(F.col("__words"), rules.window).alias("__windows"),
        _failed(F.col("__lines"), F.col("__text"), rules).alias("__failed"),
    )
    n_words = F.size("__words").cast("long")
    return three.select(
        "*",
        n_words.alias("__n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("__word_chars"),
        _count(F.col("__text"), SYMBOLS).cast("long").alias("__n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__n_dup_lines"),
        _repeat_words(F.col("__windows"), rules.window).cast("long").alias("__n_repeat_words"),
        F.size(_words(F.array_join("__failed", "\n"))).cast("long").alias("__lost_words"),
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row per row of ``docs``: its counts and its verdict."""
    got = _measured(docs, text_col, rules, [F.col(id_col).alias("__id")])
    failed = (F.col("__n_words") < rules.min_words) | (100 * F.col("__n_repeat_words") > rules.max_repeat_percent * F.col("__n_words"))
    lost = F.col("__lost_words") > rules.max_lost_share * F.col("__n_words")
    return got.select(
        F.col("__id").alias(id_col),
        F.col("__n_words").alias("n_words"),
        F.col("__word_chars").alias("word_chars"),
        F.col("__n_symbols").alias("n_symbols"),
        F.col("__n_dup_lines").alias("n_dup_lines"),
        F.col("__n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & ~lost).alias("kept"),
        F.size("__failed").cast("long").alias("n_failed_lines"),
        F.col("__lost_words").alias("lost_words"),
    )


def clean(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", rules: LineRules = LineRules()) -> DataFrame:
    """The kept rows of ``docs`` without their failed lines, in the same columns.

    ``chars_col``, where present, gets the new text's length. Other columns pass
    through, even those named like columns used here, which are held in a struct.
    """
    names = docs.columns
    got = _measured(docs.select(F.struct(*[F.col(f"`{x}`") for x in names]).alias("__row"), F.col(text_col).alias("__in")), "__in", rules, [F.col("__row")])
    failed = (F.col("__n_words") < rules.min_words) | (100 * F.col("__n_repeat_words") > rules.max_repeat_percent * F.col("__n_words"))
    lost = F.col("__lost_words") > rules.max_lost_share * F.col("__n_words")
    # Guarded by a draw, the test is not deterministic to the optimizer, which would
    # else copy all that the counts are made of into a filter below them.
    kept = got.where(F.when(F.rand(0) >= 0, ~failed & ~lost)).select(
        "__row",
        F.when(
            F.size("__failed") > 0,
            F.array_join(_failed(F.col("__all_lines"), F.col("__text"), rules, wanted=False), "\n"),
        ).otherwise(F.col("__text")).alias("__new"),
    )
    out = []
    for x in names:
        if x == text_col:
            out.append(F.col("__new").alias(x))
        elif x == chars_col:
            out.append(F.length("__new").cast(docs.schema[x].dataType).alias(x))
        else:
            out.append(F.col("__row")[x].alias(x))
    return kept.select(*out)
