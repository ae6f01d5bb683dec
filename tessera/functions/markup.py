"""Mathematical markup: boxed answers, normal forms, fractions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let, replace_all, strip, text

_BRACE = re.compile(r"[{}]")


def boxed_of(response: str | None) -> str | None:
    r"""What the last ``\boxed`` (else ``\fbox``) holds, with braces balanced."""
    if not response:
        return None
    at = max(response.rfind(r"\boxed"), -1)
    if at < 0:
        at = response.rfind(r"\fbox")
    if at < 0:
        return None
    depth, opened = 0, None
    for brace in _BRACE.finditer(response, at):
        if brace.group() == "{":
            opened = brace.start() if depth == 0 else opened
            depth += 1
        else:
            depth -= 1
            if depth == 0 and opened is not None:
                return response[opened + 1 : brace.start()]
    return None


@F.pandas_udf(T.StringType())
def _boxed(responses: pd.Series) -> pd.Series:
    return responses.map(boxed_of)


def boxed(c: Column) -> Column:
    """Balanced braces need a scan; of rows without a box only a null is sent to it."""
    return _boxed(let(c, lambda x: F.when(F.contains(text(x), F.lit("\\boxed")) | F.contains(text(x), F.lit("\\fbox")), x)))


def boxed_shallow(c: Column) -> Column:
    """The last box with braces one level deep at most; else any; else empty."""
    # The two patterns.
    nested = F.regexp_extract_all(c, F.lit(r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"), F.lit(1))
    lazy = F.regexp_extract_all(c, F.lit(r"\\boxed\{(.+?)\}"), F.lit(1))
    return F.coalesce(F.try_element_at(nested, F.lit(-1)), F.try_element_at(lazy, F.lit(-1)), F.lit(""))


def unboxed(c: Column) -> Column:
    """Each simple box replaced by its content, for display."""
    return F.regexp_replace(c, r"\\boxed\{([^}]+)\}", "$1")


#: What normalisation replaces, in order.
REPLACED = (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), (" .", " 0."), ("{.", "{0."))


def plain_markup(c: Column) -> Column:
    """Spacing commands, fraction variants and delimiters evened out; blanks gone."""
    whole = lambda even: F.when(F.startswith(even, F.lit(".")), F.concat(F.lit("0"), even)).otherwise(even)
    return F.replace(let(replace_all(c, *REPLACED), whole), F.lit(" "), F.lit(""))


def normal_answer(c: Column) -> Column:
    r"""Stripped, out of a ``\text{}`` around all of it, then evened out."""
    inner = lambda bare: F.regexp_extract(bare, r"(?d)^\\text\{(.+?)\}$", 1)
    return plain_markup(let(strip(c), lambda bare: F.when(inner(bare) != "", strip(inner(bare))).otherwise(bare)))


def normal_latex(c: Column) -> Column:
    """Out of text wrappers and dollars; no backslash, brace or blank left."""
    bare = F.regexp_replace(text(c), r"\\(?:text|mathrm|mathbf|textbf)\{([^}]+)\}", "$1")
    bare = F.regexp_replace(bare, r"\$([^$]+)\$", "$1")
    return strip(F.translate(bare, "\\{} ", ""))


def fraction(c: Column) -> Column:
    """The value of the first fraction command, else of the first a/b; null over zero."""

    def value(c: Column, pattern: str) -> Column:
        top, bottom = (F.try_to_number(F.regexp_extract(c, pattern, g), F.lit("9" * 30)).cast("double") for g in (1, 2))
        return F.try_divide(top, bottom)

    return let(c, lambda x: F.coalesce(value(x, r"frac\{?(\d+)\}?\{?(\d+)\}?"), value(x, r"(\d+)/(\d+)")))


def number(c: Column) -> Column:
    """The text as a double the way a general float parser reads it, else null."""
    shaped = lambda bare: F.lower(bare).rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$")
    return let(strip(c), lambda bare: F.when(shaped(bare), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double")))
