"""Repair and extraction of JSON objects from model output, as Arrow-batched functions.

Escapes and strings make this a scan with state; a compiled pattern cuts the
text into strings and the rest, so the scan is over few pieces.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A string, closed or running to the end; an escape takes the next character.
_STRING = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)', re.DOTALL)
#: Outside or inside, a character that JSON wants escaped.
_CONTROL = re.compile(r"(\\.)|([\x00-\x1f])", re.DOTALL)
_SHORT = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
#: The escapes that JSON knows.
_ESCAPE = re.compile(r'\\(?:(["\\/bfnrt])|(u[0-9a-fA-F]{4})|(.))', re.DOTALL)
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL)


def escape_controls(text: str) -> str:
    """Control characters inside strings as escapes."""

    def one(m: re.Match) -> str:
        if m.group(1):
            return m.group(1)
        return _SHORT.get(m.group(2)) or f"\\u{ord(m.group(2)):04x}"

    return _STRING.sub(lambda s: _CONTROL.sub(one, s.group()), text)


def repair_escapes(text: str) -> str:
    """Controls escaped, and the backslash doubled where it starts no escape."""
    return _ESCAPE.sub(lambda m: m.group() if m.group(3) is None else "\\\\" + m.group(3), escape_controls(text))


def closing_brace(text: str, at: int) -> int:
    """Where the brace opened at ``at`` closes, strings aside; -1 if nowhere."""
    if text[at : at + 1] != "{":
        return -1
    depth, place = 0, at
    while place < len(text):
        if text[place] == '"':
            place = _STRING.match(text, place).end()
            continue
        depth += {"{": 1, "}": -1}.get(text[place], 0)
        if depth == 0:
            return place
        place += 1
    return -1


def only_object(text: str) -> str:
    """From the first brace to its close; unchanged without one, to the end if it never closes."""
    first = text.find("{")
    if first < 0:
        return text
    end = closing_brace(text, first)
    return text[first:] if end < 0 else text[first : end + 1]


def strict_object(text: str | None) -> str | None:
    """The text as it stands, where it is one JSON object and nothing else, as canonical text; else null."""
    try:
        held = json.loads(text) if text is not None else None
    except ValueError:
        return None
    return json.dumps(held, ensure_ascii=False) if isinstance(held, dict) else None


def extract_object(text: str | None) -> str | None:
    """The first reading that parses, as canonical JSON text; null if none does."""
    if text is None:
        return None
    text = only_object(text)
    outer = re.search(r"\{.*\}", text, re.DOTALL)
    tries = [text.strip(), *(x.strip() for x in _FENCE.findall(text))]
    if outer:
        tries += [outer.group(), repair_escapes(outer.group())]
    for candidate in [*tries, repair_escapes(text)]:
        try:
            return json.dumps(json.loads(candidate), ensure_ascii=False)
        except ValueError:
            continue
    return None


def _column(one):  # noqa: ANN001, ANN202
    @F.pandas_udf(T.StringType())
    def many(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else one(x))

    return many


def json_object(c: Column) -> Column:
    """A response's JSON object as text, or null; read on with ``from_json``."""
    return _column(extract_object)(c)


def json_escapes(c: Column) -> Column:
    return _column(repair_escapes)(c)
