"""Typed answers: extraction from a response, and comparison with the truth.

Every extractor is a Column expression; the scan for balanced braces and the
comparison of expressions are Arrow-batched functions, to which rows without a
box, or without an expression, go as nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import boxed, fraction, normal_answer, normal_latex, number
from .symbolic import same_expression
from .text import first_match, last_line, let, none_if_empty, strip, text

# The patterns, in order of precedence.
MCQ_PATTERNS = (
    r"[Aa]nswer[:\s]+([A-Da-d])",
    r"[Tt]he\s+(?:correct\s+)?answer\s+is[:\s]+([A-Da-d])",
    r"[Ff]inal\s+[Aa]nswer[:\s]+([A-Da-d])",
    r"^([A-Da-d])\.",
    r"\b([A-Da-d])\s+is\s+(?:the\s+)?correct",
    r"\(([A-Da-d])\)",
)
MCQ_LINES = ("A", "B", "C", "D", "A.", "B.", "C.", "D.")
NUMBER_MARKED = r"####\s*([-]?\d+(?:[.,]\d+)?)"
NUMBER_FIRST = r"([-]?\d+(?:[.,]\d+)?)"
NUMBER_PATTERNS = (
    r"[Aa]nswer[:\s]+\$?([-]?\d+(?:[.,]\d+)?)\$?",
    r"[Tt]he\s+(?:final\s+)?answer\s+is[:\s]+\$?([-]?\d+(?:[.,]\d+)?)\$?",
    r"[Ff]inal\s+[Aa]nswer[:\s]+\$?([-]?\d+(?:[.,]\d+)?)\$?",
    r"=\s*\$?([-]?\d+(?:[.,]\d+)?)\$?\s*$",
    r"[Aa]nswer[:\s]+\*?\*?([-]?\d+(?:[.,]\d+)?)\*?\*?",
)
NUMBER_ANY = r"[-]?\d+(?:\.\d+)?"
LATEX_PATTERN = r"answer\s+is[:\s]+\$?([^$\n]+)\$?"
BOOLEAN_PATTERNS = (
    r"[Aa]nswer[:\s]+(Yes|No|True|False)",
    r"[Tt]he\s+answer\s+is[:\s]+(Yes|No|True|False)",
    r"^(Yes|No|True|False)[.\s]*$",
)
YES = ("yes", "true", "valid", "correct", "y")
NO = ("no", "false", "invalid", "incorrect", "n")
TEXT_PATTERNS = (
    r"[Aa]nswer[:\s]+(.+?)(?:\n|$)",
    r"[Tt]he\s+(?:final\s+)?answer\s+is[:\s]+(.+?)(?:\n|$)",
    r"[Ff]inal\s+[Aa]nswer[:\s]+(.+?)(?:\n|$)",
)

# (?U) Unicode classes, (?d) only \n ends a line, (?m) ^ and $ at lines.
_LINES = "(?Umd)"


def _last_of(c: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lit(-1))


def extract_mcq(c: Column) -> Column:
    """A letter A to D from a box, a telling phrase, or one of the last five lines."""
    lines = F.split(strip(c), "\n")
    tail = F.slice(lines, F.greatest(F.size(lines) - 4, F.lit(1)), F.lit(5))
    alone = F.filter(F.transform(tail, strip), lambda x: x.isin(*MCQ_LINES))
    return F.coalesce(
        let(strip(boxed(c)), lambda inside: F.when(inside.rlike(r"^[A-Da-d]$"), F.upper(inside))),
        F.upper(first_match(c, *[_LINES + p for p in MCQ_PATTERNS])),
        F.left(F.try_element_at(alone, F.lit(-1)), F.lit(1)),
    )


def extract_numeric(c: Column) -> Column:
    """A marked number, one from a box, after a telling phrase, or the last one."""
    section = (
        F.when(F.contains(c, F.lit("####")), F.element_at(F.split(c, "####"), -1))
        .when(F.lower(c).contains("answer"), F.element_at(F.split(c, "[Aa]nswer"), -1))
        .otherwise(c)
    )
    bare = lambda x: F.replace(x, F.lit(","), F.lit(""))
    return F.coalesce(
        bare(first_match(c, "(?U)" + NUMBER_MARKED)),
        let(none_if_empty(boxed(c)), lambda inside: F.coalesce(bare(first_match(inside, "(?U)" + NUMBER_FIRST)), inside)),
        bare(first_match(c, *[_LINES + p for p in NUMBER_PATTERNS])),
        _last_of(section, "(?U)" + NUMBER_ANY),
        _last_of(c, "(?U)" + NUMBER_ANY),
    )


def extract_latex(c: Column) -> Column:
    """A box, what follows "answer is", or a number."""
    after = none_if_empty(F.rtrim(strip(first_match(c, "(?Uid)" + LATEX_PATTERN)), F.lit(".")))
    return F.coalesce(none_if_empty(boxed(c)), after, extract_numeric(c))


def _last_place(c: Column, words: tuple[str, ...]) -> Column:
    """Where the last of any of the words starts, counted from the end; large if none."""
    from_end = [F.when(F.contains(c, F.lit(w)), F.instr(F.reverse(c), w[::-1]) + len(w)) for w in words]
    return F.coalesce(F.least(*from_end), F.lit(1 << 30))


def extract_boolean(c: Column) -> Column:
    """Yes or No from a telling phrase, else from the kind of word that starts last."""
    said = F.lower(first_match(c, *["(?Uimd)" + p for p in BOOLEAN_PATTERNS]))
    low = F.lower(c)
    yes, no = _last_place(low, YES), _last_place(low, NO)
    return F.coalesce(F.when(said.isin(*YES), "Yes").when(said.isNotNull(), "No"), F.when(yes < no, "Yes").when(no < yes, "No"))


def extract_text(c: Column) -> Column:
    """What follows a telling phrase to the end of its line, else the last line."""
    # ``$`` here also stands before a final line break.
    after = [none_if_empty(F.rtrim(strip(first_match(c, "(?Ud)" + p)), F.lit("."))) for p in TEXT_PATTERNS]
    lines = F.filter(F.transform(F.split(strip(c), "\n"), strip), lambda x: x != "")
    return F.coalesce(*after, F.try_element_at(lines, F.lit(-1)))


EXTRACTORS = {"mcq": extract_mcq, "numeric": extract_numeric, "latex": extract_latex, "boolean": extract_boolean, "text": extract_text}


def extract(answer_type: str, c: Column) -> Column:
    """An unknown type is text."""
    return EXTRACTORS.get(answer_type, extract_text)(c)


def extract_by(answer_type: Column, c: Column) -> Column:
    """The extractor that each row's type names."""
    out = F.when(answer_type == "mcq", extract_mcq(c))
    for name in ("numeric", "latex", "boolean"):
        out = out.when(answer_type == name, EXTRACTORS[name](c))
    return out.otherwise(extract_text(c))


def same_answer(predicted: Column, truth: Column) -> Column:
    """Equal normal forms, out of boxes, or the same expression."""
    one = normal_answer(F.coalesce(none_if_empty(boxed(truth)), truth))
    two = normal_answer(F.coalesce(none_if_empty(boxed(predicted)), predicted))
    unlike = let(F.struct(one.alias("one"), two.alias("two")), lambda p: F.when(p["one"] != p["two"], p))
    # Null where they are equal, and where one of them is null.
    equal = F.when(unlike.isNull(), one == two).otherwise(same_expression(unlike["one"], unlike["two"]))
    return F.when(text(truth) == "", False).otherwise(F.coalesce(equal, F.lit(False)))


def _near(a: Column, b: Column) -> Column:
    near = lambda a, b: F.coalesce((~F.isnan(a) & ~F.isnan(b)) & ((a == b) | (F.abs(a - b) < 1e-6)), F.lit(False))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: near(p["a"], p["b"]))


def grade_mcq(predicted: Column, truth: Column) -> Column:
    truth = F.coalesce(none_if_empty(boxed(truth)), truth)
    return F.coalesce(strip(F.upper(predicted)) == strip(F.upper(truth)), F.lit(False))


def grade_numeric(predicted: Column, truth: Column) -> Column:
    value = lambda x: number(F.replace(x, F.lit(","), F.lit("")))
    return predicted.isNotNull() & (_near(value(predicted), value(truth)) | same_answer(predicted, truth) | F.coalesce(strip(predicted) == strip(truth), F.lit(False)))


def grade_latex(predicted: Column, truth: Column) -> Column:
    gap = lambda p: number(p["one"]) - number(p["two"])
    close = lambda p: let(gap(p), lambda x: F.coalesce((F.abs(x) < 1e-6) & ~F.isnan(x), F.lit(False)))
    alike = let(F.struct(normal_latex(predicted).alias("one"), normal_latex(truth).alias("two")), lambda p: (p["one"] == p["two"]) | close(p))
    parts = F.coalesce(F.abs(fraction(predicted) - fraction(truth)) < 1e-6, F.lit(False))
    return predicted.isNotNull() & (alike | parts | same_answer(predicted, truth))


def grade_boolean(predicted: Column, truth: Column) -> Column:
    one, two = strip(F.lower(predicted)), strip(F.lower(truth))
    both = lambda words: one.isin(*words) & two.isin(*words)
    return F.coalesce(both(YES) | both(NO) | (one == two), F.lit(False))


def grade_text(predicted: Column, truth: Column) -> Column:
    one, two = strip(F.lower(predicted)), strip(F.lower(truth))
    words = lambda x: F.regexp_replace(x, r"(?U)[^\w\s]", "")
    return F.coalesce((one == two) | (words(one) == words(two)), F.lit(False))


GRADERS = {"mcq": grade_mcq, "numeric": grade_numeric, "latex": grade_latex, "boolean": grade_boolean, "text": grade_text}


def grade(answer_type: str, predicted: Column, truth: Column) -> Column:
    return GRADERS.get(answer_type, grade_text)(predicted, truth)


def grade_by(answer_type: Column, predicted: Column, truth: Column) -> Column:
    out = F.when(answer_type == "mcq", grade_mcq(predicted, truth))
    for name in ("numeric", "latex", "boolean"):
        out = out.when(answer_type == name, GRADERS[name](predicted, truth))
    return out.otherwise(grade_text(predicted, truth))


def ground_truth(output: Column) -> Column:
    """The answer in a record's output: a box, a marked line, or the last line."""
    marked = strip(first_match(strip(output), r"(?Umd)####\s*(.+?)$"))
    return F.coalesce(none_if_empty(boxed(output)), marked, last_line(output))


def choices(question: Column) -> Column:
    """Lettered choices, where there are two or more."""
    lines = F.transform(F.split(strip(question), "\n"), strip)
    pattern = r"(?Ud)^([A-E])[.)]\s*(.+)$"
    found = F.transform(F.filter(lines, lambda x: x.rlike(pattern)), lambda x: strip(F.regexp_extract(x, pattern, 2)))
    return F.when(F.size(found) >= 2, found)
