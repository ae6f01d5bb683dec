"""Text functions with the semantics of Unicode-aware stripping."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column) -> Column:
    """The column as text, empty where null."""
    return F.coalesce(c.cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` written and evaluated once, however often the body names it.

    A Column used twice is an expression copied, and copies of copies grow as a
    power of the depth. The body can't call Python, the value can.
    """
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; ``trim`` knows blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_right(c: Column, chars: str = "") -> Column:
    return F.rtrim(c, F.lit(chars)) if chars else F.regexp_replace(c, r"(?U)\s+\z", "")


def replace_all(c: Column, *pairs: tuple[str, str]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def first_match(c: Column, *patterns: str, group: int = 1) -> Column:
    """The group of the first pattern that matches; null if none does."""
    found = [F.when(c.rlike(p), F.regexp_extract(c, p, group)) for p in patterns]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def last_line(c: Column) -> Column:
    return strip(F.element_at(F.split(strip(c), "\n"), -1))


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clip(c: Column, limit: int = 500) -> Column:
    """At most ``limit`` characters, marked where cut."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("..."))).otherwise(c)


def short_name(c: Column) -> Column:
    """What follows the last slash of a model's name."""
    return F.substring_index(c, "/", -1)


def without_response_format(c: Column) -> Column:
    """An instruction up to its response-format section."""
    cut = F.regexp_replace(c, r"(?s)\n\n## Response Format\b.*", "")
    return F.when(c == "", c).otherwise(strip_right(cut))


def as_prompt(instruction: Column, question: Column) -> Column:
    return F.when(text(instruction) != "", F.concat(instruction, F.lit("\n\n"), question)).otherwise(question)


def numbered_samples(samples: Column, most: int = 20) -> Column:
    """Instruction and input of the first ``most`` samples as headed blocks for a prompt.

    Outputs are left out so as not to lead the reader.
    """
    # The heading, the two limits of length and what stands for an empty field.
    shown = lambda c, n: F.coalesce(F.left(none_if_empty(c), F.lit(n)), F.lit("N/A"))
    one = lambda s, i: F.concat(F.lit("### Sample "), (i + 1).cast("string"), F.lit("\n"), shown(s["instruction"], 200), F.lit("\n"), shown(s["input"], 500), F.lit("\n"))
    return F.array_join(F.transform(F.slice(samples, 1, most), one), "\n")


def iteration_history(entries: Column) -> Column:
    """``Iter N: summary`` lines of an ordered array of (iteration, summary)."""
    kept = F.filter(entries, lambda e: text(e["summary"]) != "")
    lines = F.transform(kept, lambda e: F.concat(F.lit("Iter "), e["iteration"].cast("string"), F.lit(": "), e["summary"]))
    return F.when(F.size(kept) > 0, F.array_join(lines, "\n")).otherwise("(No iteration history available)")


def iteration_summaries(entries: Column) -> Column:
    """The same entries as headed blocks; other words where there is none."""
    kept = F.filter(entries, lambda e: text(e["summary"]) != "")
    blocks = F.transform(kept, lambda e: F.concat(F.lit("[Iteration "), e["iteration"].cast("string"), F.lit(" Summary]\n"), e["summary"]))
    return (
        F.when(F.size(kept) > 0, F.array_join(blocks, "\n\n"))
        .when(F.size(entries) > 0, "(No previous iteration summaries)")
        .otherwise("(No previous iteration summaries. This is the first attempt.)")
    )


def feedback_history(entries: Column) -> Column:
    """Earlier feedback of (iteration, feedback) as headed blocks, whole; empty ones are passed over."""
    kept = F.filter(entries, lambda e: text(e["feedback"]) != "")
    one = lambda e: F.concat(F.lit("[Iteration "), F.coalesce(e["iteration"].cast("string"), F.lit("?")), F.lit(" Feedback]\n"), e["feedback"])
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, one), "\n\n")).otherwise("(No feedback history)")


def scaffolding_history(entries: Column) -> Column:
    """Earlier scaffolding of (iteration, summary, artifacts) as headed lines."""

    # Headings, the limits of length, and artifacts shown of an iteration.
    def artifact(a: Column, i: Column) -> Column:
        kind = F.coalesce(a["skill_type"], F.lit("Unknown"))
        return F.concat(F.lit("\n  Artifact "), (i + 1).cast("string"), F.lit(" ("), kind, F.lit("): "), F.left(text(a["target_objective"]), F.lit(100)))

    def one(e: Column) -> Column:
        head = F.concat(F.lit("\n[Iteration "), F.coalesce(e["iteration"].cast("string"), F.lit("?")), F.lit("]"))
        summary = F.when(text(e["summary"]) != "", F.concat(F.lit("\nSummary: "), F.left(e["summary"], F.lit(500)))).otherwise("")
        shown = F.coalesce(F.array_join(F.transform(F.slice(e["artifacts"], 1, 2), artifact), ""), F.lit(""))
        return F.concat(head, summary, shown)

    return F.when(F.size(entries) > 0, F.array_join(F.transform(entries, one), "\n")).otherwise("(No scaffolding history)")


def guided_attempts(entries: Column) -> Column:
    """Guidance and attempts of (feedback, response, is_correct), up to the first correct one.

    ``feedback`` is an array of questions; the first attempt shows none.
    """
    first = F.array_position(F.transform(entries, lambda e: F.coalesce(e["is_correct"], F.lit(False))), True)
    kept = F.slice(entries, F.lit(1), F.when(first > 0, first).otherwise(F.size(entries)).cast("int"))

    def one(e: Column, i: Column) -> Column:
        asked = F.array_join(F.transform(e["feedback"], lambda q: F.concat(F.lit("- "), q)), "\n")
        guidance = F.when((i > 0) & (F.size(e["feedback"]) > 0), F.concat(F.lit("[Guidance]\n"), asked, F.lit("\n\n"))).otherwise("")
        return F.concat(F.coalesce(guidance, F.lit("")), F.lit("[Solution Attempt]\n"), text(e["response"]))

    return F.array_join(F.transform(kept, one), "\n\n")


def latest_summary(entries: Column) -> Column:
    """The summary of the last of an ordered array of (iteration, summary) that has one."""
    kept = F.filter(entries, lambda e: text(e["summary"]) != "")
    return F.try_element_at(kept, F.lit(-1))["summary"]
