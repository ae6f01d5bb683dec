"""Structured text that teacher and student models write: guidance, references, task trees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_match, none_if_empty, strip, text

# Headings and markers of the formats.
SECTION = r"\[Scaffolding for Task \[\d+\] \((?:High Order Skill|Low Order Skill)\)\][:\s]*"
SECTION_LABEL = r"\[Scaffolding for Task \[\d+\] \((High Order Skill|Low Order Skill)\)\]"
SECTION_END = r"\[Scaffolding for Task|\[Feedback\]|\[Iteration Summary\]"
FIELDS = {
    "target_objective": r"Target Objective:\s*(.*?)(?=\n- |\z)",
    "cognitive_level": r"Cognitive Level:\s*(.*?)(?=\n- |\z)",
    "failure_analysis": r"Failure Analysis:\s*(.*?)(?=\n- |\z)",
}
HIGH = {
    "strategy_suggestion": r"Suggested Strategy:\s*\n(.*?)(?=\n- Key Attention|\z)",
    "key_attention_points": r"Key Attention Points:\s*(.*?)(?=\n\[|\z)",
}
LOW = {
    "missed_concept": r"Missed Concept/Information:\s*(.*?)(?=\n- |\z)",
    "brief_explanation": r"Brief Explanation:\s*(.*?)(?=\n\[|\z)",
}
FEEDBACK = r"\[Feedback\]\s*\n(.*?)(?=\[Iteration Summary\]|\n?\z)"
SUMMARY = r"\[Iteration Summary\]\s*\n(.*?)\n?\z"
RETRIEVED = "Information Retrieved from Scaffolding Artifact:"
IMPROVED = "Improved Reasoning:"
GOAL = "Instructional Goal:"
BRANCHES = ("├──", "└──", "│")
GOAL_SENTENCE = r"""["']?(The model (?:should be able to|will)[^"']+)["']?"""


def _field(c: Column, pattern: str) -> Column:
    return F.coalesce(strip(first_match(c, "(?Us)" + pattern)), F.lit(""))


def _artifact(section: Column, label: Column) -> Column:
    high = label == "High Order Skill"
    content = F.element_at(F.split(section, SECTION_END), 1)
    pick = lambda wanted, patterns, name: F.when(wanted, none_if_empty(_field(content, patterns[name]))) if name in patterns else F.lit(None).cast("string")
    names = ("strategy_suggestion", "partial_example", "feedback", "missed_concept", "brief_explanation", "key_attention_points")
    parts = [(pick(high, HIGH, n) if n in HIGH else pick(~high, LOW, n)).alias(n) for n in names]
    return F.struct(
        *[_field(content, p).alias(n) for n, p in FIELDS.items()],
        F.when(high, "HOT").otherwise("LOT").alias("skill_type"),
        F.struct(*parts).alias("scaffolding_content"),
    )


def skills(c: Column) -> Column:
    """HOT or LOT of each guidance section, without parsing what it says."""
    return F.transform(F.regexp_extract_all(c, F.lit(SECTION_LABEL), F.lit(1)), lambda label: F.when(label == "High Order Skill", "HOT").otherwise("LOT"))


def artifacts(c: Column) -> Column:
    """Guidance sections of a teacher's text as an array of structs, in order."""
    sections = F.split(c, "(?U)" + SECTION)
    labels = F.regexp_extract_all(c, F.lit(SECTION_LABEL), F.lit(1))
    return F.transform(labels, lambda label, i: _artifact(F.get(sections, i + 1), label))


def feedback(c: Column) -> Column:
    return _field(c, FEEDBACK)


def summary(c: Column) -> Column:
    return _field(c, SUMMARY)


def references(c: Column) -> Column:
    """Bullets that a student lists as taken from guidance."""
    section = F.substring_index(F.get(F.split(text(c), "(?:" + RETRIEVED + ")"), F.lit(1)), IMPROVED, 1)
    lines = F.transform(F.split(strip(F.coalesce(section, F.lit(""))), "\n"), strip)
    return F.transform(F.filter(lines, lambda x: x.rlike("^[-•]")), lambda x: strip(F.substring(x, 2, 1 << 30)))


def task_tree(c: Column) -> Column:
    """The last goal line and the branch lines of a task analysis."""
    lines = F.transform(F.split(strip(c), "\n"), strip)
    goals = F.filter(lines, lambda x: x.contains(GOAL))
    branch = lambda x: (~x.contains(GOAL)) & (x.startswith(BRANCHES[0]) | x.startswith(BRANCHES[1]) | x.startswith(BRANCHES[2]))
    goal = strip(F.replace(F.try_element_at(goals, F.lit(-1)), F.lit(GOAL), F.lit("")))
    return F.struct(F.coalesce(goal, F.lit("")).alias("instructional_goal"), F.filter(lines, branch).alias("subskills"))


def goal_fallback(c: Column) -> Column:
    """Goal and level from loose text: the last keyed line of each, else a telling sentence."""
    lines = F.split(strip(c), "\n")
    low = lambda x: strip(F.lower(x))
    is_goal = lambda x: low(x).contains("instructional_goal") | low(x).contains("the model should") | low(x).contains("the model will")
    is_level = lambda x: ~is_goal(x) & low(x).contains("cognitive_level")

    def last_value(wanted) -> Column:  # noqa: ANN001
        keyed = F.filter(lines, lambda x: wanted(x) & x.contains(":"))
        values = F.transform(keyed, lambda x: F.trim(F.trim(strip(F.regexp_extract(x, "(?s)^[^:]*:(.*)$", 1)), F.lit('"')), F.lit(",")))
        return F.try_element_at(F.filter(values, lambda v: v != ""), F.lit(-1))

    sentence = strip(first_match(c, "(?Ui)" + GOAL_SENTENCE))
    return F.struct(
        F.coalesce(last_value(is_goal), sentence, F.lit("")).alias("instructional_goal"),
        F.coalesce(last_value(is_level), F.lit("Apply")).alias("cognitive_level"),
        F.lit("").alias("primary_verb"),
        F.lit("").alias("rationale"),
    )
