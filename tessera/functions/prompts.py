"""Prompts of the coaching loop and of design, filled from a table of templates.

A table is a JSON object of name to template, read from a path; names that it
leaves out keep the short defaults here. Templates name their fields in braces,
and a brace itself is written twice.
"""

from __future__ import annotations

import json
from string import Formatter

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import iteration_history, iteration_summaries, numbered_samples, text, without_response_format

DEFAULTS = {
    "student_system": "Work toward this goal: {instructional_goal}\n\nUse this breakdown of the task:\n{task_analysis}",
    "student_user": "{problem_text}",
    "reattempt_system": "{student_system}\n\nA teacher has given guidance. Say what you take from it, then solve again.",
    "reattempt_user": "{scaffolding_artifact}\n\n{problem_text}",
    "refine_system": "{student_system}\n\nImprove the reasoning and keep the final answer.",
    "refine_user": "{positive_feedback}\n\n{problem_text}",
    "evaluate_system": "Judge the response by each objective. Reply with one JSON object.",
    "evaluate_user": "Problem:\n{problem_text}\n\nResponse:\n{student_response}\n\nObjectives:\n{performance_objectives}\n\nTruth:\n{ground_truth}",
    "scaffold_system": "Write guidance for each objective that is not met, without the answer.",
    "scaffold_user": "Goal: {instructional_goal}\n\nTask:\n{task_analysis}\n\nProblem:\n{problem_text}\n\nResponse:\n{student_response}\n\nJudgement:\n{po_evaluation}\n\nBefore:\n{previous_iteration_summaries}",
    "praise_system": "Name what is strong in the response and what would make it better.",
    "praise_user": "Problem:\n{problem_text}\n\nResponse:\n{student_response}\n\nJudgement:\n{po_evaluation}",
    "solution_system": "Goal: {instructional_goal}\n\nTask:\n{task_analysis}\n\nWrite a full solution that ends in the boxed answer.",
    "solution_user": "Problem:\n{problem_text}\n\nTruth:\n{ground_truth}\n\nHistory:\n{iteration_history}",
    "goal": "State what a model should be able to do after learning {dataset} ({domain}), from {sample_count} samples. Reply with one JSON object.\n\n{train_data}",
    "analysis": "Break this goal into a tree of subskills: {instructional_goal}",
    "objectives": "Write performance objectives for the goal and its subskills. Reply with one JSON object.\n\nGoal: {instructional_goal}\n\n{task_analysis}",
}
# What stands for a missing goal, and the lengths shown of a response and of an analysis.
NO_GOAL = "solve the problem correctly"
RESPONSE_SHOWN = 2000
ANALYSIS_SHOWN = 1500


def table(spark: SparkSession | None = None, path: str | None = None) -> dict[str, str]:
    """The defaults, with the templates of a file over them."""
    if spark is None or path is None:
        return dict(DEFAULTS)
    return DEFAULTS | json.loads(spark.read.text(path, wholetext=True).first()["value"])


def fill(template: str, **fields: Column | str) -> Column:
    """A template with its fields put in; a null field is empty."""
    parts: list[Column] = []
    for before, name, _, _ in Formatter().parse(template):
        if before:
            parts.append(F.lit(before))
        if name:
            value = fields[name]
            parts.append(F.lit(value) if isinstance(value, str) else text(value))
    return F.concat(*parts) if parts else F.lit("")


def _headed(instruction: Column | None, prompt: Column) -> Column:
    """The dataset's instruction ahead, without its response format, where there is one."""
    if instruction is None:
        return prompt
    return F.when(text(instruction) != "", F.concat(without_response_format(instruction), F.lit("\n\n"), prompt)).otherwise(prompt)


def _task(prompts: dict[str, str], goal: str, analysis: str) -> Column:
    return fill(prompts["student_system"], instructional_goal=goal or NO_GOAL, task_analysis=analysis)


def student(prompts: dict[str, str], problem: Column, goal: str, analysis: str, instruction: Column | None = None) -> tuple[Column, Column]:
    """System and user prompt of a first attempt."""
    return _headed(instruction, _task(prompts, goal, analysis)), fill(prompts["student_user"], problem_text=problem)


def reattempt(prompts: dict[str, str], problem: Column, guidance: Column, goal: str, analysis: str, instruction: Column | None = None) -> tuple[Column, Column]:
    """System and user prompt of an attempt after guidance."""
    system = fill(prompts["reattempt_system"], student_system=_task(prompts, goal, analysis))
    return _headed(instruction, system), fill(prompts["reattempt_user"], scaffolding_artifact=guidance, problem_text=problem)


def refine(prompts: dict[str, str], problem: Column, praise: Column, goal: str, analysis: str) -> tuple[Column, Column]:
    """System and user prompt of the last polish; it carries no dataset instruction."""
    system = fill(prompts["refine_system"], student_system=_task(prompts, goal, analysis))
    return system, fill(prompts["refine_user"], positive_feedback=praise, problem_text=problem)


def evaluate(prompts: dict[str, str], problem: Column, response: Column, objectives: list[dict], truth: Column) -> tuple[Column, Column]:
    """The judging prompt, which shows the whole response."""
    shown = json.dumps(objectives, ensure_ascii=False, indent=2)
    user = fill(prompts["evaluate_user"], problem_text=problem, student_response=response, performance_objectives=shown, ground_truth=truth)
    return F.lit(prompts["evaluate_system"]), user


def scaffold(prompts: dict[str, str], problem: Column, response: Column, judgement: Column, summaries: Column, goal: str, analysis: str) -> tuple[Column, Column]:
    """The guidance prompt; of the earlier summaries it shows the last."""
    user = fill(
        prompts["scaffold_user"],
        problem_text=problem,
        student_response=F.left(text(response), F.lit(RESPONSE_SHOWN)),
        po_evaluation=judgement,
        task_analysis=analysis[:ANALYSIS_SHOWN],
        previous_iteration_summaries=iteration_summaries(_last(summaries)),
        instructional_goal=goal,
    )
    return F.lit(prompts["scaffold_system"]), user


def _last(entries: Column) -> Column:
    """An array's last entry, as an array."""
    return F.filter(entries, lambda _, i: i == F.size(entries) - 1)


def praise(prompts: dict[str, str], problem: Column, response: Column, judgement: Column) -> tuple[Column, Column]:
    user = fill(prompts["praise_user"], problem_text=problem, student_response=F.left(text(response), F.lit(RESPONSE_SHOWN)), po_evaluation=judgement)
    return F.lit(prompts["praise_system"]), user


def solution(prompts: dict[str, str], problem: Column, truth: Column, summaries: Column, goal: str, analysis: str) -> tuple[Column, Column]:
    """The prompt for a teacher's own solution, with every summary there is."""
    system = fill(prompts["solution_system"], instructional_goal=goal, task_analysis=analysis[:ANALYSIS_SHOWN])
    return system, fill(prompts["solution_user"], problem_text=problem, ground_truth=truth, iteration_history=iteration_history(summaries))


def goal(prompts: dict[str, str], domain: str, dataset: str, samples: Column) -> Column:
    """The design prompt of an array of samples: all are counted, the first twenty shown."""
    return fill(prompts["goal"], domain=domain, dataset=dataset, sample_count=F.size(samples).cast("string"), train_data=numbered_samples(samples))
