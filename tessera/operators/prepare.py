"""Normalising raw datasets to one record shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import boxed_shallow
from ..functions.text import none_if_empty, strip, text
from ..plans import registry


def answer_output(answer: Column, reasoning: Column | None = None) -> Column:
    """The answer in its box, after the reasoning where there is any."""
    final = F.concat(F.lit("The answer is \\boxed{"), answer, F.lit("}"))
    if reasoning is None:
        return final
    return F.when(strip(text(reasoning)) != "", F.concat(strip(reasoning), F.lit("\n\n"), final)).otherwise(final)


def lettered(options: Column) -> Column:
    """Options as lines that start with A., B. and so on."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x)), "\n")


def choice_input(question: Column, options: Column) -> Column:
    return strip(F.concat(question, F.lit("\n\n"), lettered(options)))


def letter(index: Column) -> Column:
    return F.char(index.cast("int") + 65)


def key_letter(key: Column) -> Column:
    """A numbered key counts from 1; a letter stays."""
    return F.when(key.rlike(r"(?U)^\d+$"), F.char(F.try_add(key.try_cast("int"), F.lit(64)))).otherwise(key)


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("No")


def looked_up(key: Column, values: dict, default: str | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(pairs, key)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def meta(**fields: Column) -> Column:
    """A string map; a missing value is empty."""
    parts = [x for k, c in fields.items() for x in (F.lit(k), text(c))]
    return F.create_map(*parts) if parts else F.create_map().cast("map<string,string>")


def record(rows: DataFrame, instruction: Column, question: Column, output: Column, metadata: Column | None = None) -> DataFrame:
    return rows.select(instruction.alias("instruction"), question.alias("input"), output.alias("output"), (meta() if metadata is None else metadata).alias("metadata"))


def _prompt(kind: str) -> Column:
    return F.lit(registry.PROMPTS[kind])


def gsm8k(rows: DataFrame, reasoning: bool = False) -> DataFrame:
    """``question, answer`` where the answer is reasoning, ####, number."""
    parts = F.split("answer", "####")
    marked = F.contains(F.col("answer"), F.lit("####"))
    answer = F.when(marked, strip(F.get(parts, F.lit(1)))).otherwise(F.col("answer"))
    why = F.when(marked, strip(F.get(parts, F.lit(0)))).otherwise("")
    return record(rows, _prompt("math"), F.col("question"), answer_output(answer, why if reasoning else None))


def math(configs: dict[str, DataFrame], reasoning: bool = False) -> DataFrame:
    """``problem, solution, level, type`` of every configuration there is."""
    rows = reduce(DataFrame.unionByName, configs.values())
    answer = F.coalesce(none_if_empty(boxed_shallow(F.col("solution"))), F.lit("See solution"))
    return record(
        rows, _prompt("math"), F.col("problem"), answer_output(answer, F.col("solution") if reasoning else None), meta(level=F.col("level"), type=F.col("type"))
    )


def svamp(rows: DataFrame) -> DataFrame:
    question = strip(F.concat_ws(" ", "Body", "Question"))
    return record(rows, _prompt("math"), question, answer_output(F.col("Answer").cast("string")), meta(id=F.col("ID"), equation=F.col("Equation"), type=F.col("Type")))


def asdiv(rows: DataFrame) -> DataFrame:
    question = strip(F.concat_ws(" ", "body", "question"))
    answer = F.get(F.split(strip(F.col("answer")), r"(?U)\s+"), F.lit(0))
    out = record(rows, _prompt("math"), question, answer_output(answer), meta(solution_type=F.col("solution_type"), formula=F.col("formula")))
    return out.where("input <> ''")


def mawps(rows: DataFrame) -> DataFrame:
    """The result, or its float form in data without that column."""
    held = next((F.col(c).cast("string") for c in ("result", "result_float") if c in rows.columns), F.lit(""))
    out = record(rows, _prompt("math"), F.col("question"), answer_output(held), meta(id=F.col("id"), equation=F.col("equation"), expression=F.col("expression")))
    return out.where(text(F.col("input")) != "")


def reclor(rows: DataFrame) -> DataFrame:
    question = strip(F.concat(F.lit("Context:\n"), text(F.col("context")), F.lit("\nQuestion: "), text(F.col("question")), F.lit("\nOptions:\n"), lettered(F.col("answers"))))
    return record(rows, _prompt("mcq"), question, answer_output(letter(F.coalesce("label", F.lit(0)))), meta(id=F.col("id_string")))


def arc(rows: DataFrame) -> DataFrame:
    """``question, choices.text, answerKey, id``."""
    return record(rows, _prompt("mcq"), choice_input(F.col("question"), F.col("choices.text")), answer_output(key_letter(F.col("answerKey"))), meta(id=F.col("id")))


def strategyqa(rows: DataFrame) -> DataFrame:
    facts = meta(qid=F.col("qid"), term=F.col("term"), description=F.col("description"), facts=F.col("facts"))
    return record(rows, _prompt("boolean"), F.col("question"), answer_output(yes_no(F.col("answer"))), facts)


def openbookqa(rows: DataFrame) -> DataFrame:
    held = meta(id=F.col("id"), fact1=F.col("fact1"), humanScore=F.col("humanScore"), clarity=F.col("clarity"))
    return record(rows, _prompt("mcq"), choice_input(F.col("question_stem"), F.col("choices.text")), answer_output(key_letter(F.col("answerKey"))), held)


def anli(rows: DataFrame) -> DataFrame:
    options = F.lit("\n\nA. entailment\nB. neutral\nC. contradiction")
    question = F.concat(F.lit("Premise: "), F.col("premise"), F.lit("\nHypothesis: "), F.col("hypothesis"), options)
    return record(rows, _prompt("mcq"), question, answer_output(looked_up(F.col("label").cast("int"), registry.ANLI_LABELS)), meta(uid=F.col("uid"), reason=F.col("reason")))


def bbh(subtasks: dict[str, DataFrame], prompts: dict[str, str] | None = None) -> DataFrame:
    """``input, target`` of every subtask, each with its prompt or the common one."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("subtask", F.lit(name)) for name, df in subtasks.items()])
    prompt = looked_up(F.col("subtask"), prompts, registry.PROMPTS["text"]) if prompts else _prompt("text")
    return record(rows, prompt, F.col("input"), answer_output(F.col("target")), meta(subtask=F.col("subtask")))


def enrich(records: DataFrame, goal: str, analysis: str) -> DataFrame:
    """Two design constants into every record's metadata, over what it had there."""
    keys = F.array(F.lit("instructional_goal"), F.lit("task_analysis"))
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(keys, k))
    new = F.create_map(F.lit("instructional_goal"), F.lit(goal), F.lit("task_analysis"), F.lit(analysis))
    return records.select("instruction", "input", "output", F.map_concat(kept, new).alias("metadata"))


def enrich_from(records: DataFrame, design: DataFrame) -> DataFrame:
    """The same from a table of one row, which is broadcast: its size is one row."""
    keys = F.array(F.lit("instructional_goal"), F.lit("task_analysis"))
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(keys, k))
    one = design.limit(1).select(F.col("instructional_goal").alias("__g"), F.col("task_analysis").alias("__a"))
    new = F.create_map(F.lit("instructional_goal"), F.col("__g"), F.lit("task_analysis"), F.col("__a"))
    return records.crossJoin(F.broadcast(one)).select("instruction", "input", "output", F.map_concat(kept, new).alias("metadata"))
