"""Training entries from a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import none_if_empty, text, without_response_format
from ..plans import registry

FIRST = ("id", "instruction", "input", "output")


def public_columns(df: DataFrame) -> DataFrame:
    """Without columns that start with an underscore; nested fields stay."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def ordered_columns(df: DataFrame) -> DataFrame:
    """Identity, question and answer first."""
    lead = [c for c in FIRST if c in df.columns]
    return df.select(*lead, *[c for c in df.columns if c not in lead])


def log_view(df: DataFrame) -> DataFrame:
    return ordered_columns(public_columns(df))


def instruction(original: Column, goal: str = "", analysis: str = "", template: str = "{goal}\n\n{analysis}") -> Column:
    """The record's own, the learning task after it where there is one, or a default."""
    has = text(original) != ""
    if goal and analysis:
        task = F.lit(template.replace("{goal}", goal).replace("{analysis}", analysis))
        return F.when(has, F.concat(without_response_format(original), F.lit("\n\n"), task)).otherwise(task)
    return F.when(has, original).otherwise(registry.DEFAULT_INSTRUCTION)


def entries(log: DataFrame, goal: str = "", analysis: str = "") -> DataFrame:
    """One entry for each row of a case A, B or C that has a response."""
    output = F.coalesce(none_if_empty(F.col("sft_response")), none_if_empty(F.col("initial_response")))
    kept = log.where(F.col("sft_case").isin(registry.CASE_A, registry.CASE_B, registry.CASE_C)).withColumn("__out", output).where("__out is not null")
    return kept.select(
        instruction(F.col("instruction"), goal, analysis).alias("instruction"),
        F.concat(F.lit("Question: "), F.col("input")).alias("input"),
        F.col("__out").alias("output"),
        F.struct(F.col("id"), F.col("sft_case"), F.col("output").alias("ground_truth")).alias("metadata"),
    )
