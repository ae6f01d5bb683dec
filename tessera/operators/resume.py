"""Resuming: what is left to do, and old results with new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remaining(questions: DataFrame, done: DataFrame, id_col: str = "id", done_col: str = "id") -> DataFrame:
    """Questions whose id no finished row has."""
    ids = done.select(F.col(done_col).alias("__done")).where("__done is not null")
    return questions.join(ids, questions[id_col] == F.col("__done"), "left_anti")


def merged(old: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """Old rows, and new ones of other ids."""
    return old.unionByName(remaining(new, old, id_col, id_col), allowMissingColumns=True)


def complete(questions: DataFrame, done: DataFrame, id_col: str = "id", done_col: str = "id") -> bool:
    return remaining(questions, done, id_col, done_col).isEmpty()
