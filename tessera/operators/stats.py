"""Counters, accuracies and reports over logs and evaluation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import registry


def rate(part: Column, whole: Column) -> Column:
    """The share as a double; 0 of nothing."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def distinct_ids(log: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows with an id, one for each."""
    return log.where(F.nullif(F.col(id_col), F.lit("")).isNotNull()).dropDuplicates([id_col])


def case_counts(case: Column) -> list[Column]:
    count = lambda x: F.count_if(F.coalesce(case == x, F.lit(False)))
    return [count(registry.CASE_A).alias("case_a"), count(registry.CASE_B).alias("case_b"), count(registry.CASE_C).alias("case_c"), count(registry.SKIPPED).alias("skipped")]


def skill_counts(artifacts: Column) -> tuple[Column, Column]:
    """High- and low-order guidance in nested arrays, per row and without exploding."""
    flat = F.flatten(F.transform(artifacts, lambda x: F.coalesce(F.transform(x["artifacts"], lambda a: a["skill_type"]), F.array().cast("array<string>"))))
    of = lambda kind: F.when(flat.isNull(), 0).otherwise(F.size(F.filter(flat, lambda a: a == kind)))
    return of("HOT"), of("LOT")


def case_statistics(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (per group): processed, counts by case, successes and their share."""
    got = distinct_ids(log).groupBy(*(by or [])).agg(F.count("*").alias("processed"), *case_counts(F.col("sft_case")))
    total = F.col("case_a") + F.col("case_b")
    return got.withColumn("success_total", total).withColumn("success_rate", rate(total, F.col("processed")))


def live_counts() -> dict[str, Column]:
    """What a run counts while it writes: rows by case, and guidance of both orders."""
    names = ("case_a", "case_b", "case_c", "skipped")
    cases = dict(zip(names, case_counts(F.col("sft_case")), strict=True))
    high, low = skill_counts(F.col("scaffolding_artifacts"))
    return {"processed": F.count(F.lit(1)), **cases, "hot": F.coalesce(F.sum(high), F.lit(0)), "lot": F.coalesce(F.sum(low), F.lit(0))}


def summed(manifests: list[dict]) -> dict[str, float]:
    """The counters of a run from its manifests, without reading a row: ids are once in a run."""
    total = {k: sum(m["counts"][k] for m in manifests) for k in ("processed", "case_a", "case_b", "case_c", "skipped", "hot", "lot")}
    good = total["case_a"] + total["case_b"]
    return total | {"success_total": good, "success_rate": good / total["processed"] if total["processed"] else 0.0}


def accuracy(rows: DataFrame, by: list[str] | None = None, correct: str = "is_correct") -> DataFrame:
    """Evaluated rows, correct ones and their share of the evaluated."""
    got = rows.groupBy(*(by or [])).agg(F.count("*").alias("evaluated"), F.count_if(F.coalesce(F.col(correct), F.lit(False))).alias("correct"))
    return got.withColumn("accuracy", rate(F.col("correct"), F.col("evaluated")))


def histogram(rows: DataFrame, value: Column, name: str) -> DataFrame:
    return rows.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def legacy_case(case: Column, correct: Column) -> Column:
    """The case of an older log: its letter, else A where the first try was correct."""
    named = F.create_map(*[F.lit(x) for p in registry.LEGACY_CASES.items() for x in p])
    return F.coalesce(F.try_element_at(named, case), F.when(case.isin(*registry.LEGACY_CASES.values(), registry.SKIPPED), case), F.when(correct, registry.CASE_A))


def renamed_case(case: Column, correct: Column) -> Column:
    """A case under its current name; an old B that was not correct is a C, other names stay."""
    named = F.create_map(*[F.lit(x) for p in registry.LEGACY_CASES.items() for x in p])
    return F.when((case == "B") & ~F.coalesce(correct, F.lit(False)), registry.CASE_C).otherwise(F.coalesce(F.try_element_at(named, case), case))


def report(scores: DataFrame, model: str, dataset: str, variant: str, score: str, variants: tuple[str, str]) -> DataFrame:
    """Per model the mean over datasets before and after, and the difference; all models as a last row."""
    wide = scores.groupBy(model, dataset).pivot(variant, list(variants)).agg(F.avg(score))
    one, two = variants
    got = wide.rollup(model).agg(F.avg(one).alias(one), F.avg(two).alias(two))
    return got.withColumn("delta", F.col(two) - F.col(one))


def domain_report(scores: DataFrame, model: str, dataset: str, variant: str, score: str, variants: tuple[str, str], home: Column) -> DataFrame:
    """Means before and after, their difference, and the gap between home and other datasets.

    One pass of grouping sets: each model's home datasets, its others, all of its
    own, and all models'. ``part`` says which (from ``grouping_id``); ``gap`` is
    what the home part gained beyond the others, on the model's own row.
    """
    one, two = variants
    wide = scores.withColumn("__home", home).groupBy(model, dataset, "__home").pivot(variant, list(variants)).agg(F.avg(score))
    means = [F.avg(one).alias(one), F.avg(two).alias(two), F.count("*").alias("datasets"), F.grouping_id().alias("__g")]
    mean = lambda c, h: F.avg(F.when(F.col("__home") == h, F.col(c)))
    gap = (mean(two, True) - mean(one, True) - mean(two, False) + mean(one, False)).alias("gap")
    got = wide.groupingSets([[F.col(model), F.col("__home")], [F.col(model)], []], F.col(model), F.col("__home")).agg(*means, gap)
    part = F.when(F.col("__g") == 3, "all").when(F.col("__g") == 1, "model").when(F.col("__home"), "home").otherwise("away")
    return got.select(model, part.alias("part"), "datasets", one, two, (F.col(two) - F.col(one)).alias("delta"), F.when(F.col("__g") > 0, F.col("gap")).alias("gap"))


def case_shares(log: DataFrame, by: str) -> DataFrame:
    """Per group and over all: rows with an id, and the share of each case among them."""
    got = distinct_ids(log).rollup(by).agg(F.count("*").alias("processed"), *case_counts(F.col("sft_case")))
    return got.select(by, "processed", *[rate(F.col(c), F.col("processed")).alias(f"{c}_share") for c in ("case_a", "case_b", "case_c", "skipped")])
