"""Iterations of a question: judging, cutting, classifying, and the loop itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.answers import extract, grade
from ..functions.text import clip
from ..plans import registry
from .calls import Asker, Calls, Model, Reader


def all_satisfied(objectives: Column) -> Column:
    """Whether there are objectives and all are met; a missing verdict is not met."""
    return F.coalesce((F.size(objectives) > 0) & F.forall(objectives, lambda x: F.coalesce(x["is_satisfied"], F.lit(False))), F.lit(False))


def unmet(objectives: Column) -> Column:
    """Objectives said to be unmet; a missing verdict is not said."""
    return F.filter(objectives, lambda x: ~F.coalesce(x["is_satisfied"], F.lit(True)))


def satisfaction(verdict: Column) -> tuple[Column, Column]:
    """The same two of a group of rows, as aggregates: all met, and how many are said to be unmet."""
    return F.coalesce(F.bool_and(F.coalesce(verdict, F.lit(False))), F.lit(False)).alias("all_satisfied"), F.count_if(~verdict).alias("n_unmet")


def valid_objectives(objectives: Column) -> Column:
    """Whether each has a target and an objective; so of none."""
    return F.coalesce(F.forall(objectives, lambda x: x["target"].isNotNull() & x["performance_objective"].isNotNull()), F.lit(True))


def until_success(iterations: DataFrame, key: str, order: str, satisfied: str) -> DataFrame:
    """Iterations up to the first satisfied one."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max(F.col(satisfied).cast("int")).over(before), F.lit(0))
    return iterations.withColumn("__done", done).where("__done = 0").drop("__done")


def with_previous(iterations: DataFrame, key: str, order: str, response: str, name: str = "previous_response") -> DataFrame:
    return iterations.withColumn(name, F.lag(response).over(Window.partitionBy(key).orderBy(order)))


def classify(iterations: DataFrame, key: str, order: str, satisfied: str, max_iterations: int, failed: Column | None = None) -> DataFrame:
    """Per question: case, first satisfied iteration, and how many were needed.

    One grouped aggregate with partial sums; no window and no collected group.
    """
    error = F.lit(False) if failed is None else failed
    got = iterations.groupBy(key).agg(F.min(F.when(F.col(satisfied), F.col(order))).alias("first_success"), F.max(error).alias("__failed"))
    case = F.when(F.col("__failed"), registry.SKIPPED).when(F.col("first_success") == 1, registry.CASE_A).when(F.col("first_success") > 1, registry.CASE_B).otherwise(registry.CASE_C)
    return got.select(key, case.alias("sft_case"), F.col("first_success").cast("bigint").alias("first_success"), F.coalesce("first_success", F.lit(max_iterations)).cast("bigint").alias("iterations_needed"))


def last_correct(iterations: DataFrame, key: str, order: str, correct: str, response: str) -> DataFrame:
    """The last correct iteration of each question that has one, with its response."""
    ok = iterations.where(F.col(correct))
    return ok.groupBy(key).agg(F.max(order).alias("last_iteration"), F.max_by(response, order).alias("response"))


def history(iterations: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """Each question's iterations as one ordered array."""
    return iterations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("iteration"), *fields))).alias("history"))


#: Questions that a task holds as Python objects at once.
_PIECE = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside sends rows to Python in batches of a piece: of long rows a few model passes in each of a machine's tasks hold one at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, str(min(_PIECE, int(held)) if int(held) > 0 else _PIECE))
    try:
        yield
    finally:
        spark.conf.set(name, held)


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt out evenly to twice as many tasks as run at once.

    Calls take far longer than rows do to move, and a small table is one file and
    one task, however many questions it has.
    """
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def respond(
    rows: DataFrame,
    prompt: str,
    factory: Callable[[], Model],
    attempts: int = 3,
    name: str = "response",
    backoff: float = 0.0,
    system: str | None = None,
    read: Reader | Sequence[Reader] = (),
    calls: Calls | None = None,
    how: str | None = None,
) -> DataFrame:
    """Adds a model's response, and the error of a question that got none.

    The model is made once per task and asked in batches, with the ``system``
    column's messages as a second argument where one is named, by the rules of
    ``calls`` (``attempts`` and ``backoff`` are short for rules of no others). A
    batch that fails is asked again question by question, so one bad question ends
    neither the run nor its neighbours. ``read`` turns a response into what is
    kept; of several readers the first that can read it does, and ``how`` names a
    column for its number. Where none can the question is asked again alone. A
    failed question carries its error, cut short. A null prompt, or a row that has
    an error already, is not asked, so that calls follow each other in one pass
    over the rows.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    rules = calls or Calls(attempts, backoff)
    readers = (read,) if callable(read) else tuple(read)
    kept = [f for f in rows.schema.fields if f.name != "error"]
    held = "error" in rows.columns
    counted = [T.StructField(how, T.IntegerType())] if how else []
    schema = T.StructType([*kept, T.StructField(name, T.StringType()), *counted, T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Asker(factory(), rules, readers) as asker:
            for batch in (b.slice(k, _PIECE) for b in batches for k in range(0, b.num_rows, _PIECE)):
                columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                errors = columns["error"].to_pylist() if held else [None] * batch.num_rows
                asked = pd.DataFrame({c: columns[c].to_pylist() for c in (prompt, system) if c}, dtype=object)
                at = [i for i, x in enumerate(asked[prompt]) if x is not None and errors[i] is None]
                answers: list[str | None] = [None] * batch.num_rows
                reading: list[int | None] = [None] * batch.num_rows
                for i, said in zip(at, asker.ask(asked.iloc[at]), strict=True):
                    answers[i], reading[i], errors[i] = said
                out = [*(columns[f.name] for f in kept), pa.array(answers, pa.string()), *([pa.array(reading, pa.int32())] if how else []), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    got = rows.mapInArrow(run, schema)
    return got.withColumn("error", clip(F.col("error"), 500))


def run_loop(
    questions: DataFrame,
    student: Callable[[], Model],
    answer_type: str,
    save: Callable[[DataFrame, int], DataFrame],
    max_iterations: int = 5,
    scaffold: Callable[[DataFrame], Column] | None = None,
    calls: Calls | None = None,
) -> DataFrame:
    """Respond, grade and try again, at most ``max_iterations`` rounds over what is unfinished.

    ``questions`` has id, prompt and truth. Each round is one Arrow-batched
    model pass over the unfinished rows; ``save`` writes the round and returns
    what it wrote, so that no round's model calls run twice. Returns all rounds.
    """
    left = questions.select("id", "prompt", "truth")
    rounds: list[DataFrame] = []
    for i in range(1, max_iterations + 1):
        got = respond(spread(left), "prompt", student, calls=calls)
        got = got.withColumn("iteration", F.lit(i)).withColumn("predicted", extract(answer_type, F.coalesce("response", F.lit(""))))
        got = save(got.withColumn("is_correct", grade(answer_type, F.col("predicted"), F.col("truth"))), i)
        rounds.append(got)
        left = got.where("not is_correct and error is null")
        hint = scaffold(left) if scaffold else F.concat(F.col("prompt"), F.lit(f"\n\n[Attempt {i + 1}]"))
        left = left.select("id", hint.alias("prompt"), "truth")
        if left.isEmpty():
            break
    out = rounds[0]
    for one in rounds[1:]:
        out = out.unionByName(one)
    return out
