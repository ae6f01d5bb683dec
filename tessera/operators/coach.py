"""The coaching loop: a student answers, a teacher judges and guides, and every question ends with a training response."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prompts as ask
from ..functions import scaffold
from ..functions.answers import extract, grade, ground_truth
from ..functions.jsonfix import extract_object, strict_object
from ..functions.text import none_if_empty, strip, text
from ..plans import registry
from ..sources import sinks
from . import resume, stats
from .calls import Calls, Model
from .loop import all_satisfied, respond, small_batches, spread

EVALUATION = T.StructType(
    [
        T.StructField(
            "performance_evaluation",
            T.ArrayType(
                T.StructType([T.StructField("objective_content", T.StringType()), T.StructField("is_satisfied", T.BooleanType()), T.StructField("reasoning", T.StringType())])
            ),
        )
    ]
)
_SUMMARIES = "array<struct<iteration:int,summary:string>>"
_HISTORY = f"array<{registry.HISTORY.simpleString()}>"
# Fixed value: the feedback where a teacher gives none.
NO_FEEDBACK = "Review your previous response and try to address the unsatisfied objectives."


def coach(
    questions: DataFrame,
    student: Callable[[], Model],
    teacher: Callable[[], Model],
    answer_type: str,
    save: Callable[[DataFrame, int], DataFrame],
    goal: str = "",
    analysis: str = "",
    objectives: list[dict] | None = None,
    templates: dict[str, str] | None = None,
    max_iterations: int = 3,
    attempts: int = 3,
    backoff: float = 0.0,
    calls: Calls | None = None,
) -> DataFrame:
    """One result for each of ``questions`` (id, instruction, input, output).

    A round deals the unfinished rows out to all tasks and is one pass over them: the student's
    attempt, the teacher's judgement by ``objectives``, and guidance for what is
    not met, each asked only where the call before it left something to do.
    ``save`` writes a round and returns what it wrote, so no call runs twice. A
    question whose objectives are all met gets praise and a refined response; one
    that never meets them gets the teacher's own solution; one that fails is
    skipped with its reason. Judgements are read as JSON as they stand, and repaired
    only where that fails; ``calls`` are the rules of model calls. Without objectives, or without rounds to guide, the
    graded answer decides. Repeated ids are separate questions.
    """
    if max_iterations < 1:
        raise ValueError("the loop needs a round")
    said = templates or ask.table()
    call = lambda rows, prompt, model, name, **more: respond(rows, prompt, model, attempts, name, backoff, "__system", calls=calls, **more)
    problem, response = F.col("input"), F.col("response")
    none = lambda kind: F.lit(None).cast(kind)

    def prompted(rows: DataFrame, both: tuple, wanted=None) -> DataFrame:  # noqa: ANN001
        user = both[1] if wanted is None else F.when(wanted, both[1])
        return rows.withColumn("__system", both[0]).withColumn("__prompt", user)

    left = questions.select(
        "id",
        "instruction",
        "input",
        "output",
        none("string").alias("guidance"),
        F.array().cast(_SUMMARIES).alias("summaries"),
        F.lit(0).cast("bigint").alias("hot"),
        F.lit(0).cast("bigint").alias("lot"),
        none("int").alias("last_correct_iteration"),
        none("string").alias("last_correct_response"),
        F.array().cast(_HISTORY).alias("history"),
    )
    state = left.columns
    ended: list[DataFrame] = []
    for i in range(1, max_iterations + 1):
        first = ask.student(said, problem, goal, analysis, F.col("instruction"))
        again = ask.reattempt(said, problem, F.col("guidance"), goal, analysis, F.col("instruction"))
        got = call(prompted(spread(left), first if i == 1 else again), "__prompt", student, "response")
        got = got.withColumns({"predicted": extract(answer_type, text(response)), "__truth": ground_truth(F.col("output"))}).withColumn("correct", grade(answer_type, F.col("predicted"), F.col("__truth")))
        if objectives:
            got = call(prompted(got, ask.evaluate(said, problem, response, objectives, F.col("output"))), "__prompt", teacher, "judgement", read=(strict_object, extract_object))
            met = all_satisfied(F.from_json("judgement", EVALUATION)["performance_evaluation"])
        else:
            got, met = got.withColumn("judgement", none("string")), F.coalesce("correct", F.lit(False))
        got = got.withColumn("satisfied", F.col("error").isNull() & met)
        wanted = ~F.col("satisfied")
        guide = ask.scaffold(said, problem, response, F.col("judgement"), F.col("summaries"), goal, analysis)
        got = call(prompted(got, guide, wanted), "__prompt", teacher, "__guidance")
        summary = none_if_empty(scaffold.summary(text(F.col("__guidance"))))
        kinds = scaffold.skills(text(F.col("__guidance")))
        count = lambda kind: F.size(F.filter(kinds, lambda k: k == kind))  # noqa: B023, E731
        right = F.col("correct") & F.col("error").isNull()
        turn = lambda role, *said: F.array(F.struct(F.lit(i), F.lit(role), *said).cast(registry.HISTORY.simpleString()))  # noqa: B023, E731
        new = F.when(summary.isNotNull(), F.array(F.struct(F.lit(i).alias("iteration"), summary.alias("summary")))).otherwise(F.array().cast(_SUMMARIES))
        got = got.select(
            *("id", "instruction", "input", "output"),
            F.coalesce(none_if_empty(F.col("__guidance")), F.when(wanted, NO_FEEDBACK)).alias("guidance"),
            F.concat("summaries", new).alias("summaries"),
            (F.col("hot") + count("HOT")).alias("hot"),
            (F.col("lot") + count("LOT")).alias("lot"),
            F.when(right, F.lit(i)).otherwise(F.col("last_correct_iteration")).alias("last_correct_iteration"),
            F.when(right, response).otherwise(F.col("last_correct_response")).alias("last_correct_response"),
            F.concat("history", turn("student", response, none("string")), turn("teacher", F.col("__guidance"), F.col("judgement"))).alias("history"),
            *("response", "predicted", "correct", "judgement", "satisfied", "error"),
            F.lit(i).alias("iterations"),
        )
        with small_batches(questions.sparkSession):
            got = save(got, i)
        if i == max_iterations:
            ended.append(got)
            break
        ended.append(got.where("satisfied or error is not null"))
        left = got.where("not satisfied and error is null").select(*state)
        if left.isEmpty():
            break
    closed = _closed(spread(reduce(DataFrame.unionByName, ended)), call, prompted, student, teacher, said, goal, analysis)
    with small_batches(questions.sparkSession):
        return save(closed, max_iterations + 1)


def _guidance(history: Column) -> Column:
    """The guidance of each round that had any, parsed, with the round's summary."""
    given = F.filter(history, lambda h: (h["role"] == "teacher") & (text(h["response"]) != ""))
    parts = lambda c: F.transform(scaffold.artifacts(c), lambda a: F.struct(*[a[n].alias(n) for n in registry.ARTIFACT.names]))
    return F.transform(given, lambda h: F.struct(h["iteration"].alias("iteration"), parts(h["response"]).alias("artifacts"), none_if_empty(scaffold.summary(h["response"])).alias("summary")))


def _used(history: Column) -> Column:
    """What later attempts say they took from guidance, by round."""
    later = F.filter(history, lambda h: (h["role"] == "student") & (h["iteration"] > 1))
    told = F.transform(later, lambda h: F.struct(h["iteration"].alias("iteration"), scaffold.references(h["response"]).alias("references")))
    return F.filter(told, lambda r: F.size(r["references"]) > 0)


def _closed(rows: DataFrame, call, prompted, student, teacher, said: dict[str, str], goal: str, analysis: str) -> DataFrame:  # noqa: ANN001
    """Results of ended questions: praise or a solution from the teacher, then a refined response after praise."""
    problem, response, met = F.col("input"), F.col("response"), F.col("satisfied")
    good = ask.praise(said, problem, response, F.col("judgement"))
    rest = ask.solution(said, problem, F.col("output"), F.col("summaries"), goal, analysis)
    both = tuple(F.when(met, g).otherwise(r) for g, r in zip(good, rest, strict=True))
    got = call(prompted(rows, both), "__prompt", teacher, "__closing")
    got = call(prompted(got, ask.refine(said, problem, F.col("__closing"), goal, analysis), met & (text(F.col("__closing")) != "")), "__prompt", student, "__refined")
    fine = F.col("error").isNull()
    case = F.when(~fine, registry.SKIPPED).when(met & (F.col("iterations") == 1), registry.CASE_A).when(met, registry.CASE_B).otherwise(registry.CASE_C)
    some = lambda c: F.when(fine & (F.col(c) > 0), F.col(c))
    failed = fine & ~met
    held = lambda c: F.when(F.size(c) > 0, c)
    return got.select(
        "id",
        F.col("id").cast("string").alias("question_id"),
        *("instruction", "input", "output"),
        F.when(fine, F.when(met, response).otherwise(F.col("__closing"))).alias("initial_response"),
        F.when(fine, F.col("predicted")).alias("predicted_answer"),
        F.when(fine, F.col("correct")).alias("is_correct"),
        (fine & met).alias("scaffolding_correct"),
        case.alias("sft_case"),
        F.when(failed, F.col("__closing")).when(fine, F.coalesce("__refined", response)).alias("sft_response"),
        F.when(fine, F.col("iterations")).alias("iterations_needed"),
        some("hot").alias("hot_count"),
        some("lot").alias("lot_count"),
        F.when(failed, F.col("last_correct_iteration")).alias("last_correct_iteration"),
        F.when(failed, F.col("last_correct_response")).alias("last_correct_response"),
        F.col("error").alias("skip_reason"),
        held(_guidance(F.col("history"))).alias("scaffolding_artifacts"),
        held(_used(F.col("history"))).alias("artifact_references"),
        held(F.col("history")).alias("conversation_history"),
    )


def as_run(results: DataFrame) -> DataFrame:
    """Results with every column of a durable run, in its order; what is not there is null."""
    return results.select(*[(F.col(f.name) if f.name in results.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in registry.RUN.fields])


def resumed(spark: SparkSession, questions: DataFrame, path: str, run: Callable[[DataFrame, Callable[[DataFrame, int], DataFrame]], DataFrame], training: str | None = None, goal: str = "", analysis: str = "") -> str:
    """Runs what the durable log at ``path`` has not reached, commits it, and writes the training entries.

    ``run`` gets the questions that are left and a ``save`` that commits each
    round under the name of these very questions: a run that stops, for whatever
    reason, is found by the next one, which asks no model again for a round that
    was committed. Answers become visible with their epoch's manifest and not
    before. An older log beside ``path`` is taken in as the first epoch.

    Returns ``ended`` where no question was asked, else ``ran``.
    """
    from ..sources import epochs
    from ..sources.records import any_log
    from . import sft

    if not epochs.committed(spark, path) and (sinks.exists(spark, path + ".jsonl") or sinks.exists(spark, path + ".json")):
        epochs.commit(as_run(any_log(spark, path + ".json")), path, 0, stats.live_counts())
    left = resume.remaining(questions, epochs.read(spark, path, registry.RUN))
    size, mark = left.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(F.col("id").cast("string")).cast("decimal(38,0)")), F.lit(0))).first()
    if size:
        k = 1 + max((m["epoch"] for m in epochs.committed(spark, path)), default=-1)
        rounds = f"{path}/_rounds/{k}-{size}-{mark}"
        epochs.commit(as_run(run(left, lambda rows, i: epochs.once(rows, rounds, i))), path, k, stats.live_counts())
        epochs.remove(spark, rounds)
    if training:
        sinks.replace_lines(sft.entries(epochs.read(spark, path, registry.RUN), goal, analysis), training)
    return "ran" if size else "ended"


def designed(samples: DataFrame, model: Model, domain: str, dataset: str, order: str, templates: dict[str, str] | None = None, attempts: int = 3) -> dict:
    """Goal, task analysis and objectives of a dataset, once for all its rows.

    ``samples`` are the few that a design is made from (a sampling operator drew
    them). Three calls on the driver, each from the answer before it; a goal that
    is no JSON is read from its loose text, and objectives are asked again until
    each has a target.
    """
    import pandas as pd

    said = templates or ask.table()
    spark = samples.sparkSession
    shown = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "instruction", "input"))), lambda r: F.struct(r["instruction"].alias("instruction"), r["input"].alias("input")))
    prompt = samples.agg(shown.alias("samples")).select(ask.goal(said, domain, dataset, F.col("samples")).alias("p")).first()["p"]
    one = lambda p: str(model(pd.Series([p])).iloc[0])
    filled = lambda name, **fields: spark.range(1).select(ask.fill(said[name], **fields).alias("p")).first()["p"]

    raw = one(prompt)
    loose = scaffold.goal_fallback(F.col("raw"))
    fields = T.StructType([T.StructField(n, T.StringType()) for n in ("instructional_goal", "cognitive_level", "primary_verb", "rationale")])
    found = spark.createDataFrame([(raw, extract_object(raw))], "raw string, object string")
    goal = found.select(F.when(F.col("object").isNull(), loose).otherwise(F.from_json("object", fields)).alias("g")).first()["g"].asDict()
    analysis = spark.createDataFrame([(one(filled("analysis", instructional_goal=goal["instructional_goal"] or "")),)], "t string").select(strip(F.col("t")).alias("t")).first()["t"]
    asked = filled("objectives", instructional_goal=goal["instructional_goal"] or "", task_analysis=analysis)
    return goal | {"task_analysis": analysis, "performance_objectives": _objectives(one, asked, attempts)}


def _objectives(one: Callable[[str], str], prompt: str, attempts: int) -> list[dict]:
    import json

    for _ in range(attempts):
        held = json.loads(extract_object(one(prompt)) or "{}").get("performance_objectives")
        if isinstance(held, list) and all(isinstance(x, dict) and x.get("target") is not None and x.get("performance_objective") is not None for x in held):
            return held
    raise ValueError("the teacher gave no objectives with a target each")
