"""Registered queries of the coaching loop, of design and of prompts, with stub models that SQL can follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prompts
from ..operators import coach, prepare, sample, stats
from ..session import work_path
from ..sources import epochs, records, sinks
from . import registry
from .catalogue import ITER, _iterations, _saved, _t
from .round_trips import query

#: Short templates, whose text the stubs read.
_SHORT = prompts.DEFAULTS | {
    "reattempt_user": "{scaffolding_artifact}|{problem_text}",
    "refine_user": "refine|{positive_feedback}|{problem_text}",
    "evaluate_user": "judge|{student_response}",
    "scaffold_user": "guide|{problem_text}|{previous_iteration_summaries}",
    "praise_user": "praise|{student_response}",
    "solution_user": "solve|{problem_text}|{iteration_history}",
}
_OBJECTIVES = [{"target": "t", "performance_objective": "the answer is right"}]


def _student():  # noqa: ANN202
    """By the number in the problem, mod 5: right at once, on the second attempt, on the third, never, or failing."""

    def one(prompt: str) -> str:
        if prompt.startswith("refine|"):
            return "refined " + prompt.split("|")[1]
        n = int(prompt.rsplit("#", 1)[1])
        if n % 5 == 4:
            raise ValueError(f"no answer to {n}")
        tries = 1 + prompt.count("look") if prompt.startswith("[") else 1
        return f"\\boxed{{{n}}}" if n % 5 != 3 and tries > n % 5 else f"try {tries} \\boxed{{0}}"

    return lambda asked, _: asked.map(one)


def _teacher():  # noqa: ANN202
    """Judges in a fence, guides with one look more than it sees before, praises and solves."""

    def one(prompt: str) -> str:
        kind, _, rest = prompt.partition("|")
        if kind == "judge":
            met = "false" if "try" in rest else "true"
            return f'So:\n```json\n{{"performance_evaluation": [{{"objective_content": "o", "is_satisfied": {met}}}]}}\n```'
        if kind == "guide":
            look = "look " * (1 + rest.count("seen"))
            part = f"[Scaffolding for Task [1] (High Order Skill)]:\n- Target Objective: t\n- Suggested Strategy:\n{look}\n"
            low = "[Scaffolding for Task [2] (Low Order Skill)]:\n- Target Objective: u\n- Brief Explanation: e\n"
            return f"{part}{low}[Feedback]\nagain\n[Iteration Summary]\n{'seen ' * (1 + rest.count('seen'))}"
        if kind == "praise":
            return "" if rest == "\\boxed{0}" else "good"
        return "solved " + rest.partition("|")[2]

    return lambda asked, _: asked.map(one)


@query(rf"""WITH q AS (SELECT c_custkey AS id, c_custkey % 5 AS k, chr(92) || 'boxed{{' || c_custkey || '}}' AS boxed FROM customer)
SELECT id, CASE k WHEN 0 THEN '{registry.CASE_A}' WHEN 3 THEN '{registry.CASE_C}' WHEN 4 THEN 'skipped' ELSE '{registry.CASE_B}' END AS sft_case,
CASE WHEN k < 3 THEN boxed WHEN k = 3 THEN 'solved Iter 1: seen' || chr(10) || 'Iter 2: seen seen' || chr(10) || 'Iter 3: seen seen seen' END AS initial_response,
CASE WHEN id = 0 THEN boxed WHEN k < 3 THEN 'refined good' WHEN k = 3 THEN 'solved Iter 1: seen' || chr(10) || 'Iter 2: seen seen' || chr(10) || 'Iter 3: seen seen seen' END AS sft_response,
CASE WHEN k < 3 THEN CAST(id AS VARCHAR) WHEN k = 3 THEN '0' END AS predicted_answer, k < 3 AS scaffolding_correct,
CASE WHEN k < 3 THEN k + 1 WHEN k = 3 THEN 3 END AS iterations_needed, CASE WHEN k IN (1, 2, 3) THEN k END AS hot_count, CASE WHEN k IN (1, 2, 3) THEN k END AS lot_count,
CASE WHEN k = 4 THEN 'no answer to ' || id END AS skip_reason FROM q""")
def coached_loop(spark: SparkSession, d: str) -> DataFrame:
    """Every customer as a question through attempts, judgement, guidance, praise, refinement or solution."""
    c = _t(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    questions = c.select(F.col("c_custkey").alias("id"), F.lit("").alias("instruction"), F.concat(F.lit("what is #"), key).alias("input"), prepare.answer_output(key).alias("output"))
    got = coach.coach(questions, _student, _teacher, "numeric", _saved(spark), "count", "step by step", _OBJECTIVES, _SHORT, 3, attempts=2)
    return got.select("id", "sft_case", "initial_response", "sft_response", "predicted_answer", "scaffolding_correct", "iterations_needed", "hot_count", "lot_count", "skip_reason")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'first' ELSE 'second' END AS sft_response, 'ran,ran,ended' AS kinds FROM customer")
def coached_resume(spark: SparkSession, d: str) -> DataFrame:
    """A run over part of the questions, one over the rest, and one with nothing left."""
    path = work_path(spark, "resumed")
    all_ = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    answer = lambda word: lambda left, save: save(left.select("id", F.lit(registry.CASE_A).alias("sft_case"), F.lit(word).alias("sft_response")), 1)
    part = all_.where(F.col("id").cast("bigint") % 3 == 0)
    kinds = [coach.resumed(spark, rows, path, answer(word)) for rows, word in ((part, "first"), (all_, "second"), (all_, "third"))]
    return epochs.read(spark, path, registry.RUN).select("id", "sft_response", F.lit(",".join(kinds)).alias("kinds"))


def _stopping(at: int | None):  # noqa: ANN202
    """The student of the loop; asked a second time about ``at`` its process ends, as an executor's does that is lost."""

    def factory():  # noqa: ANN202
        model = _student()

        def asked(prompts, system):  # noqa: ANN001, ANN202
            if at is not None and any(p.startswith("look") or p.startswith("[") for p in prompts) and any(p.endswith(f"#{at}") for p in prompts):
                raise SystemExit("stopped on purpose")
            return model(prompts, system)

        return asked

    return factory


@query(rf"""WITH q AS (SELECT c_custkey AS id, c_custkey % 5 AS k, chr(92) || 'boxed{{' || c_custkey || '}}' AS boxed FROM customer)
SELECT CAST(id AS VARCHAR) AS id, CASE k WHEN 0 THEN '{registry.CASE_A}' WHEN 3 THEN '{registry.CASE_C}' WHEN 4 THEN 'skipped' ELSE '{registry.CASE_B}' END AS sft_case,
CASE WHEN k < 3 THEN k WHEN k = 3 THEN 3 ELSE 0 END AS guided, CASE WHEN k < 3 THEN k + 1 WHEN k = 3 THEN 3 ELSE 1 END AS attempts,
CASE WHEN k < 4 THEN CASE WHEN id = 0 OR k = 3 THEN 'plain' ELSE 'refined' END ELSE 'none' END AS entry,
'stopped,1,ran,ended' AS kinds, true AS counted FROM q""")
def stopped_run(spark: SparkSession, d: str) -> DataFrame:
    """A run whose task is lost in the second round, found and ended by the next one, and its training entries.

    The second run asks nothing again of the first round: ``kinds`` has the rounds that
    were committed when the first run stopped. ``counted``: the counters observed
    while the log was written are those of the rows.
    """
    path = work_path(spark, "stopped")
    c = _t(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    questions = c.select(key.alias("id"), F.lit("").alias("instruction"), F.concat(F.lit("what is #"), key).alias("input"), prepare.answer_output(key).alias("output"))
    run = lambda student: lambda left, save: coach.coach(left, student, _teacher, "numeric", save, "count", "step by step", _OBJECTIVES, _SHORT, 3, attempts=2)
    kinds = []
    try:
        coach.resumed(spark, questions, path, run(_stopping(1)), f"{path}-training")
    except Exception:  # noqa: BLE001  the stop that is meant
        kinds.append("stopped")
    rounds = records.folders(spark, f"{path}/_rounds")
    kinds += [str(len(epochs.committed(spark, f"{path}/_rounds/{r}"))) for r in rounds]
    kinds += [coach.resumed(spark, questions, path, run(_stopping(None)), f"{path}-training") for _ in range(2)]
    log = epochs.read(spark, path, registry.RUN)
    whole = stats.case_statistics(log).first().asDict()
    live = stats.summed(epochs.committed(spark, path))
    counted = all(live[k] == whole[k] for k in whole)
    entries = spark.read.json(f"{path}-training").select("metadata.id", F.when(F.col("output").startswith("refined"), "refined").otherwise("plain").alias("entry"))
    attempts = F.size(F.filter("conversation_history", lambda h: h["role"] == "student"))
    got = log.join(entries, "id", "left").select("id", "sft_case", F.greatest(F.size(F.coalesce("scaffolding_artifacts", F.array().cast(log.schema["scaffolding_artifacts"].dataType))), F.lit(0)).alias("guided"), attempts.alias("attempts"), F.coalesce("entry", F.lit("none")).alias("entry"))
    return got.withColumn("kinds", F.lit(",".join(kinds))).withColumn("counted", F.lit(counted))


@query("""SELECT doc_id, 'Do.' || chr(10) || chr(10) || 'Goal solve the problem correctly, task <a{b}>' AS system, 'Do.' || chr(10) || chr(10) || 'Goal g, task <a{b}> Again.' AS again,
coalesce(text, '') AS judged, left(coalesce(text, ''), 2000) AS praised, 'Goal g, task ' || repeat('x', 1500) AS solver FROM documents""")
def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts from a table of templates in a file: a missing goal, a cut response, a whole one, a cut analysis."""
    path = work_path(spark, "templates") + ".json"
    short = {"student_system": "Goal {instructional_goal}, task {task_analysis}", "reattempt_system": "{student_system} Again.", "evaluate_user": "{student_response}", "praise_user": "{student_response}", "solution_system": "Goal {instructional_goal}, task {task_analysis}"}
    sinks.write_object(spark, path, short)
    said = prompts.table(spark, path)
    t, do = F.col("text"), F.lit("Do.\n\n## Response Format\nso")
    return _t(spark, d, "documents").select(
        "doc_id",
        prompts.student(said, t, "", "<a{b}>", do)[0].alias("system"),
        prompts.reattempt(said, t, t, "g", "<a{b}>", do)[0].alias("again"),
        prompts.evaluate(said, t, t, _OBJECTIVES, t)[1].alias("judged"),
        prompts.praise(said, t, t, F.lit("{}"))[1].alias("praised"),
        prompts.solution(said, t, t, F.array().cast("array<struct<iteration:int,summary:string>>"), "g", "x" * 1600)[0].alias("solver"),
    )


@query(f"""WITH {ITER}, s AS (SELECT conv_id, iteration, response, row_number() OVER (PARTITION BY conv_id ORDER BY iteration DESC) AS back FROM iter)
SELECT conv_id, coalesce(max(CASE WHEN back = 1 THEN '[Iteration ' || iteration || ' Summary]' || chr(10) || response END), '') AS last_only,
string_agg('Iter ' || iteration || ': ' || response, chr(10) ORDER BY iteration) AS whole FROM s WHERE response <> '' GROUP BY conv_id""")
def prompt_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Guidance sees the last summary, a solution all of them."""
    said = prompts.DEFAULTS | {"scaffold_user": "{previous_iteration_summaries}", "solution_user": "{iteration_history}"}
    entry = F.struct(F.col("iteration").cast("int").alias("iteration"), F.col("response").alias("summary"))
    held = _iterations(spark, d).where("response <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("s"))
    x = F.lit("")
    return held.select("conv_id", prompts.scaffold(said, x, x, x, F.col("s"), "", "")[1].alias("last_only"), prompts.solution(said, x, x, F.col("s"), "", "")[1].alias("whole"))


@query("""SELECT 'Count to ' || n AS goal, 'Apply' AS level, '├── one' AS analysis, 'one|two' AS targets FROM (SELECT count(*) AS n FROM (SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 30))""")
def design_agents(spark: SparkSession, d: str) -> DataFrame:
    """Goal, analysis and objectives from a drawn sample, written as a design file and read again."""
    asked = {"objectives": 0}

    def model(said):  # noqa: ANN001, ANN202
        prompt = said.iloc[0]
        if prompt.startswith("goal"):
            n, shown = prompt.split("|")[1], prompt.count("### Sample ")
            return said.map(lambda _: f'{{"instructional_goal": "Count to {n}", "cognitive_level": "Apply"}}' if shown == 20 else "")
        if prompt.startswith("analysis"):
            return said.map(lambda _: " ├── one\n")
        asked["objectives"] += 1  # the first reply has no targets
        if asked["objectives"] == 1:
            return said.map(lambda _: '{"performance_objectives": [{"performance_objective": "p"}]}')
        return said.map(lambda _: '{"performance_objectives": [{"target": "one", "performance_objective": "p"}, {"target": "two", "performance_objective": "q"}]}')

    docs = _t(spark, d, "documents").select("doc_id", F.lit("Do it.").alias("instruction"), F.col("text").alias("input"), "lang", "n_chars", "source")
    drawn = sample.extract_samples(docs, 30, "random", F.col("n_chars"), F.col("lang"), F.col("source"), "doc_id")
    said = prompts.DEFAULTS | {"goal": "goal|{sample_count}|{train_data}", "analysis": "analysis|{instructional_goal}", "objectives": "objectives|{task_analysis}"}
    path = work_path(spark, "design") + ".json"
    sinks.write_object(spark, path, coach.designed(drawn, model, "math", "gsm8k", "doc_id", said))
    held = records.design(spark, path)
    row = (held["instructional_goal"], held["cognitive_level"], held["task_analysis"], "|".join(x["target"] for x in held["performance_objectives"]))
    return spark.createDataFrame([row], "goal string, level string, analysis string, targets string")


_PLAIN = T.StructType([T.StructField(n, T.StringType()) for n in ("instruction", "input", "output")] + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])


@query(r"""SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos, text AS input, 'g' AS goal, 'a' AS analysis, CAST(item_id AS VARCHAR) AS item FROM benchmark""")
def enriched_file(spark: SparkSession, d: str) -> DataFrame:
    """Samples written in their place, read, enriched, written under their name, found by it and read again."""
    base = work_path(spark, "enriched")
    b = _t(spark, d, "benchmark")
    rows = b.select("item_id", F.lit("Do it.").alias("instruction"), F.col("text").alias("input"), F.lit("o").alias("output"), F.create_map(F.lit("item"), F.col("item_id").cast("string"), F.lit("task_analysis"), F.lit("old")).alias("metadata"))
    drawn = records.json_array(spark, sinks.write_samples(rows, base, "math", "gsm8k", "item_id"), _PLAIN)
    new = prepare.enrich(drawn, "g", "a").withColumn("item_id", F.col("metadata")["item"].cast("bigint"))
    sinks.write_enriched(new, f"{base}/math/train/data", "gsm8k", "item_id")
    found = records.enhanced_files(spark, base, "gsm8k").first()["path"]
    meta = F.col("metadata")
    return records.json_array(spark, found, _PLAIN).select(F.col("pos").cast("bigint").alias("pos"), "input", meta["instructional_goal"].alias("goal"), meta["task_analysis"].alias("analysis"), meta["item"].alias("item"))
