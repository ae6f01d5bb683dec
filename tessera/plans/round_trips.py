"""More registered queries: raw datasets, files written and read again, prompt texts.

Files go to the shared folder that the session names and are read by the
engine's own sources, so a query shows that sink and source agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import answers, markup, text
from ..operators import loop, prepare, resume, sample
from ..session import work_path
from ..sources import records, sinks
from . import registry
from .catalogue import ITER, ORACLES, QUERIES, Query, _iterations, _t

_EVALUATED = T.StructType([T.StructField("question_id", T.LongType()), T.StructField("predicted", T.StringType())])


def query(sql: str):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _items(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select("item_id", F.lit("Do it.").alias("instruction"), F.col("text").alias("input"), prepare.answer_output(F.col("item_id").cast("string")).alias("output"))


# ------------------------------------------------------------- files, both ways


@query(r"""SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos, 'Do it.' AS instruction, text AS input, 'The answer is \boxed{' || item_id || '}' AS output FROM benchmark""")
def array_file(spark: SparkSession, d: str) -> DataFrame:
    """Records as one JSON array, read with their positions."""
    path = work_path(spark, "array") + ".json"
    sinks.export_array(_items(spark, d), path, "item_id")
    return records.json_array(spark, path).select(F.col("pos").cast("bigint").alias("pos"), "instruction", "input", "output")


@query(r"""SELECT 'gsm8k_train_' || (row_number() OVER (ORDER BY item_id) - 1) AS id, '' AS instruction, text AS input, 'The answer is \boxed{' || item_id || '}' AS output,
CAST(item_id AS VARCHAR) AS ground_truth, 'numeric' AS answer_type FROM benchmark""")
def question_file(spark: SparkSession, d: str) -> DataFrame:
    """A training file found by its domain and dataset, as questions and as what a run takes of them."""
    base = work_path(spark, "questions")
    sinks.export_array(_items(spark, d), f"{base}/math/train/data/gsm8k_train.json", "item_id")
    got = records.load_split(spark, base, "math", "train", "gsm8k")
    taken = records.projected(got)
    return taken.join(got.select(F.col("question_id").alias("id"), "ground_truth", "answer_type"), "id")


@query(r"""SELECT 'gsm8k_train_' || (row_number() OVER (ORDER BY item_id) - 1) AS question_id, text AS question FROM benchmark ORDER BY item_id LIMIT 7""")
def question_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first questions of an enriched file."""
    path = work_path(spark, "enhanced") + "/gsm8k_train_enhanced.json"
    sinks.export_array(prepare.enrich(_items(spark, d).withColumn("metadata", F.create_map().cast("map<string,string>")), "goal", "analysis").withColumn("item_id", F.regexp_extract("output", r"\{(\d+)\}", 1).cast("bigint")), path, "item_id")
    return records.load_enhanced(spark, path, "gsm8k", limit=7).select("question_id", "question")


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS sft_case FROM events WHERE event_id % 5 > 1")
def line_log(spark: SparkSession, d: str) -> DataFrame:
    """A line log with blank and torn lines, which are passed over."""
    path = work_path(spark, "lines") + ".jsonl"
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("sft_case")))
    kind = F.pmod("event_id", F.lit(5))
    _t(spark, d, "events").select(F.when(kind == 0, F.left(line, F.length(line) - 1)).when(kind == 1, "").otherwise(line).alias("value")).write.text(path)
    return records.json_lines(spark, path).select("id", "sft_case")


@query(f"""SELECT CAST(event_id AS VARCHAR) AS id, event_id % 2 = 0 AS scaffolding_correct, CASE WHEN event_id % 3 = 0 THEN '{registry.CASE_A}'
 WHEN event_id % 3 = 2 THEN '{registry.CASE_C}' WHEN event_id % 2 = 0 THEN '{registry.CASE_B}' ELSE '{registry.CASE_C}' END AS sft_case FROM events""")
def legacy_file(spark: SparkSession, d: str) -> DataFrame:
    """A finished log of the older form under its current names; an old B that was not correct is a C."""
    path = work_path(spark, "legacy") + ".json"
    case = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.pmod("event_id", F.lit(3)).cast("int") + 1)
    rows = _t(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), case.alias("sft_case"), (F.col("event_id") % 2 == 0).alias("phase1_correct"))
    sinks.write_joined(rows, path, '{"phase1_results": [', "]}")
    return records.json_log(spark, path).select("id", "scaffolding_correct", "sft_case")


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS id, '{registry.CASE_A}' AS sft_case, true AS complete FROM customer""")
def finalised_log(spark: SparkSession, d: str) -> DataFrame:
    """Lines appended in two parts, ended as one log, then read from there."""
    path = work_path(spark, "final") + ".json"
    rows = _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit(registry.CASE_A).alias("sft_case"))
    odd = F.col("id").cast("bigint") % 2 == 1
    for part in (rows.where(odd), rows.where(~odd)):
        sinks.append_lines(part, path.removesuffix(".json") + ".jsonl")
    sinks.write_meta(records.any_log(spark, path), path)
    kind = sinks.finalise(spark, path)
    sinks.write_text(spark, f"{path}.training", "[]")
    done = kind == "lines" and sinks.finalise(spark, path) == "final" and sinks.finished(spark, path, f"{path}.training")
    return records.any_log(spark, path).select("id", "sft_case", F.lit(done).alias("complete"))


@query("SELECT c_custkey AS question_id, CASE WHEN c_custkey % 2 = 1 THEN 'old' ELSE 'new' END AS predicted FROM customer")
def evaluation_resume(spark: SparkSession, d: str) -> DataFrame:
    """Results of an earlier evaluation, and new ones of what it had not reached."""
    path = work_path(spark, "evaluation") + ".json"
    all_ = _t(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("question_id"))
    old = sinks.prior_evaluations(spark, path, _EVALUATED).drop("pos")
    sinks.evaluations(old.union(all_.where("question_id % 2 = 1").withColumn("predicted", F.lit("old"))), path)
    old = sinks.prior_evaluations(spark, path, _EVALUATED).drop("pos")
    return resume.merged(old, all_.withColumn("predicted", F.lit("new")), "question_id")


@query("SELECT doc_id, text, lang FROM documents")
def record_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records as JSON objects and back."""
    rows = _t(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.lit("i").alias("instruction"), F.col("text").alias("input"), F.lit("o").alias("output"), F.create_map(F.lit("lang"), "lang").alias("metadata"))).alias("j"))
    return rows.select("doc_id", F.from_json("j", registry.RECORD).alias("r")).select("doc_id", F.col("r.input").alias("text"), F.col("r.metadata")["lang"].alias("lang"))


# ------------------------------------------------------------------ raw datasets


@query(r"""SELECT 's ' || s_name || ' how many?' AS input, 'The answer is \boxed{' || s_nationkey || '}' AS output, CAST(s_suppkey AS VARCHAR) AS id FROM supplier""")
def svamp_records(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier")
    got = prepare.svamp(s.select(F.concat(F.lit(" s "), "s_name").alias("Body"), F.lit("how many? ").alias("Question"), F.col("s_nationkey").alias("Answer"), F.col("s_suppkey").cast("string").alias("ID"), F.lit("x").alias("Equation"), F.lit("t").alias("Type")))
    return got.select("input", "output", F.col("metadata")["id"].alias("id"))


@query(r"""SELECT s_name || ' ?' AS input, 'The answer is \boxed{' || s_suppkey || '}' AS output FROM supplier""")
def asdiv_records(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier")
    answer = F.concat(F.col("s_suppkey").cast("string"), F.lit(" (apples)"))
    empty = spark.range(3).select(F.lit("").alias("body"), F.lit(" ").alias("question"), F.lit("1").alias("answer"), F.lit("").alias("solution_type"), F.lit("").alias("formula"))
    rows = s.select(F.col("s_name").alias("body"), F.lit("?").alias("question"), answer.alias("answer"), F.lit("sum").alias("solution_type"), F.lit("f").alias("formula"))
    return prepare.asdiv(rows.union(empty)).select("input", "output")


@query(r"""SELECT s_name AS input, 'The answer is \boxed{' || s_nationkey || '}' AS output, 'result' AS held FROM supplier
UNION ALL SELECT s_name, 'The answer is \boxed{' || s_suppkey || '}', 'result_float' FROM supplier""")
def mawps_records(spark: SparkSession, d: str) -> DataFrame:
    """With the result's column, and without it, where the float form is taken."""
    s = _t(spark, d, "supplier").select(F.col("s_name").alias("question"), F.col("s_nationkey").alias("result"), F.col("s_suppkey").alias("result_float"), F.lit("1").alias("id"), F.lit("e").alias("equation"), F.lit("x").alias("expression"))
    one = lambda rows, name: prepare.mawps(rows).select("input", "output", F.lit(name).alias("held"))
    return one(s, "result").union(one(s.drop("result"), "result_float"))


@query(r"""SELECT 'Context:' || chr(10) || n_name || chr(10) || 'Question: q?' || chr(10) || 'Options:' || chr(10) || 'A. one' || chr(10) || 'B. ' || n_name || chr(10) || 'C. three' AS input,
'The answer is \boxed{' || chr(CAST(65 + n_regionkey % 3 AS INT)) || '}' AS output FROM nation""")
def reclor_records(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation")
    rows = n.select(F.col("n_name").alias("context"), F.lit("q?").alias("question"), F.array(F.lit("one"), F.col("n_name"), F.lit("three")).alias("answers"), (F.col("n_regionkey") % 3).cast("int").alias("label"), F.lit("x").alias("id_string"))
    return prepare.reclor(rows).select("input", "output")


@query(r"""SELECT n_name || '?' || chr(10) || chr(10) || 'A. no' || chr(10) || 'B. ' || n_name AS input,
'The answer is \boxed{' || CASE WHEN n_nationkey % 2 = 0 THEN 'B' ELSE chr(CAST(65 + n_regionkey AS INT)) END || '}' AS output FROM nation""")
def arc_records(spark: SparkSession, d: str) -> DataFrame:
    """Keys are letters, or numbers from 1."""
    n = _t(spark, d, "nation")
    key = F.when(F.col("n_nationkey") % 2 == 0, "B").otherwise((F.col("n_regionkey") + 1).cast("string"))
    options = F.array(F.struct(F.lit("no").alias("text")), F.struct(F.col("n_name").alias("text")))
    return prepare.arc(n.select(F.concat("n_name", F.lit("?")).alias("question"), options.alias("choices"), key.alias("answerKey"), F.lit("i").alias("id"))).select("input", "output")


@query(r"""SELECT CAST(doc_id AS VARCHAR) AS input, 'The answer is \boxed{' || CASE WHEN toxic = 1 THEN 'Yes' ELSE 'No' END || '}' AS output FROM labels""")
def strategyqa_records(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("question"), (F.col("toxic") == 1).alias("answer"), F.lit("q").alias("qid"), F.lit("t").alias("term"), F.lit("d").alias("description"), F.lit("f").alias("facts"))
    return prepare.strategyqa(rows).select("input", "output")


@query(r"""SELECT n_name || chr(10) || chr(10) || 'A. x' || chr(10) || 'B. y' AS input, 'The answer is \boxed{A}' AS output, 'f' || n_nationkey AS fact FROM nation""")
def openbookqa_records(spark: SparkSession, d: str) -> DataFrame:
    options = F.array(F.struct(F.lit("x").alias("text")), F.struct(F.lit("y").alias("text")))
    rows = _t(spark, d, "nation").select(F.col("n_name").alias("question_stem"), options.alias("choices"), F.lit("A").alias("answerKey"), F.lit("i").alias("id"), F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("fact1"), F.lit("1").alias("humanScore"), F.lit("1").alias("clarity"))
    return prepare.openbookqa(rows).select("input", "output", F.col("metadata")["fact1"].alias("fact"))


@query(r"""SELECT 'Premise: p ' || n_name || chr(10) || 'Hypothesis: h' || chr(10) || chr(10) || 'A. entailment' || chr(10) || 'B. neutral' || chr(10) || 'C. contradiction' AS input,
'The answer is \boxed{' || chr(CAST(65 + n_nationkey % 3 AS INT)) || '}' AS output FROM nation""")
def anli_records(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "nation").select(F.concat(F.lit("p "), "n_name").alias("premise"), F.lit("h").alias("hypothesis"), (F.col("n_nationkey") % 3).alias("label"), F.lit("u").alias("uid"), F.lit("r").alias("reason"))
    return prepare.anli(rows).select("input", "output")


@query(rf"""SELECT CASE WHEN n_regionkey = 0 THEN 'Judge.' ELSE '{registry.PROMPTS["text"].replace("'", "''")}' END AS instruction, n_name AS input, 'The answer is \boxed{{' || n_nationkey || '}}' AS output,
CASE WHEN n_regionkey = 0 THEN 'web_of_lies' ELSE 'formal_fallacies' END AS subtask FROM nation""")
def bbh_records(spark: SparkSession, d: str) -> DataFrame:
    """Subtasks with a prompt of their own and without one."""
    rows = _t(spark, d, "nation").select(F.col("n_name").alias("input"), F.col("n_nationkey").cast("string").alias("target"), "n_regionkey")
    parts = {"web_of_lies": rows.where("n_regionkey = 0"), "formal_fallacies": rows.where("n_regionkey <> 0")}
    got = prepare.bbh({k: v.drop("n_regionkey") for k, v in parts.items()}, {"web_of_lies": "Judge."})
    return got.select("instruction", "input", "output", F.col("metadata")["subtask"].alias("subtask"))


# ----------------------------------------------------------------------- samples


@query("""SELECT lang, doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 20""")
def sample_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Random beats the stratified flag."""
    docs = _t(spark, d, "documents").select("lang", "doc_id", "n_chars", "source")
    return sample.extract_samples(docs, 20, "random", F.col("n_chars"), F.col("lang"), F.col("source"), "doc_id", use_stratified=True).select("lang", "doc_id")


@query("""SELECT 'labels' AS dataset, doc_id FROM (SELECT doc_id FROM labels ORDER BY md5('42:' || doc_id), doc_id LIMIT 5)
UNION ALL SELECT 'documents', doc_id FROM (SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 5)""")
def sample_all(spark: SparkSession, d: str) -> DataFrame:
    """Samples of every dataset there is; a missing one stays missing."""
    one = lambda name: _t(spark, d, name).select("doc_id", F.lit(1).alias("n"), F.lit("x").alias("k"))
    got = sample.extract_all({"labels": one("labels"), "documents": one("documents"), "none": None}, k=5, strategy="random", length=F.col("n"), primary=F.col("k"), secondary=F.col("k"), id_col="doc_id")
    parts = [rows.select(F.lit(name).alias("dataset"), "doc_id") for name, rows in got.items() if rows is not None]
    return parts[0].union(parts[1])


# ------------------------------------------------------------- answers and texts


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'B' WHEN 1 THEN CAST(c_custkey AS VARCHAR) WHEN 2 THEN 'Yes' ELSE 'so it is' END AS answer FROM customer""")
def extract_by_type(spark: SparkSession, d: str) -> DataFrame:
    """The extractor that each row's type names; an unknown type is text."""
    n, kind = F.col("c_custkey").cast("string"), F.pmod("c_custkey", F.lit(4))
    pick = lambda *values: F.element_at(F.array(*values), kind.cast("int") + 1)
    types = pick(F.lit("mcq"), F.lit("numeric"), F.lit("boolean"), F.lit("else"))
    said = pick(F.lit("The answer is \\boxed{B}"), F.concat(F.lit("The answer is \\boxed{"), n, F.lit("}")), F.lit("\\boxed{Yes}"), F.lit("First this.\nso it is"))
    return _t(spark, d, "customer").select("c_custkey", answers.extract_by(types, said).alias("answer"))


@query("SELECT p_partkey, 'is ' || p_partkey || ' or ' || p_size || '.' AS shown FROM part")
def unboxed_text(spark: SparkSession, d: str) -> DataFrame:
    box = lambda c: F.concat(F.lit("\\boxed{"), F.col(c).cast("string"), F.lit("}"))
    return _t(spark, d, "part").select("p_partkey", markup.unboxed(F.concat(F.lit("is "), box("p_partkey"), F.lit(" or "), box("p_size"), F.lit("."))).alias("shown"))


@query(f"""WITH {ITER} SELECT conv_id, coalesce(string_agg('[Iteration ' || iteration || ' Feedback]' || chr(10) || response, chr(10) || chr(10) ORDER BY iteration) FILTER (WHERE iteration % 2 = 1 AND response <> ''), '(No feedback history)') AS feedback,
coalesce(string_agg('[Iteration ' || iteration || ' Summary]' || chr(10) || response, chr(10) || chr(10) ORDER BY iteration) FILTER (WHERE iteration % 2 = 0 AND response <> ''), '(No previous iteration summaries)') AS summaries,
max_by(response, iteration) FILTER (WHERE iteration % 2 = 0 AND response <> '') AS latest,
string_agg(chr(10) || '[Iteration ' || iteration || ']' || CASE WHEN iteration % 2 = 0 AND response <> '' THEN chr(10) || 'Summary: ' || left(response, 500) ELSE '' END
 || chr(10) || '  Artifact 1 (HOT): ' || left(coalesce(response, ''), 100) || chr(10) || '  Artifact 2 (Unknown): b', chr(10) ORDER BY iteration) AS scaffolding
FROM iter GROUP BY conv_id""")
def prompt_histories(spark: SparkSession, d: str) -> DataFrame:
    """Feedback of odd iterations, summaries of even ones, the latest summary, and scaffolding."""
    odd = F.col("iteration") % 2 == 1
    artifact = lambda kind, target: F.struct(kind.alias("skill_type"), target.alias("target_objective"))
    artifacts = F.array(artifact(F.lit("HOT"), F.col("response")), artifact(F.lit(None).cast("string"), F.lit("b")), artifact(F.lit("LOT"), F.lit("c")))
    held = loop.history(_iterations(spark, d), "conv_id", "iteration", F.when(odd, F.col("response")).alias("feedback"), F.when(~odd, F.col("response")).alias("summary"), artifacts.alias("artifacts"))
    h = F.col("history")
    return held.select("conv_id", text.feedback_history(h).alias("feedback"), text.iteration_summaries(h).alias("summaries"), text.latest_summary(h).alias("latest"), text.scaffolding_history(h).alias("scaffolding"))


@query(f"""WITH {ITER}, cut AS (SELECT *, max(CAST(satisfied AS INT)) OVER (PARTITION BY conv_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM iter)
SELECT conv_id, string_agg(CASE WHEN iteration > 1 AND iteration % 2 = 0 THEN '[Guidance]' || chr(10) || '- why ' || iteration || chr(10) || '- how' || chr(10) || chr(10) ELSE '' END
 || '[Solution Attempt]' || chr(10) || response, chr(10) || chr(10) ORDER BY iteration) AS attempts FROM cut WHERE coalesce(done, 0) = 0 GROUP BY conv_id""")
def guided_response(spark: SparkSession, d: str) -> DataFrame:
    """Attempts up to the first correct one, with the questions asked ahead of every second."""
    asked = F.array(F.concat(F.lit("why "), F.col("iteration").cast("string")), F.lit("how"))
    feedback = F.when(F.col("iteration") % 2 == 0, asked).when(F.col("iteration") % 3 == 0, F.array().cast("array<string>"))
    held = loop.history(_iterations(spark, d), "conv_id", "iteration", feedback.alias("feedback"), "response", F.col("satisfied").alias("is_correct"))
    return held.select("conv_id", text.guided_attempts(F.col("history")).alias("attempts"))
