"""Every registered query of the QA engine, with the SQL that gives the same rows.

The driver tables hold no question-answering records, so each query derives
them from columns: ``rec`` and ``resp`` from documents (a record per document,
and a response in one of eight forms), iterations from conversations, a log
from events. The SQL derives the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers, jsonfix, markup, scaffold, text
from ..operators import loop, prepare, resume, sample, sft, stats
from ..sources import records
from ..session import work_path
from . import registry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- shared views


def _records(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(
        F.col("doc_id").alias("id"),
        F.lit("Answer.").alias("instruction"),
        F.col("text").alias("input"),
        F.concat(F.lit("The answer is \\boxed{"), F.col("n_chars").cast("string"), F.lit("}")).alias("output"),
        F.col("lang").alias("type"),
        F.col("source").alias("level"),
        F.col("n_chars"),
    )


REC = r"""rec AS (SELECT doc_id AS id, 'Answer.' AS instruction, text AS input,
 'The answer is \boxed{' || CAST(n_chars AS VARCHAR) || '}' AS output, lang AS type, source AS level, n_chars FROM documents)"""


def _responses(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars").cast("string")
    form = F.pmod("doc_id", F.lit(8))
    body = (
        F.when(form == 0, F.concat(F.lit("So 2 and 3.\n#### "), n))
        .when(form == 1, F.concat(F.lit("Hence \\boxed{"), n, F.lit("} holds")))
        .when(form == 2, F.concat(F.lit("The answer is "), n, F.lit(".")))
        .when(form == 3, F.concat(F.lit("x + 1 = "), n))
        .when(form == 4, F.concat(F.lit("First 7 then "), n, F.lit(" units")))
        .when(form == 5, F.concat(F.lit("Final Answer: $"), (F.col("n_chars") + 1).cast("string"), F.lit("$")))
        .when(form == 6, F.concat(F.lit("We get \\boxed{\\frac{"), n, F.lit("}{2}}")))
        .otherwise("no number here")
    )
    return _t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", body.alias("response"), F.col("n_chars").cast("string").alias("truth"))


RESP = r"""resp AS (SELECT doc_id, lang, source, n_chars, CAST(n_chars AS VARCHAR) AS truth, CASE doc_id % 8
 WHEN 0 THEN 'So 2 and 3.' || chr(10) || '#### ' || n_chars
 WHEN 1 THEN 'Hence \boxed{' || n_chars || '} holds'
 WHEN 2 THEN 'The answer is ' || n_chars || '.'
 WHEN 3 THEN 'x + 1 = ' || n_chars
 WHEN 4 THEN 'First 7 then ' || n_chars || ' units'
 WHEN 5 THEN 'Final Answer: $' || (n_chars + 1) || '$'
 WHEN 6 THEN 'We get \boxed{\frac{' || n_chars || '}{2}}'
 ELSE 'no number here' END AS response FROM documents)"""

NUM = r"""num AS (SELECT *, CASE
 WHEN regexp_matches(response, '####\s*-?\d+') THEN regexp_extract(response, '####\s*(-?\d+)', 1)
 WHEN contains(response, '\boxed') THEN regexp_extract(response, '\\boxed\{\D*(\d+)', 1)
 WHEN regexp_matches(response, 'answer is \d') THEN regexp_extract(response, 'answer is (\d+)', 1)
 WHEN regexp_matches(response, 'Answer: \$') THEN regexp_extract(response, 'Answer: \$(\d+)', 1)
 WHEN regexp_matches(response, '= \d') THEN regexp_extract(response, '= (\d+)', 1)
 ELSE nullif(list_extract(regexp_extract_all(response, '\d+'), -1), '') END AS predicted FROM resp)"""


def _iterations(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as a question's iterations."""
    turns = _t(spark, d, "conversations").where("role = 'assistant'")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.select("conv_id", rank.cast("bigint").alias("iteration"), F.col("text").alias("response"), (F.length("text") % 3 == 0).alias("satisfied"))


ITER = """iter AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS iteration, text AS response,
 length(text) % 3 = 0 AS satisfied FROM conversations WHERE role = 'assistant')"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events as an append log: the same id many times, some without one."""
    kind = F.pmod("user_id", F.lit(5))
    case = F.when(kind == 0, registry.CASE_A).when(kind == 1, registry.CASE_B).when(kind == 2, registry.CASE_C).when(kind == 3, registry.SKIPPED)
    return _t(spark, d, "events").select(F.when(F.col("user_id") % 7 != 0, F.col("user_id").cast("string")).alias("id"), case.alias("sft_case"), "event_type", "event_id", "value")


LOG = f"""log AS (SELECT CASE WHEN user_id % 7 <> 0 THEN CAST(user_id AS VARCHAR) END AS id, CASE user_id % 5
 WHEN 0 THEN '{registry.CASE_A}' WHEN 1 THEN '{registry.CASE_B}' WHEN 2 THEN '{registry.CASE_C}' WHEN 3 THEN 'skipped' END AS sft_case,
 event_type, event_id, value FROM events)"""


# ------------------------------------------------- projection, limits, sorting


@query(f"WITH {REC} SELECT id, instruction, output, type, level, 'q_train_' || id AS question_id, CAST(n_chars AS VARCHAR) AS truth FROM rec")
def scan_project_record(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).withColumn("metadata", F.create_map(F.lit("type"), "type", F.lit("level"), "level"))
    q = records.questions(r, "q", "train", "id")
    held = q.select(F.col("pos").alias("id"), "instruction", F.col("ground_truth_formatted").alias("output"), "metadata", "question_id", F.col("ground_truth").alias("truth"))
    return held.select("id", "instruction", "output", F.col("metadata")["type"].alias("type"), F.col("metadata")["level"].alias("level"), "question_id", "truth")


@query(f"WITH {REC} SELECT id, type, 'Solve it' AS goal, 'Read; solve' AS analysis FROM rec")
def enrich_broadcast(spark: SparkSession, d: str) -> DataFrame:
    design = spark.range(1).select(F.lit("Solve it").alias("instructional_goal"), F.lit("Read; solve").alias("task_analysis"))
    r = _records(spark, d).select(F.col("id").cast("string").alias("instruction"), "input", "output", F.create_map(F.lit("type"), F.col("type"), F.lit("task_analysis"), F.lit("old")).alias("metadata"))
    out = prepare.enrich_from(r, design)
    return out.select(F.col("instruction").cast("bigint").alias("id"), F.col("metadata")["type"].alias("type"), F.col("metadata")["instructional_goal"].alias("goal"), F.col("metadata")["task_analysis"].alias("analysis"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 25")
def limit_topn(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(25)


@query("SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS place FROM documents")
def sort_length(spark: SparkSession, d: str) -> DataFrame:
    """Position by length: offsets per length, then ranks within one length only."""
    rows = _t(spark, d, "documents").select("doc_id", "n_chars")
    return sample.places(rows, "n_chars", "doc_id")


# -------------------------------------------------------- extraction, grading


@query(f"WITH {RESP}, {NUM} SELECT doc_id, predicted FROM num")
def numeric_extract(spark: SparkSession, d: str) -> DataFrame:
    return _responses(spark, d).select("doc_id", answers.extract_numeric(F.col("response")).alias("predicted"))


@query(f"WITH {RESP}, {NUM} SELECT doc_id, coalesce(predicted = truth, false) AS is_correct FROM num")
def numeric_grade(spark: SparkSession, d: str) -> DataFrame:
    r = _responses(spark, d)
    return r.select("doc_id", answers.grade_numeric(answers.extract_numeric(F.col("response")), F.col("truth")).alias("is_correct"))


@query(
    f"WITH {RESP}, {NUM} SELECT lang, count(*) AS evaluated, CAST(count(*) FILTER (WHERE predicted = truth) AS BIGINT) AS correct, "
    "CAST(count(*) FILTER (WHERE predicted = truth) AS DOUBLE) / count(*) AS accuracy FROM num GROUP BY lang"
)
def eval_accuracy(spark: SparkSession, d: str) -> DataFrame:
    r = _responses(spark, d)
    graded = r.withColumn("is_correct", answers.grade_numeric(answers.extract_numeric(F.col("response")), F.col("truth")))
    return stats.accuracy(graded, ["lang"])


def _mcq_responses(spark: SparkSession, d: str) -> DataFrame:
    letter = F.char(65 + F.pmod(F.col("p_partkey"), F.lit(4)).cast("int"))
    form = F.pmod("p_partkey", F.lit(7))
    body = (
        F.when(form == 0, F.concat(F.lit("It is \\boxed{"), F.lower(letter), F.lit("}")))
        .when(form == 1, F.concat(F.lit("Answer: "), letter))
        .when(form == 2, F.concat(F.lit("the correct answer is "), letter))
        .when(form == 3, F.concat(F.lit("We see\n"), letter, F.lit(". this one")))
        .when(form == 4, F.concat(F.lit("I pick ("), letter, F.lit(")")))
        .when(form == 5, F.concat(F.lit("so\n"), letter, F.lit("\nok")))
        .otherwise("none fits")
    )
    return _t(spark, d, "part").select("p_partkey", body.alias("response"), F.char(65 + F.pmod(F.col("p_size"), F.lit(4))).alias("truth"))


MCQ = r"""mcq AS (SELECT p_partkey, chr(CAST(65 + p_partkey % 4 AS INT)) AS l, chr(CAST(65 + p_size % 4 AS INT)) AS truth, p_partkey % 7 AS f FROM part),
mcqp AS (SELECT p_partkey, truth, CASE WHEN f = 6 THEN NULL ELSE l END AS predicted FROM mcq)"""


@query(f"WITH {MCQ} SELECT p_partkey, predicted FROM mcqp")
def mcq_extract(spark: SparkSession, d: str) -> DataFrame:
    return _mcq_responses(spark, d).select("p_partkey", answers.extract_mcq(F.col("response")).alias("predicted"))


@query(f"WITH {MCQ} SELECT p_partkey, coalesce(predicted = truth, false) AS is_correct FROM mcqp")
def mcq_grade(spark: SparkSession, d: str) -> DataFrame:
    r = _mcq_responses(spark, d)
    return r.select("p_partkey", answers.grade_mcq(answers.extract_mcq(F.col("response")), F.concat(F.lit("The answer is \\boxed{"), F.col("truth"), F.lit("}"))).alias("is_correct"))


def _latex_responses(spark: SparkSession, d: str) -> DataFrame:
    size, form = F.col("p_size").cast("string"), F.pmod("p_partkey", F.lit(4))
    body = (
        F.when(form == 0, F.concat(F.lit("Thus $\\boxed{\\frac{"), size, F.lit("}{4}}$")))
        .when(form == 1, F.concat(F.lit("The answer is $\\dfrac{"), size, F.lit("}{4}$.")))
        .when(form == 2, F.concat(F.lit("the Answer is: "), size, F.lit("/4.\nDone")))
        .otherwise(F.concat(F.lit("about "), size))
    )
    return _t(spark, d, "part").select("p_partkey", body.alias("response"), F.concat(F.lit("\\frac{"), size, F.lit("}{4}")).alias("truth"), "p_size")


LATEX = r"""latex AS (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN '\frac{' || p_size || '}{4}' WHEN 1 THEN '\dfrac{' || p_size || '}{4}'
 WHEN 2 THEN p_size || '/4' ELSE CAST(p_size AS VARCHAR) END AS predicted FROM part)"""


@query(f"WITH {LATEX} SELECT p_partkey, predicted FROM latex")
def latex_extract(spark: SparkSession, d: str) -> DataFrame:
    return _latex_responses(spark, d).select("p_partkey", answers.extract_latex(F.col("response")).alias("predicted"))


@query(f"WITH {LATEX} SELECT p_partkey, p_partkey % 4 <> 3 AS is_correct FROM latex")
def latex_grade(spark: SparkSession, d: str) -> DataFrame:
    r = _latex_responses(spark, d)
    return r.select("p_partkey", answers.grade_latex(answers.extract_latex(F.col("response")), F.col("truth")).alias("is_correct"))


def _boolean_responses(spark: SparkSession, d: str) -> DataFrame:
    form = F.pmod("o_orderkey", F.lit(5))
    word = F.when(F.col("o_orderstatus") == "F", "False").otherwise("True")
    body = (
        F.when(form == 0, F.concat(F.lit("Answer: "), word))
        .when(form == 1, F.concat(F.lit("Hmm.\n"), F.lower(word), F.lit(".")))
        .when(form == 2, F.lit("It seems correct, but it is invalid"))
        .when(form == 3, F.lit("A no at first. At last: ok, yes"))
        .otherwise("***")
    )
    return _t(spark, d, "orders").select("o_orderkey", body.alias("response"), F.when(F.col("o_orderstatus") == "F", "No").otherwise("Yes").alias("truth"))


BOOL = """bool AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'No' ELSE 'Yes' END AS truth, CASE o_orderkey % 5
 WHEN 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'No' ELSE 'Yes' END WHEN 1 THEN CASE WHEN o_orderstatus = 'F' THEN 'No' ELSE 'Yes' END
 WHEN 2 THEN 'Yes' WHEN 3 THEN 'Yes' END AS predicted FROM orders)"""


@query(f"WITH {BOOL} SELECT o_orderkey, predicted FROM bool")
def boolean_extract(spark: SparkSession, d: str) -> DataFrame:
    return _boolean_responses(spark, d).select("o_orderkey", answers.extract_boolean(F.col("response")).alias("predicted"))


@query(f"WITH {BOOL} SELECT o_orderkey, coalesce(predicted = truth, false) AS is_correct FROM bool")
def boolean_grade(spark: SparkSession, d: str) -> DataFrame:
    r = _boolean_responses(spark, d)
    return r.select("o_orderkey", answers.grade_boolean(answers.extract_boolean(F.col("response")), F.col("truth")).alias("is_correct"))


def _text_responses(spark: SparkSession, d: str) -> DataFrame:
    form = F.pmod("c_custkey", F.lit(3))
    body = F.when(form == 0, F.concat(F.lit("Answer: "), F.col("c_mktsegment"), F.lit(".\nBye"))).when(form == 1, F.concat(F.lit("the answer is "), F.col("c_mktsegment"))).otherwise(F.concat(F.lit("Well\n\n  "), F.lower("c_mktsegment"), F.lit("!  \n\n")))
    return _t(spark, d, "customer").select("c_custkey", body.alias("response"), F.col("c_mktsegment").alias("truth"))


TEXT = """txt AS (SELECT c_custkey, c_mktsegment AS truth, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'is ' || c_mktsegment
 ELSE lower(c_mktsegment) || '!' END AS predicted FROM customer)"""


@query(f"WITH {TEXT} SELECT c_custkey, predicted FROM txt")
def text_extract(spark: SparkSession, d: str) -> DataFrame:
    return _text_responses(spark, d).select("c_custkey", answers.extract_text(F.col("response")).alias("predicted"))


@query(f"WITH {TEXT} SELECT c_custkey, c_custkey % 3 <> 1 AS is_correct FROM txt")
def text_grade(spark: SparkSession, d: str) -> DataFrame:
    r = _text_responses(spark, d)
    return r.select("c_custkey", answers.grade_text(answers.extract_text(F.col("response")), F.col("truth")).alias("is_correct"))


@query(r"""WITH b AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || ' \boxed{' || n_chars || '}' WHEN 1 THEN text || ' \fbox{\sqrt{' || n_chars || '}}'
 WHEN 2 THEN text || ' \boxed{1} then \boxed{a{' || n_chars || '}b}' ELSE text || ' \boxed{' END AS t, n_chars FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN '\sqrt{' || n_chars || '}' WHEN 2 THEN 'a{' || n_chars || '}b' END AS answer,
 CASE doc_id % 4 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 2 THEN 'a{' || n_chars || '}b' ELSE '' END AS shallow FROM b""")
def boxed_extract(spark: SparkSession, d: str) -> DataFrame:
    n, form = F.col("n_chars").cast("string"), F.pmod("doc_id", F.lit(4))
    tail = (
        F.when(form == 0, F.concat(F.lit(" \\boxed{"), n, F.lit("}")))
        .when(form == 1, F.concat(F.lit(" \\fbox{\\sqrt{"), n, F.lit("}}")))
        .when(form == 2, F.concat(F.lit(" \\boxed{1} then \\boxed{a{"), n, F.lit("}b}")))
        .otherwise(" \\boxed{")
    )
    body = F.concat(F.col("text"), tail)
    return _t(spark, d, "documents").select("doc_id", markup.boxed(body).alias("answer"), markup.boxed_shallow(body).alias("shallow"))


@query(r"""SELECT p_partkey, '\frac{' || p_size || '}{2}0.5' AS plain, 'frac' || p_size || '2x' AS latex FROM part""")
def latex_normalize(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    raw = F.concat(F.lit("  \\left\\dfrac{"), n, F.lit("}{2} .5\\right\n"))
    latex = F.concat(F.lit("$\\frac{"), n, F.lit("}{2}$ \\text{x}"))
    return _t(spark, d, "part").select("p_partkey", markup.normal_answer(raw).alias("plain"), markup.normal_latex(latex).alias("latex"))


@query("SELECT p_partkey, '0.' || p_size || 'b' AS plain FROM part")
def strip_string(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", markup.plain_markup(F.concat(F.lit("."), F.col("p_size").cast("string"), F.lit("\\! b"))).alias("plain"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS DOUBLE) / 8 WHEN 1 THEN CAST(o_custkey AS DOUBLE) / 16 END AS value FROM orders""")
def parse_fraction(spark: SparkSession, d: str) -> DataFrame:
    n, form = F.col("o_custkey").cast("string"), F.pmod("o_orderkey", F.lit(3))
    body = F.when(form == 0, F.concat(F.lit("\\frac{"), n, F.lit("}{8}"))).when(form == 1, F.concat(n, F.lit("/16"))).otherwise(F.concat(n, F.lit("/0")))
    return _t(spark, d, "orders").select("o_orderkey", markup.fraction(body).alias("value"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN 'v' || n_chars ELSE 'last ' || n_chars END AS truth FROM documents""")
def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    n, form = F.col("n_chars").cast("string"), F.pmod("doc_id", F.lit(3))
    body = F.when(form == 0, F.concat(F.lit("so \\boxed{"), n, F.lit("}."))).when(form == 1, F.concat(F.lit("why\n####  v"), n, F.lit(" \n"))).otherwise(F.concat(F.lit("first\n last "), n, F.lit("\n")))
    return _t(spark, d, "documents").select("doc_id", answers.ground_truth(body).alias("truth"))


def _mcq_question() -> tuple[Column, Column]:
    return F.concat(F.lit("Which is "), F.col("p_name"), F.lit("?")), F.array("p_brand", "p_type", F.col("p_size").cast("string"))


@query("""SELECT p_partkey, 'Which is ' || p_name || '?' || chr(10) || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. ' || p_size AS input,
 CASE WHEN p_partkey % 2 = 0 THEN chr(CAST(64 + p_size % 3 + 1 AS INT)) ELSE 'B' END AS key FROM part""")
def mcq_format(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("p_partkey") % 2 == 0, (F.col("p_size") % 3 + 1).cast("string")).otherwise("B")
    return _t(spark, d, "part").select("p_partkey", prepare.choice_input(*_mcq_question()).alias("input"), prepare.key_letter(key).alias("key"))


@query("SELECT p_partkey, p_brand || '|' || p_type || '|' || p_size AS choices, CAST(3 AS INT) AS n FROM part")
def choices(spark: SparkSession, d: str) -> DataFrame:
    found = answers.choices(prepare.choice_input(*_mcq_question()))
    return _t(spark, d, "part").select("p_partkey", F.array_join(found, "|").alias("choices"), F.size(found).alias("n"))


@query("SELECT doc_id, chr(CAST(65 + quality AS INT)) AS letter, CASE WHEN toxic = 1 THEN 'Yes' ELSE 'No' END AS toxic FROM labels")
def label_letter_yesno(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "labels").select("doc_id", prepare.letter(F.col("quality")).alias("letter"), prepare.yes_no(F.col("toxic") == 1).alias("toxic"))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'other' END AS letter FROM nation")
def prompt_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "nation").select("n_nationkey", prepare.looked_up(F.col("n_regionkey"), registry.ANLI_LABELS, "other").alias("letter"))


@query(r"""SELECT l_orderkey, l_linenumber, 'Q' AS input, CASE WHEN l_linenumber % 2 = 0
 THEN 'ship ' || l_shipmode2 || chr(10) || chr(10) || 'The answer is \boxed{' || l_partkey || '}' ELSE 'The answer is \boxed{' || l_partkey || '}' END AS output
FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode2 FROM lineitem)""")
def gsm_split(spark: SparkSession, d: str) -> DataFrame:
    flag = F.concat(F.lit("ship "), F.col("l_returnflag"), F.col("l_linestatus"))
    n = F.col("l_partkey").cast("string")
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("Q").alias("question"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(flag, F.lit("\n#### "), n)).otherwise(n).alias("answer"))
    key = F.concat_ws(",", "l_orderkey", "l_linenumber")
    got = prepare.gsm8k(rows.select(F.concat_ws("|", key, "question").alias("question"), "answer"), reasoning=True)
    parts = F.split("input", r"[,|]")  # the key travels in the question
    return got.select(parts[0].cast("bigint").alias("l_orderkey"), parts[1].cast("bigint").alias("l_linenumber"), parts[2].alias("input"), "output")


@query(r"""SELECT text AS problem, 'The answer is \boxed{' || CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS VARCHAR) ELSE 'See solution' END || '}' AS output, lang AS subtask FROM documents""")
def union_configs(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    solution = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("so \\boxed{"), F.col("n_chars").cast("string"), F.lit("}"))).otherwise("unclear")
    configs = ("de", "en", "es", "fr")
    wanted = {x: F.col("lang") == x for x in configs} | {"rest": ~F.col("lang").isin(*configs), "none": F.col("lang").isNull()}
    parts = {x: docs.where(rows).select(F.col("text").alias("problem"), solution.alias("solution"), F.lit("1").alias("level"), F.col("lang").alias("type")) for x, rows in wanted.items()}
    # Records hold an empty type where there is none; the query's rows hold null.
    none = prepare.math({"none": parts.pop("none")}).select(F.col("input").alias("problem"), "output", F.lit(None).cast("string").alias("subtask"))
    return prepare.math(parts).select(F.col("input").alias("problem"), "output", F.col("metadata")["type"].alias("subtask")).union(none)


# ---------------------------------------------------- resume, logs, statistics


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return resume.remaining(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id", "doc_id").select("doc_id", "n_chars")


@query("""SELECT doc_id, quality AS mark FROM labels UNION ALL SELECT doc_id, 9 AS mark FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def resume_merge(spark: SparkSession, d: str) -> DataFrame:
    old = _t(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("mark"))
    return resume.merged(old, _t(spark, d, "documents").select("doc_id", F.lit(9).alias("mark")), "doc_id")


@query(f"WITH {REC} SELECT level, count(*) AS n FROM rec GROUP BY level")
def level_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(_records(spark, d), F.col("level"), "level")


@query("SELECT event_type AS subtask, count(*) AS n FROM events GROUP BY event_type")
def subtask_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(_t(spark, d, "events"), F.col("event_type"), "subtask")


CLASSIFIED = f"""cls AS (SELECT conv_id, min(iteration) FILTER (WHERE satisfied) AS first_success FROM iter GROUP BY conv_id),
cases AS (SELECT conv_id, first_success, coalesce(first_success, 5) AS iterations_needed, CASE WHEN first_success = 1 THEN '{registry.CASE_A}'
 WHEN first_success > 1 THEN '{registry.CASE_B}' ELSE '{registry.CASE_C}' END AS sft_case FROM cls)"""


@query(f"WITH {ITER}, {CLASSIFIED} SELECT conv_id, sft_case, coalesce(first_success, 0) AS first_success, CAST(iterations_needed AS BIGINT) AS iterations_needed FROM cases")
def case_classify(spark: SparkSession, d: str) -> DataFrame:
    got = loop.classify(_iterations(spark, d), "conv_id", "iteration", "satisfied", 5)
    return got.withColumn("first_success", F.coalesce("first_success", F.lit(0)).cast("bigint"))


@query(
    f"WITH {ITER}, {CLASSIFIED} SELECT count(*) AS processed, count(*) FILTER (WHERE sft_case LIKE 'case_a%') AS case_a, count(*) FILTER (WHERE sft_case LIKE 'case_b%') AS case_b, "
    "count(*) FILTER (WHERE sft_case LIKE 'case_c%') AS case_c, CAST(0 AS BIGINT) AS skipped, count(*) FILTER (WHERE first_success IS NOT NULL) AS success_total, "
    "CAST(count(*) FILTER (WHERE first_success IS NOT NULL) AS DOUBLE) / count(*) AS success_rate FROM cases"
)
def case_stats(spark: SparkSession, d: str) -> DataFrame:
    cases = loop.classify(_iterations(spark, d), "conv_id", "iteration", "satisfied", 5)
    return stats.case_statistics(cases.withColumn("id", F.col("conv_id").cast("string")))


@query(f"""WITH {LOG}, one AS (SELECT id, min(sft_case) AS sft_case FROM log WHERE id IS NOT NULL GROUP BY id)
SELECT count(*) AS processed, count(*) FILTER (WHERE sft_case LIKE 'case_a%') AS case_a, count(*) FILTER (WHERE sft_case LIKE 'case_b%') AS case_b,
 count(*) FILTER (WHERE sft_case LIKE 'case_c%') AS case_c, count(*) FILTER (WHERE sft_case = 'skipped') AS skipped,
 count(*) FILTER (WHERE sft_case LIKE 'case_a%' OR sft_case LIKE 'case_b%') AS success_total,
 CAST(count(*) FILTER (WHERE sft_case LIKE 'case_a%' OR sft_case LIKE 'case_b%') AS DOUBLE) / count(*) AS success_rate FROM one""")
def log_replay(spark: SparkSession, d: str) -> DataFrame:
    return stats.case_statistics(_log(spark, d))


@query(f"""WITH {ITER} SELECT conv_id, max(iteration) AS last_iteration, max_by(response, iteration) AS response FROM iter WHERE satisfied GROUP BY conv_id""")
def last_correct(spark: SparkSession, d: str) -> DataFrame:
    return loop.last_correct(_iterations(spark, d), "conv_id", "iteration", "satisfied", "response")


@query(f"WITH {ITER} SELECT conv_id, iteration, lag(response) OVER (PARTITION BY conv_id ORDER BY iteration) AS previous_response FROM iter")
def prev_response(spark: SparkSession, d: str) -> DataFrame:
    return loop.with_previous(_iterations(spark, d), "conv_id", "iteration", "response").select("conv_id", "iteration", "previous_response")


@query(f"""WITH {ITER}, cut AS (SELECT *, max(CAST(satisfied AS INT)) OVER (PARTITION BY conv_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM iter)
SELECT conv_id, iteration, satisfied FROM cut WHERE coalesce(done, 0) = 0""")
def cut_at_success(spark: SparkSession, d: str) -> DataFrame:
    return loop.until_success(_iterations(spark, d), "conv_id", "iteration", "satisfied").select("conv_id", "iteration", "satisfied")


@query(f"""WITH {ITER} SELECT conv_id, string_agg('Iter ' || iteration || ': ' || response, chr(10) ORDER BY iteration) AS history FROM iter WHERE response <> '' GROUP BY conv_id""")
def iteration_history(spark: SparkSession, d: str) -> DataFrame:
    held = loop.history(_iterations(spark, d), "conv_id", "iteration", F.col("response").alias("summary"))
    return held.select("conv_id", text.iteration_history(F.col("history")).alias("history"))


@query("""SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS clicks,
 row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS processed FROM events""")
def running_counters(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clicks = F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).over(w)
    return _t(spark, d, "events").select("event_id", "user_id", clicks.alias("clicks"), F.count("*").over(w).alias("processed"))


@query("""SELECT o_custkey, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS hot, CAST(count(*) FILTER (WHERE l_returnflag <> 'R') AS BIGINT) AS lot
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def hot_lot_counts(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("h"), F.count_if(F.col("l_returnflag") != "R").alias("l"))
    per = lines.join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return per.groupBy("o_custkey").agg(F.sum("h").alias("hot"), F.sum("l").alias("lot"))


@query("""WITH s AS (SELECT lang, source, n_chars % 2 AS variant, avg(n_chars) AS score FROM documents GROUP BY ALL),
w AS (SELECT lang, source, max(score) FILTER (WHERE variant = 0) AS base, max(score) FILTER (WHERE variant = 1) AS tuned FROM s GROUP BY lang, source)
SELECT lang, avg(base) AS base, avg(tuned) AS tuned, avg(tuned) - avg(base) AS delta FROM w GROUP BY ROLLUP (lang)""")
def model_report(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "documents").groupBy("lang", "source", F.when(F.col("n_chars") % 2 == 0, "base").otherwise("tuned").alias("variant")).agg(F.avg("n_chars").alias("score"))
    return stats.report(s, "lang", "source", "variant", "score", ("base", "tuned"))


@query("""SELECT user_id % 5 AS k, CASE user_id % 5 WHEN 0 THEN 'case_a_independent_performance_mastery' WHEN 1 THEN 'case_b_scaffolded_coached_mastery'
 WHEN 2 THEN 'case_c_teacher_modeling_distillation' WHEN 3 THEN 'case_a_independent_performance_mastery' END AS sft_case, count(*) AS n FROM events GROUP BY ALL""")
def legacy_cases(spark: SparkSession, d: str) -> DataFrame:
    k = F.pmod("user_id", F.lit(5))
    old = F.when(k == 0, "A").when(k == 1, "B").when(k == 2, "C")
    e = _t(spark, d, "events").select(k.alias("k"), stats.legacy_case(old, k == 3).alias("sft_case"))
    return e.groupBy("k", "sft_case").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------- sampling

DRAW = "md5('42:' || doc_id)"


@query("SELECT doc_id, n_chars, CASE WHEN p < n // 3 THEN 0 WHEN p < 2 * (n // 3) THEN 1 ELSE 2 END AS third FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS p, count(*) OVER () AS n FROM documents)")
def terciles(spark: SparkSession, d: str) -> DataFrame:
    return sample.global_thirds(_t(spark, d, "documents").select("doc_id", "n_chars"), F.col("n_chars"), "doc_id")


@query(f"SELECT doc_id, lang FROM documents ORDER BY {DRAW}, doc_id LIMIT 20")
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample.random_sample(_t(spark, d, "documents").select("doc_id", "lang"), 20, "doc_id")


@query(f"""WITH pool AS (SELECT doc_id, n_chars FROM documents ORDER BY {DRAW}, doc_id LIMIT 60),
t AS (SELECT *, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS p, count(*) OVER () AS n FROM pool),
th AS (SELECT *, CASE WHEN p < n // 3 THEN 0 WHEN p < 2 * (n // 3) THEN 1 ELSE 2 END AS third FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY third ORDER BY md5('43:' || doc_id), doc_id) AS rn FROM th)
SELECT doc_id, n_chars, third FROM r WHERE rn <= 20 // 3 + CASE WHEN third < 20 % 3 THEN 1 ELSE 0 END""")
def diverse_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample.diverse_sample(_t(spark, d, "documents").select("doc_id", "n_chars"), 20, F.col("n_chars"), "doc_id")


@query(f"""WITH s AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS rk, count(*) OVER () AS m FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
f AS (SELECT d.doc_id, d.lang, d.source, 22 // s.m + CASE WHEN s.rk < 22 % s.m THEN 1 ELSE 0 END AS quota,
 CASE WHEN row_number() OVER (PARTITION BY d.lang, d.source ORDER BY {DRAW}, d.doc_id) = 1 THEN 0 ELSE 1 END AS lead FROM documents d JOIN s USING (lang)),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY lead, {DRAW}, doc_id) AS place FROM f)
SELECT doc_id, lang, source FROM p WHERE place <= quota""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return sample.stratified_sample(rows, 22, F.col("lang"), F.col("source"), F.col("n_chars"), "doc_id").select("doc_id", "lang", "source")


# ------------------------------------------------------- objectives, exports


def _verdict() -> Column:
    return F.when(F.col("l_linestatus") == "O", True).when(F.col("l_returnflag") == "N", None).otherwise(False)


@query("""SELECT l_orderkey, bool_and(l_linestatus = 'O') AS all_satisfied, CAST(count(*) FILTER (WHERE l_linestatus <> 'O' AND l_returnflag <> 'N') AS BIGINT) AS n_unmet FROM lineitem GROUP BY l_orderkey""")
def po_all_satisfied(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts that are rows need no array: one aggregate with partial sums."""
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(*loop.satisfaction(_verdict()))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus <> 'O' AND l_returnflag <> 'N'")
def failed_pos(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").where(~F.coalesce(_verdict(), F.lit(True))).select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, bool_and(l_linestatus = 'O') AS all_satisfied, CAST(count(*) FILTER (WHERE l_linestatus <> 'O' AND l_returnflag <> 'N') AS INT) AS n_unmet FROM lineitem GROUP BY l_orderkey""")
def nested_objectives(spark: SparkSession, d: str) -> DataFrame:
    """The same from the arrays that a teacher's evaluation holds."""
    o = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("objective_content"), _verdict().alias("is_satisfied"))).alias("objectives"))
    return o.select("l_orderkey", loop.all_satisfied(F.col("objectives")).alias("all_satisfied"), F.size(loop.unmet(F.col("objectives"))).alias("n_unmet"))


@query(f"""WITH {ITER}, {CLASSIFIED}, r AS (SELECT conv_id, max_by(response, iteration) AS response FROM iter GROUP BY conv_id)
SELECT 'Solve the following problem step by step.' AS instruction, 'Question: q' || conv_id AS input, response AS output, CAST(conv_id AS VARCHAR) AS id, sft_case
FROM r JOIN cases USING (conv_id) WHERE response <> ''""")
def sft_export(spark: SparkSession, d: str) -> DataFrame:
    it = _iterations(spark, d)
    cases = loop.classify(it, "conv_id", "iteration", "satisfied", 5)
    last = it.groupBy("conv_id").agg(F.max_by("response", "iteration").alias("initial_response"))
    log = cases.join(last, "conv_id").select(
        F.col("conv_id").cast("string").alias("id"), F.lit("").alias("instruction"), F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("input"), F.lit("t").alias("output"), "sft_case", F.lit("").alias("sft_response"), "initial_response"
    )
    return sft.entries(log).select("instruction", "input", "output", "metadata.id", "metadata.sft_case")


@query("SELECT doc_id, rtrim('Read ' || source) AS instruction FROM documents")
def strip_format(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("Read "), F.col("source"), F.lit(" \n\n## Response Format\nuse a box\n\n## Response Format\nx"))
    return _t(spark, d, "documents").select("doc_id", text.without_response_format(body).alias("instruction"))


@query("""SELECT string_agg('### Sample ' || p || chr(10) || CASE WHEN p % 2 = 0 THEN repeat('Read. ', 33) || 'Re' ELSE 'N/A' END || chr(10) || left(text, 500) || chr(10), chr(10) ORDER BY p) AS prompt
FROM (SELECT item_id, text, row_number() OVER (ORDER BY item_id) AS p FROM benchmark ORDER BY item_id LIMIT 20)""")
def sample_prompt(spark: SparkSession, d: str) -> DataFrame:
    """Twenty of the first 25 items; every second has an instruction, which is longer than what is shown."""
    few = _t(spark, d, "benchmark").orderBy("item_id").limit(25)
    held = few.agg(F.array_sort(F.collect_list(F.struct("item_id", F.col("text").alias("input")))).alias("s"))
    told = F.transform("s", lambda x, i: F.struct(F.when(i % 2 == 1, F.repeat(F.lit("Read. "), F.lit(50))).alias("instruction"), x["input"].alias("input")))
    return held.select(text.numbered_samples(told).alias("prompt"))


# --------------------------------------------------- model text, JSON, streams


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'HOT' ELSE 'LOT' END AS skill, 'Name ' || s_name AS target, 'Apply' AS level,
 CASE WHEN s_suppkey % 2 = 0 THEN 'try ' || s_name END AS strategy, CASE WHEN s_suppkey % 2 = 1 THEN 'miss ' || s_name END AS missed,
 'keep on' AS feedback, 'sum ' || s_name AS summary FROM supplier""")
def scaffold_parse(spark: SparkSession, d: str) -> DataFrame:
    high = F.col("s_suppkey") % 2 == 0
    head = F.concat(F.lit("Goal\n[Scaffolding for Task [1] ("), F.when(high, "High Order Skill").otherwise("Low Order Skill"), F.lit(")]:\n- Target Objective: Name "), F.col("s_name"))
    mid = F.lit("\n- Cognitive Level: Apply\n- Failure Analysis: none")
    tail = F.when(high, F.concat(F.lit("\n- Suggested Strategy:\n try "), F.col("s_name"), F.lit("\n- Key Attention Points: all"))).otherwise(F.concat(F.lit("\n- Missed Concept/Information: miss "), F.col("s_name"), F.lit("\n- Brief Explanation: so")))
    body = F.concat(head, mid, tail, F.lit("\n[Feedback]\nkeep on\n[Iteration Summary]\nsum "), F.col("s_name"), F.lit("\n"))
    a = F.get(scaffold.artifacts(body), F.lit(0))
    return _t(spark, d, "supplier").select(
        "s_suppkey", a["skill_type"].alias("skill"), a["target_objective"].alias("target"), a["cognitive_level"].alias("level"), a["scaffolding_content"]["strategy_suggestion"].alias("strategy"),
        a["scaffolding_content"]["missed_concept"].alias("missed"), scaffold.feedback(body).alias("feedback"), scaffold.summary(body).alias("summary"),
    )


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE c_name END AS name, CASE c_custkey % 4 WHEN 0 THEN 'a' || chr(10) || 'b' WHEN 1 THEN '\\(x\\)' WHEN 2 THEN '{in}' END AS note FROM customer""".replace("\\\\", "\\"))
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    name, form = F.col("c_name"), F.pmod("c_custkey", F.lit(4))
    body = (
        F.when(form == 0, F.concat(F.lit('Sure: {"name": "'), name, F.lit('", "note": "a\nb"} done')))
        .when(form == 1, F.concat(F.lit('{"name": "'), name, F.lit('", "note": "\\(x\\)"}')))
        .when(form == 2, F.concat(F.lit('```json\n{"name": "'), name, F.lit('", "note": "{in}"}\n```')))
        .otherwise(F.concat(F.lit("no object, "), name))
    )
    got = F.from_json(jsonfix.json_object(body), "name string, note string")
    return _t(spark, d, "customer").select("c_custkey", got["name"].alias("name"), got["note"].alias("note"))


@query("SELECT s_suppkey, s_name || '|two' AS refs FROM supplier")
def artifact_refs(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("x\nInformation Retrieved from Scaffolding Artifact:\n- "), F.col("s_name"), F.lit("\nno\n • two \nImproved Reasoning:\n- three"))
    return _t(spark, d, "supplier").select("s_suppkey", F.array_join(scaffold.references(body), "|").alias("refs"))


@query("""SELECT n_nationkey, n_name AS goal, '├── a|│   └── b' AS subskills, 'The model will do ' || n_name AS fallback, 'Analyze"' AS level FROM nation""")
def analysis_tree(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("Instructional Goal: old\n# t\nInstructional Goal: "), F.col("n_name"), F.lit("\n ├── a\n│   └── b\n"))
    loose = F.concat(F.lit('"cognitive_level": "Analyze",\n\'The model will do '), F.col("n_name"), F.lit("'"))
    tree, back = scaffold.task_tree(body), scaffold.goal_fallback(loose)
    return _t(spark, d, "nation").select("n_nationkey", tree["instructional_goal"].alias("goal"), F.array_join(tree["subskills"], "|").alias("subskills"), back["instructional_goal"].alias("fallback"), back["cognitive_level"].alias("level"))


def _stub_student():  # noqa: ANN202
    """Right from the third attempt on for long prompts, at once for short ones."""

    def answer(prompts):  # noqa: ANN001, ANN202
        tries = prompts.str.count(r"\[Attempt") + 1
        n = prompts.str.extract(r"^(\d+)")[0]
        right = n.notna() & ((tries >= 3) | (n.fillna("1").astype(int) % 2 == 0))
        return ("\\boxed{" + n.where(right, "0") + "}").astype(str)

    return answer


def _saved(spark: SparkSession):  # noqa: ANN202
    """Writes a round to the shared folder, so that a lost executor asks no model twice."""
    path = work_path(spark, "loop")

    def save(rows: DataFrame, i: int) -> DataFrame:
        rows.write.parquet(f"{path}/{i}")
        return spark.read.schema(rows.schema).parquet(f"{path}/{i}")

    return save


@query("""SELECT i AS iteration, count(*) AS n, CAST(sum(CASE WHEN n_chars % 2 = 0 OR i = 3 THEN 1 ELSE 0 END) AS BIGINT) AS correct
FROM documents, (SELECT unnest([1, 2, 3]) AS i) WHERE i = 1 OR n_chars % 2 = 1 GROUP BY i""")
def iterative_loop(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars").cast("string")
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce(n, F.lit("none")).alias("prompt"), n.alias("truth"))
    held = loop.run_loop(docs, _stub_student, "numeric", _saved(spark), 5)
    return held.groupBy(F.col("iteration").cast("int").alias("iteration")).agg(F.count("*").alias("n"), F.count_if("is_correct").alias("correct"))


@query("SELECT event_type, count(*) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users, date_trunc('day', ts) AS day FROM events GROUP BY event_type, date_trunc('day', ts)")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """An extension: daily windows of events."""
    e = _t(spark, d, "events")
    return e.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
