"""More registered queries: symbolic grades, durable and live logs, a data source, skewed samples, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, symbolic, text
from ..operators import loop, resume, sample, sft, stats
from ..session import work_path
from ..sources import epochs, loader, records
from ..streaming import log as stream
from . import registry
from .catalogue import DRAW, ITER, LOG, _iterations, _log, _t
from .round_trips import query

# ------------------------------------------------------------------- grading


def _expressions(spark: SparkSession, d: str) -> DataFrame:
    n, form = F.col("p_size").cast("string"), F.pmod("p_partkey", F.lit(8))
    made = lambda pattern: F.concat(*[n if i else F.lit(x) for x in pattern.split("#") for i in (0, 1)][:-1])
    square = F.concat(F.lit("x^2-"), (F.col("p_size") * F.col("p_size")).cast("string"))
    next_ = (F.col("p_size") + 1).cast("string")
    pairs = [
        (made("#(x+1)"), made("#x+#")),
        (square, made("(x-#)(x+#)")),
        (F.concat(F.lit("sqrt("), (4 * F.col("p_size")).cast("string"), F.lit(")")), made("2sqrt(#)")),
        (F.concat(n, F.lit("/"), next_), F.concat(next_, F.lit("/"), n)),
        (made("x^#*x"), F.concat(F.lit("x^"), next_)),
        (made("#x+1"), made("#x+2")),
        (made("#x("), made("#x")),
        (made("(x+#)^2/(x+#)"), made("x+#")),
    ]
    pick = lambda i: F.coalesce(*[F.when(form == k, p[i]) for k, p in enumerate(pairs)])
    return _t(spark, d, "part").select("p_partkey", pick(0).alias("predicted"), pick(1).alias("truth"))


@query("SELECT p_partkey, p_partkey % 8 IN (0, 1, 2, 4, 7) AS is_correct FROM part")
def symbolic_grade(spark: SparkSession, d: str) -> DataFrame:
    """Expanded, factored, rooted and reduced forms, unequal ones, and one that can't be read."""
    return _expressions(spark, d).select("p_partkey", answers.same_answer(F.col("predicted"), F.col("truth")).alias("is_correct"))


@query("SELECT CASE WHEN p_partkey % 8 IN (0, 1, 2, 4, 7) THEN 'same' ELSE 'other' END AS verdict, count(*) AS n FROM part GROUP BY 1")
def symbolic_counts(spark: SparkSession, d: str) -> DataFrame:
    e = _expressions(spark, d)
    same = symbolic.same_expression(F.col("predicted"), F.col("truth"))
    return e.groupBy(F.when(same, "same").otherwise("other").alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT CASE c_custkey % 5 WHEN 0 THEN 'mcq' WHEN 1 THEN 'numeric' WHEN 2 THEN 'latex' WHEN 3 THEN 'boolean' ELSE 'text' END AS answer_type, count(*) AS evaluated, count(*) FILTER (WHERE c_nationkey % 3 > 0) AS correct, CAST(count(*) FILTER (WHERE c_nationkey % 3 > 0) AS DOUBLE) / count(*) AS accuracy FROM customer GROUP BY 1")
def grade_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every answer type graded by their own type's rule; every third nation's are wrong."""
    key, wrong = F.col("c_custkey").cast("string"), F.col("c_nationkey") % 3 == 0
    kind = F.element_at(F.array(*[F.lit(x) for x in ("mcq", "numeric", "latex", "boolean", "text")]), F.pmod("c_custkey", F.lit(5)).cast("int") + 1)
    forms = {
        "mcq": ("b ", "B", "C"),
        "numeric": (F.concat(key, F.lit(".0")), key, F.concat(key, F.lit("1"))),
        "latex": (F.concat(F.lit("\\frac{"), key, F.lit("}{2}")), F.concat(key, F.lit("/2")), F.concat(key, F.lit("/3"))),
        "boolean": ("true", "Yes", "No"),
        "text": ("So it is!", "so it is", "so it was"),
    }
    column = lambda x: F.lit(x) if isinstance(x, str) else x
    of = lambda i: F.coalesce(*[F.when(kind == t, column(v[i])) for t, v in forms.items()])
    rows = _t(spark, d, "customer").select(kind.alias("answer_type"), of(0).alias("predicted"), F.when(wrong, of(2)).otherwise(of(1)).alias("truth"))
    graded = rows.withColumn("is_correct", answers.grade_by(F.col("answer_type"), F.col("predicted"), F.col("truth")))
    return stats.accuracy(graded, ["answer_type"])


# ------------------------------------------------------------ logs and streams


def _as_lines(spark: SparkSession, d: str, tag: str) -> str:
    """Events as a log folder; every tenth line is broken, the one after it blank."""
    e, path = _t(spark, d, "events"), work_path(spark, tag)
    key = F.col("event_id").cast("string")
    row = F.to_json(F.struct(key.alias("id"), F.col("event_type").alias("sft_case")))
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit('{"id": '), key, F.lit(', "sft'))).when(F.col("event_id") % 10 == 1, " ").otherwise(row)
    e.select(line.alias("value")).repartition(4).write.text(path)
    return path


@query("SELECT event_id, 'dead' AS kind, true AS placed FROM events WHERE event_id % 10 = 0 UNION ALL SELECT event_id, 'row' AS kind, true AS placed FROM events WHERE event_id % 10 > 1")
def rejected_lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a log beside its malformed lines, each with file, block and place."""
    path = _as_lines(spark, d, "rejected")
    held = records.checked(records.located_lines(spark, path), registry.RESULT)
    bad = records.rejected(held).select(F.regexp_extract("value", r"(\d+)", 1).cast("long").alias("event_id"), F.lit("dead").alias("kind"), (F.col("file").contains("part-") & (F.col("block") >= 0) & (F.col("line") >= 0)).alias("placed"))
    good = records.accepted(held.select("value", "r"), registry.RESULT).select(F.col("id").cast("long").alias("event_id"), F.lit("row").alias("kind"), F.lit(True).alias("placed"))
    return bad.unionByName(good)


@query("SELECT event_id % 10 = 0 AS dead, count(*) AS n FROM events WHERE event_id % 10 <> 1 GROUP BY 1")
def split_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same lines as a stream into two durable logs; every batch sent again adds nothing."""
    path = _as_lines(spark, d, "split")
    good, bad = f"{path}-good", f"{path}-bad"
    sink = stream.split_sink(good, bad, registry.RESULT)

    def twice(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        sink(batch, number)

    stream.run_to_end(stream.read_lines(spark, path), twice, f"{path}-state")
    kinds = [epochs.read(spark, p).select(F.lit(p == bad).alias("dead")) for p in (good, bad)]
    return kinds[0].unionByName(kinds[1]).groupBy("dead").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def log_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events replayed as a stream, each user once a kind, appended as epochs, then counted by kind."""
    events = _t(spark, d, "events").select("user_id", "event_type")
    path = work_path(spark, "log-stream")
    rows = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = stream.once(rows.withColumn("id", F.concat_ws("|", "user_id", "event_type")))
    stream.run_to_end(rows, epochs.sink(path), f"{path}-state")
    return epochs.read(spark, path).groupBy("event_type").agg(F.count("user_id").alias("users"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def restored_ids(spark: SparkSession, d: str) -> DataFrame:
    """What is left to do, from the ids that a stopped stream holds in its checkpoint."""
    path = work_path(spark, "restored")
    rows = spark.readStream.schema("user_id bigint").option("pathGlobFilter", "events.parquet").parquet(d)
    stream.run_to_end(stream.once(rows.select(F.col("user_id").cast("string").alias("id"))), epochs.sink(path), f"{path}-state")
    done = stream.restored(spark, f"{path}-state", "id")
    return resume.remaining(_t(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("id")), done).select("c_custkey")


@query(f"""WITH {ITER}, s AS (SELECT conv_id, min(iteration) FILTER (WHERE satisfied) AS first_success, count(*) AS n, count(*) FILTER (WHERE conv_id % 2 = 1 OR iteration > 1) AS streamed FROM iter GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS id, CAST(least(coalesce(first_success, n), 3) AS INT) AS iterations, coalesce(first_success <= 3, false) AS satisfied,
CASE WHEN first_success = 1 THEN '{registry.CASE_A}' WHEN first_success <= 3 THEN '{registry.CASE_B}' WHEN n >= 3 THEN '{registry.CASE_C}' END AS sft_case
FROM s WHERE streamed > 0""")
def question_progress(spark: SparkSession, d: str) -> DataFrame:
    """State of each question from a stream of attempts, begun with what the log has of every second one."""
    stream.needs_rocksdb(spark)
    every = _iterations(spark, d).select(F.col("conv_id").cast("string").alias("id"), F.col("iteration").cast("int").alias("iteration"), "satisfied")
    logged = (F.col("id").cast("long") % 2 == 0) & (F.col("iteration") == 1)
    path = work_path(spark, "progress")
    every.where(~logged).write.parquet(f"{path}-in")
    live = spark.readStream.schema(every.schema).parquet(f"{path}-in")
    stream.run_to_end(stream.progress(live, 3, every.where(logged)), epochs.sink(path), f"{path}-state", "update")
    last = F.max_by(F.struct("satisfied", "sft_case"), "iterations")
    return epochs.read(spark, path).groupBy("id").agg(F.max("iterations").alias("iterations"), last.alias("s")).select("id", "iterations", "s.satisfied", "s.sft_case")


# ------------------------------------------------------------------ a data source


@query("SELECT doc_id, lang, length(text) AS n, true AS in_parts FROM documents WHERE lang IN ('de', 'fr') AND doc_id % 2 = 1")
def loader_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents written by dataset through the data source, and two datasets read back in parts, the others' files left unread."""
    loader.register(spark)
    path = work_path(spark, "records")
    docs = _t(spark, d, "documents")
    rows = docs.select(F.col("lang").alias("dataset"), F.col("doc_id").cast("string").alias("id"), F.lit("").alias("instruction"), F.col("text").alias("input"), F.lit("o").alias("output"), F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    rows.repartition("id").write.format(loader.NAME).mode("append").save(path)
    read = lambda: spark.read.format(loader.NAME).load(path)
    held = read().where("dataset in ('de', 'fr')").where("cast(id as bigint) % 2 = 1")
    parts = held.rdd.getNumPartitions()
    return held.select(F.col("id").cast("long").alias("doc_id"), F.col("dataset").alias("lang"), F.length("input").alias("n"), F.lit(1 < parts < read().rdd.getNumPartitions()).alias("in_parts"))


# ----------------------------------------------------------------------- samples

_EVENT_DRAW = "md5('42:' || event_id)"


@query(f"""WITH e AS (SELECT event_id, user_id % 3 AS s, CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE event_type END AS p FROM events),
q AS (SELECT p, 40 // m + CASE WHEN rk < 40 % m THEN 1 ELSE 0 END AS quota FROM (SELECT p, row_number() OVER (ORDER BY p) - 1 AS rk, count(*) OVER () AS m FROM (SELECT DISTINCT p FROM e))),
f AS (SELECT e.*, quota, CASE WHEN row_number() OVER (PARTITION BY p, s ORDER BY {_EVENT_DRAW}, event_id) = 1 THEN 0 ELSE 1 END AS lead FROM e JOIN q USING (p))
SELECT event_id, p FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY lead, {_EVENT_DRAW}, event_id) AS place FROM f) WHERE place <= quota""")
def skewed_strata(spark: SparkSession, d: str) -> DataFrame:
    """A third of all rows is one stratum."""
    e = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("event_type")).alias("p"), (F.col("user_id") % 3).cast("string").alias("s"), F.length("props").alias("n"))
    return sample.stratified_sample(e, 40, F.col("p"), F.col("s"), F.col("n"), "event_id").select("event_id", "p")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus AS p, length(o_orderpriority) AS len FROM orders),
q AS (SELECT p, 25 // m + CASE WHEN rk < 25 % m THEN 1 ELSE 0 END AS quota FROM (SELECT p, row_number() OVER (ORDER BY p) - 1 AS rk, count(*) OVER () AS m FROM (SELECT DISTINCT p FROM o))),
t AS (SELECT o.*, quota, row_number() OVER (PARTITION BY p ORDER BY len, o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY p) AS n FROM o JOIN q USING (p)),
h AS (SELECT *, CASE WHEN pos < n // 3 THEN 0 WHEN pos < 2 * (n // 3) THEN 1 ELSE 2 END AS third FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY p, third ORDER BY md5('42:' || o_orderkey), o_orderkey) AS rn FROM h),
f AS (SELECT *, CASE WHEN rn <= quota // 3 + CASE WHEN third < quota % 3 THEN 1 ELSE 0 END THEN 0 ELSE 1 END AS first FROM r)
SELECT o_orderkey, p FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY first, md5('42:' || o_orderkey), o_orderkey) AS place FROM f) WHERE place <= quota""")
def length_strata(spark: SparkSession, d: str) -> DataFrame:
    """Strata without a second level go by thirds of length, within strata of any size."""
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("p"), F.length("o_orderpriority").alias("n"))
    return sample.stratified_sample(o, 25, F.col("p"), F.lit("one"), F.col("n"), "o_orderkey").select("o_orderkey", "p")


@query("SELECT 'c' || c_custkey AS id, row_number() OVER (ORDER BY length(c_name), 'c' || c_custkey) - 1 AS place FROM customer")
def places_of_text_ids(spark: SparkSession, d: str) -> DataFrame:
    """Positions by length of rows whose ids are texts and whose lengths are nearly all one."""
    c = _t(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.length("c_name").alias("n"))
    return sample.places(c, "n", "id").select("id", "place")


# ----------------------------------------------------------------------- reports


@query("""WITH w AS (SELECT lang, source, source < 'm' AS home, avg(n_chars) FILTER (WHERE n_chars % 2 = 0) AS base, avg(n_chars) FILTER (WHERE n_chars % 2 = 1) AS tuned FROM documents GROUP BY ALL)
SELECT lang, CASE WHEN grouping(lang) = 1 THEN 'all' WHEN grouping(home) = 1 THEN 'model' WHEN home THEN 'home' ELSE 'away' END AS part, count(*) AS datasets, avg(base) AS base, avg(tuned) AS tuned, avg(tuned) - avg(base) AS delta,
CASE WHEN grouping(home) = 1 THEN avg(CASE WHEN home THEN tuned END) - avg(CASE WHEN home THEN base END) - avg(CASE WHEN NOT home THEN tuned END) + avg(CASE WHEN NOT home THEN base END) END AS gap
FROM w GROUP BY GROUPING SETS ((lang, home), (lang), ())""")
def domain_report(spark: SparkSession, d: str) -> DataFrame:
    """Home datasets against the others, by model and over all, and the gap between what the two gained."""
    s = _t(spark, d, "documents").groupBy("lang", "source", F.when(F.col("n_chars") % 2 == 0, "base").otherwise("tuned").alias("variant")).agg(F.avg("n_chars").alias("score"))
    return stats.domain_report(s, "lang", "source", "variant", "score", ("base", "tuned"), F.col("source") < "m")


@query(f"""WITH {LOG}, one AS (SELECT id, min(sft_case) AS sft_case, CAST(id AS BIGINT) % 4 AS part FROM log WHERE id IS NOT NULL GROUP BY id)
SELECT part, count(*) AS processed, count(*) FILTER (WHERE sft_case LIKE 'case_a%') / count(*) AS case_a_share, count(*) FILTER (WHERE sft_case LIKE 'case_b%') / count(*) AS case_b_share,
count(*) FILTER (WHERE sft_case LIKE 'case_c%') / count(*) AS case_c_share, count(*) FILTER (WHERE sft_case = 'skipped') / count(*) AS skipped_share FROM one GROUP BY ROLLUP (part)""")
def case_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the outcomes by group and over all."""
    return stats.case_shares(_log(spark, d).withColumn("part", F.col("id").cast("bigint") % 4), "part")


@query("SELECT o_custkey, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS hot, CAST(count(*) FILTER (WHERE o_orderstatus <> 'F') AS BIGINT) AS lot FROM orders GROUP BY o_custkey")
def skill_counts(spark: SparkSession, d: str) -> DataFrame:
    """Guidance of both orders counted in the nested arrays of each row."""
    kind = F.when(F.col("o_orderstatus") == "F", "HOT").otherwise("LOT")
    rounds = F.array(F.struct(F.array(F.struct(kind.alias("skill_type"))).alias("artifacts")))
    hot, lot = stats.skill_counts(F.col("r"))
    per = _t(spark, d, "orders").select("o_custkey", rounds.alias("r")).select("o_custkey", hot.alias("h"), lot.alias("l"))
    return per.groupBy("o_custkey").agg(F.sum("h").alias("hot"), F.sum("l").alias("lot"))


# ------------------------------------------------------ entries, columns and names


@query("SELECT CAST(item_id AS VARCHAR) AS id, CASE WHEN item_id % 2 = 0 THEN 'Do it.' || chr(10) || chr(10) ELSE '' END || 'g' || chr(10) || chr(10) || 'a' AS instruction, 'Question: ' || text AS input FROM benchmark")
def sft_goal(spark: SparkSession, d: str) -> DataFrame:
    """Training entries with a goal and an analysis after the record's own instruction, which loses its format section."""
    own = F.when(F.col("item_id") % 2 == 0, "Do it.\n\n## Response Format\nso").otherwise("")
    log = _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), own.alias("instruction"), F.col("text").alias("input"), F.lit("t").alias("output"), F.lit(registry.CASE_B).alias("sft_case"), F.lit("r").alias("sft_response"), F.lit("").alias("initial_response"))
    return sft.entries(log, "g", "a").select("metadata.id", "instruction", "input")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, 'id,instruction,input,output,rest' AS columns FROM supplier")
def log_columns(spark: SparkSession, d: str) -> DataFrame:
    """Inner columns go, identity, question and answer lead."""
    s = _t(spark, d, "supplier").select(F.lit(1).alias("_prompt"), F.lit("r").alias("rest"), F.lit("o").alias("output"), F.lit("i").alias("input"), F.col("s_suppkey").cast("string").alias("id"), F.lit("d").alias("instruction"))
    seen = sft.log_view(s)
    return seen.select("id", F.lit(",".join(seen.columns)).alias("columns"))


@query("SELECT l_orderkey, bool_and(l_linenumber <> 3) AS valid FROM lineitem GROUP BY l_orderkey")
def valid_objectives(spark: SparkSession, d: str) -> DataFrame:
    """Objectives of which each third has no target."""
    one = F.struct(F.when(F.col("l_linenumber") != 3, "t").alias("target"), F.lit("p").alias("performance_objective"))
    o = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(one).alias("o"))
    return o.select("l_orderkey", loop.valid_objectives(F.col("o")).alias("valid"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Read.' || chr(10) || chr(10) ELSE '' END || CASE WHEN length(text) > 60 THEN left(text, 60) || '...' ELSE text END AS prompt, source AS model FROM documents")
def short_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Instruction and question as one prompt, the question cut; a model's short name."""
    t = text.as_prompt(F.when(F.col("doc_id") % 2 == 0, "Read."), text.clip(F.col("text"), 60))
    return _t(spark, d, "documents").select("doc_id", t.alias("prompt"), text.short_name(F.concat(F.lit("org/"), F.col("source"))).alias("model"))


@query(f"SELECT 'svamp' AS known, doc_id FROM documents WHERE {DRAW} < '8'")
def raw_table(spark: SparkSession, d: str) -> DataFrame:
    """A raw table written as JSON lines and as Parquet, read from both by its ending."""
    path = work_path(spark, "raw")
    docs = _t(spark, d, "documents").select("doc_id", sample.draw("doc_id", 42).alias("draw"))
    docs.where("draw < '4'").write.json(f"{path}.jsonl")
    docs.where("draw >= '4' and draw < '8'").write.parquet(f"{path}.parquet")
    both = records.raw(spark, f"{path}.jsonl", docs.schema).unionByName(records.raw(spark, f"{path}.parquet"))
    return both.select(F.lit(next(x for x in registry.datasets() if x.startswith("sv"))).alias("known"), "doc_id")


@query("SELECT CAST(4 AS BIGINT) AS files, count(*) AS n FROM events")
def file_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records of each file of a folder of JSON lines: how many files, and how many rows in all."""
    path = work_path(spark, "per-file")
    e = _t(spark, d, "events").select("event_id")
    e.repartition(4).write.json(path)
    per = records.records_per_file(spark.read.schema(e.schema).json(path))
    return per.agg(F.count("*").alias("files"), F.sum("n").alias("n"))
