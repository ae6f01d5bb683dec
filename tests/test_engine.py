"""Sampling, logs, resume, exports, JSON repair, the loop and the stream, as behaviours."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import jsonfix, scaffold, text
from tessera.operators import loop, prepare, resume, sample, sft, stats
from tessera.plans import registry
from tessera.sources import epochs, records, sinks
from tessera.streaming import log as stream

CASES = {"a": registry.CASE_A, "b": registry.CASE_B, "c": registry.CASE_C, "s": registry.SKIPPED}


def result(i, case):
    return {
        "id": f"q{i}", "question_id": f"q{i}", "instruction": "Do", "input": f"in {i}", "output": f"out {i}", "initial_response": f"first {i}",
        "predicted_answer": "1", "is_correct": True, "scaffolding_correct": True, "sft_case": CASES[case], "sft_response": f"best {i}", "scaffolding_artifacts": None, "skip_reason": None,
    }


def write_lines(path, rows, junk=()):
    path.mkdir(parents=True, exist_ok=True)
    (path / "part.json").write_text("\n".join([*map(json.dumps, rows), *junk]) + "\n")


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in registry.RESULT.names) for r in rows], registry.RESULT)


def test_entries_from_final_log(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text(json.dumps({"scaffolding_results": [result(0, "a"), result(1, "b"), result(2, "c")], "is_complete": True}))
    assert sft.entries(records.any_log(spark, str(path))).count() == 3


def test_entries_leave_out_skipped(spark):
    got = sft.entries(frame(spark, [result(i, c) for i, c in enumerate("abcs")]))
    assert got.count() == 3
    assert got.orderBy("input").first()["input"] == "Question: in 0"


def test_missing_log_is_empty(spark, tmp_path):
    assert sft.entries(records.any_log(spark, str(tmp_path / "none.json"))).count() == 0


def test_entries_fall_back_to_first_response(spark):
    row = result(0, "a") | {"sft_response": ""}
    nothing = result(1, "a") | {"sft_response": None, "initial_response": ""}
    got = sft.entries(frame(spark, [row, nothing])).collect()
    assert [r["output"] for r in got] == ["first 0"]


def test_lines_pass_over_junk(spark, tmp_path):
    write_lines(tmp_path / "log.jsonl", [result(0, "a")], ["", "{broken", "   "])
    assert records.json_lines(spark, str(tmp_path / "log.jsonl")).count() == 1


def test_finalise_turns_lines_into_the_log(spark, tmp_path):
    write_lines(tmp_path / "log.jsonl", [result(i, c) for i, c in enumerate("aaaaabbbcc")])
    path = str(tmp_path / "log.json")
    assert sinks.finalise(spark, path) == "lines"
    assert not (tmp_path / "log.jsonl").exists()
    held = json.loads((tmp_path / "log.json").read_text())
    assert len(held["scaffolding_results"]) == 10
    assert held["statistics"]["case_a"] == 5
    assert sft.entries(records.any_log(spark, path)).count() == 10


def test_a_log_with_a_result_a_line_is_read_in_parts(spark, tmp_path):
    path, size = str(tmp_path / "log.json"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.lit("A").alias("sft_case"), (F.col("id") % 2 == 0).alias("phase1_correct"))
    sinks.write_joined(rows.repartition(5), path, '{"phase1_results": [', "]}")
    assert len(json.loads((tmp_path / "log.json").read_text())["phase1_results"]) == 4000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = records.json_log(spark, path)
        assert got.rdd.getNumPartitions() > 4
        assert {r["id"] for r in got.collect()} == {str(i) for i in range(4000)}
        sinks.export_array(rows.withColumn("n", F.col("id").cast("long")), f"{path}-array", "n")
        kind = T.StructType([T.StructField("id", T.StringType())])
        assert all(str(r["pos"]) == r["id"] for r in records.json_array(spark, f"{path}-array", kind).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.mark.parametrize(
    ("body", "ids"),
    [
        ('{"phase1_results": [{"id": "a"}, {"id": "b"}]}', ["a", "b"]),
        ('{"phase1_results": [\n{"id": "a"},\n {"id": "b"}\n]}\n', ["a", "b"]),
        ('{"scaffolding_results": [\n{"id": "a"}\n,{"id": "b"}\n], "phase1_results": [\n{"id": "c"}\n]}', ["a", "b"]),
        ('{\n  "scaffolding_results": [\n    {\n      "id": "a"\n    }\n  ]\n}', ["a"]),
        ('{"scaffolding_results": [\n{"id": "a"}\n{"id": "b"}\n]}', []),
        ('{"scaffolding_results": [\n{"id": "a"}\n,{"id": \n]}', []),
        ('{"scaffolding_results": []}', []),
    ],
)
def test_any_layout_of_a_log_has_the_same_rows(spark, tmp_path, body, ids):
    (tmp_path / "log.json").write_text(body)
    assert sorted(r["id"] for r in records.json_log(spark, str(tmp_path / "log.json")).collect()) == ids


def test_finalise_from_state(spark, tmp_path):
    assert sinks.finalise(spark, str(tmp_path / "x.json"), frame(spark, [result(0, "a"), result(1, "b")])) == "state"
    assert records.json_log(spark, str(tmp_path / "x.json")).count() == 2


def test_statistics_count_an_id_once(spark):
    row = stats.case_statistics(frame(spark, [result(0, "a"), result(0, "a"), result(1, "c"), result(2, "s") | {"id": ""}])).first()
    assert (row["processed"], row["case_a"], row["case_c"], row["success_rate"]) == (2, 1, 1, 0.5)


def test_statistics_of_nothing(spark):
    row = stats.case_statistics(spark.createDataFrame([], registry.RESULT)).first()
    assert (row["processed"], row["success_rate"]) == (0, 0.0)


def test_resume_twice_is_resume_once(spark):
    questions = spark.createDataFrame([(str(i),) for i in range(6)], "id string")
    done = spark.createDataFrame([("1",), ("1",), ("4",), (None,), ("zz",)], "id string")
    left = resume.remaining(questions, done)
    assert sorted(r["id"] for r in left.collect()) == ["0", "2", "3", "5"]
    merged = resume.merged(done.where("id = '1'").distinct(), questions)
    assert resume.complete(questions, merged)


def test_positions_and_records(spark, tmp_path):
    rows = [{"instruction": "i", "input": f"q{i}", "output": f"The answer is \\boxed{{{i}}}", "metadata": {}} for i in range(5)]
    (tmp_path / "gsm8k_train.json").write_text(json.dumps(rows))
    got = records.load(spark, str(tmp_path / "gsm8k_train.json"), "gsm8k", "train", limit=3).collect()
    assert [(r["question_id"], r["ground_truth"], r["answer_type"]) for r in got] == [(f"gsm8k_train_{i}", str(i), "numeric") for i in range(3)]
    with pytest.raises(ValueError, match="unknown"):
        records.load(spark, "x", "nope", "train")


def test_thirds_of_eight(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(8)], "id int, n int")
    for got in (sample.thirds(df, F.col("n")), sample.global_thirds(df, F.col("n"), "id")):
        assert [r["third"] for r in got.orderBy("id").collect()] == [0, 0, 1, 1, 2, 2, 2, 2]


def test_thirds_with_ties(spark):
    df = spark.createDataFrame([(i, 1) for i in range(7)], "id int, n int")
    assert [r["third"] for r in sample.global_thirds(df, F.col("n"), "id").orderBy("id").collect()] == [0, 0, 1, 1, 2, 2, 2]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], "xy"[i % 2], i) for i in range(90)], "id int, p string, s string, n int")
    args = (20, F.col("p"), F.col("s"), F.col("n"))
    one, two = (sorted(r["id"] for r in sample.stratified_sample(df.repartition(k), *args).collect()) for k in (1, 7))
    assert one == two
    assert len(one) == 20


def test_stratified_with_one_value_is_diverse(spark):
    df = spark.createDataFrame([(i, "a", None, i) for i in range(30)], "id int, p string, s string, n int")
    assert sample.stratified_sample(df, 9, F.col("p"), F.col("s"), F.col("n")).count() == 9


def test_quota(spark):
    got = spark.range(3).select(sample.quota(F.col("id"), 20, 3).alias("q")).collect()
    assert [r["q"] for r in got] == [7, 7, 6]


def test_raw_datasets(spark):
    g = spark.createDataFrame([("q", "why\n#### 5"), ("r", "6")], "question string, answer string")
    assert [r["output"] for r in prepare.gsm8k(g, reasoning=True).collect()] == ["why\n\nThe answer is \\boxed{5}", "The answer is \\boxed{6}"]
    a = spark.createDataFrame([("b", "q", "10 (apples)", "t", "f"), ("", "", "1", "t", "f")], "body string, question string, answer string, solution_type string, formula string")
    assert [r["output"] for r in prepare.asdiv(a).collect()] == ["The answer is \\boxed{10}"]
    r = spark.createDataFrame([("c", "q", ["x", "y"], 1, "id")], "context string, question string, answers array<string>, label int, id_string string")
    row = prepare.reclor(r).first()
    assert row["input"] == "Context:\nc\nQuestion: q\nOptions:\nA. x\nB. y"
    assert row["output"].endswith("{B}")
    n = spark.createDataFrame([("p", "h", 2, "u", None)], "premise string, hypothesis string, label int, uid string, reason string")
    assert prepare.anli(n).first()["output"].endswith("{C}")
    b = {"x": spark.createDataFrame([("i", "t")], "input string, target string"), "y": spark.createDataFrame([("j", "u")], "input string, target string")}
    assert {r["metadata"]["subtask"]: r["instruction"] for r in prepare.bbh(b, {"x": "X!"}).collect()} == {"x": "X!", "y": registry.PROMPTS["text"]}


def test_enrich_replaces_keys(spark):
    df = spark.createDataFrame([("i", "q", "o", {"task_analysis": "old", "k": "v"})], registry.RECORD)
    assert prepare.enrich(df, "g", "t").first()["metadata"] == {"k": "v", "instructional_goal": "g", "task_analysis": "t"}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('x {"a": 1} y', {"a": 1}),
        ('```json\n{"a": "b"}\n```', {"a": "b"}),
        ('{"a": "x\ny"}', {"a": "x\ny"}),
        ('{"a": "\\(z\\)"}', {"a": "\\(z\\)"}),
        ('{"a": "\\frac"}', {"a": "\x0crac"}),
        ('{"a": "}"} tail }', {"a": "}"}),
        ("none", None),
        ("", None),
        (None, None),
    ],
)
def test_json_object(raw, want):
    got = jsonfix.extract_object(raw)
    assert (None if got is None else json.loads(got)) == want


def test_satisfaction(spark):
    kind = "i int, o array<struct<is_satisfied:boolean>>"
    df = spark.createDataFrame([(0, []), (1, [(True,)]), (2, [(True,), (None,)]), (3, [(False,)]), (4, None)], kind)
    got = df.select(loop.all_satisfied(F.col("o")).alias("a"), F.size(loop.unmet(F.col("o"))).alias("n")).collect()
    assert [r["a"] for r in got] == [False, True, False, False, False]
    assert [r["n"] for r in got][:4] == [0, 0, 0, 1]


def test_loop_isolates_a_failing_batch(spark, tmp_path):
    def student():
        def answer(prompts):
            if prompts.str.contains("bad").any():
                raise RuntimeError("no " * 400)
            return prompts.map(lambda p: "\\boxed{1}" if "[Attempt 2]" in p else "\\boxed{0}")

        return answer

    def save(df, i):
        df.write.mode("overwrite").parquet(str(tmp_path / f"r{i}"))
        return spark.read.parquet(str(tmp_path / f"r{i}"))

    q = spark.createDataFrame([("a", "good", "1"), ("b", "bad", "1")], "id string, prompt string, truth string").repartition(2, "id")
    got = loop.run_loop(q, student, "numeric", save, 4).orderBy("id", "iteration").collect()
    assert [(r["id"], r["iteration"], r["is_correct"]) for r in got if r["id"] == "a"] == [("a", 1, False), ("a", 2, True)]
    bad = [r for r in got if r["id"] == "b"]
    assert len(bad) == 1
    assert len(bad[0]["error"]) == 503


def test_classification(spark):
    rows = [("a", 1, True), ("b", 1, False), ("b", 2, True), ("c", 1, False), ("c", 2, False)]
    got = loop.classify(spark.createDataFrame(rows, "q string, i int, ok boolean"), "q", "i", "ok", 5).orderBy("q").collect()
    assert [(r["sft_case"][:6], r["iterations_needed"]) for r in got] == [("case_a", 1), ("case_b", 2), ("case_c", 5)]


def test_history_words(spark):
    df = spark.createDataFrame([([(1, "x"), (2, ""), (3, "z")],), ([],)], "h array<struct<iteration:int,summary:string>>")
    assert [r[0] for r in df.select(text.iteration_history(F.col("h"))).collect()] == ["Iter 1: x\nIter 3: z", "(No iteration history available)"]


def test_scaffold_sections(spark):
    body = "h\n[Scaffolding for Task [1] (Low Order Skill)]:\n- Target Objective: t\n- Missed Concept/Information: m\n- Brief Explanation: e\n[Feedback]\nf\n"
    row = spark.createDataFrame([(body,)], "b string").select(scaffold.artifacts(F.col("b")).alias("a"), scaffold.feedback(F.col("b")).alias("f")).first()
    assert (row["a"][0]["skill_type"], row["a"][0]["scaffolding_content"]["brief_explanation"], row["f"]) == ("LOT", "e", "f")


def test_stream_counts_an_id_once(spark, tmp_path):
    write_lines(tmp_path / "in", [result(0, "a"), result(1, "b"), result(0, "a")], ["{bad"])
    rows = stream.once(stream.read_log(spark, str(tmp_path / "in"))).select("id", "sft_case")
    for _ in range(2):
        stream.run_to_end(rows, epochs.sink(str(tmp_path / "out")), str(tmp_path / "cp"))
    assert sorted(r["id"] for r in epochs.read(spark, str(tmp_path / "out")).collect()) == ["q0", "q1"]


def test_one_bad_question_fails_alone(spark):
    """Its neighbours in the batch are answered; it is asked ``attempts`` times with pauses between."""
    from tessera.operators import loop

    def factory():
        def model(prompts):
            if prompts.str.contains("bad").any():
                raise ValueError("no " * 400)
            return "re: " + prompts

        return model

    rows = spark.createDataFrame([(i, "bad" if i == 3 else f"p{i}") for i in range(8)], "id long, prompt string").coalesce(1)
    got = {r["id"]: (r["response"], r["error"]) for r in loop.respond(rows, "prompt", factory, attempts=2, backoff=0.01).collect()}
    assert all(got[i] == (f"re: p{i}", None) for i in range(8) if i != 3)
    assert got[3][0] is None
    assert got[3][1].startswith("no no")
    assert len(got[3][1]) == 503


def test_a_run_without_any_result_ends(spark, tmp_path):
    from tessera.sources import records, sinks

    path = str(tmp_path / "none.json")
    assert sinks.finalise(spark, path) == "state"
    assert records.json_log(spark, path).count() == 0
    assert not sinks.finished(spark, path, str(tmp_path / "missing"))


def test_places_with_one_hot_length_and_nulls(spark):
    from tessera.operators import sample

    rows = [(i, 5) for i in range(200)] + [(300, 1), (301, None), (302, 9), (None, 5)]
    got = sample.places(spark.createDataFrame(rows, "id long, n long").repartition(3), "n", "id").collect()
    low = lambda v: (v is not None, v)
    want = sorted(rows, key=lambda r: (low(r[1]), low(r[0])))
    assert [(r["id"], r["n"]) for r in sorted(got, key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in got) == list(range(len(rows)))


def test_histories_without_entries(spark):
    from pyspark.sql import functions as F

    from tessera.functions import text

    kind = "array<struct<iteration:int,feedback:string,summary:string,artifacts:array<struct<skill_type:string,target_objective:string>>>>"
    empty = F.array().cast(kind)
    blank = F.from_json(F.lit('[{"feedback": "", "summary": null}]'), kind)
    got = spark.range(1).select(text.feedback_history(empty), text.feedback_history(blank), text.scaffolding_history(empty), text.scaffolding_history(blank), text.latest_summary(blank)).first()
    assert tuple(got) == ("(No feedback history)", "(No feedback history)", "(No scaffolding history)", "\n[Iteration ?]", None)


def _questions(spark):
    rows = [("1", "I", "q1", "The answer is \\boxed{1}"), ("2", None, "q2", "The answer is \\boxed{2}"), ("3", "", None, None)]
    return spark.createDataFrame(rows, "id string, instruction string, input string, output string")


def _saver(spark, tmp_path):
    def save(rows, i):
        rows.write.parquet(f"{tmp_path}/{i}")
        return spark.read.schema(rows.schema).parquet(f"{tmp_path}/{i}")

    return save


def test_coaching_without_objectives_goes_by_the_grade(spark, tmp_path):
    from tessera.operators import coach

    student = lambda: lambda asked, _: asked.map(lambda p: "better" if "well" in p else "\\boxed{1}")
    teacher = lambda: lambda asked, _: asked.map(lambda p: "well" if p.startswith("Problem:\nq1") else "s")
    got = {r["id"]: r for r in coach.coach(_questions(spark), student, teacher, "numeric", _saver(spark, tmp_path), max_iterations=2).collect()}
    assert [got[k]["sft_case"][:6] for k in "123"] == ["case_a", "case_c", "case_c"]
    assert (got["1"]["initial_response"], got["1"]["sft_response"], got["1"]["iterations_needed"]) == ("\\boxed{1}", "better", 1)
    assert (got["2"]["initial_response"], got["2"]["sft_response"], got["2"]["iterations_needed"], got["2"]["last_correct_iteration"]) == ("s", "s", 2, None)


def test_unreadable_judgement_skips_its_question_alone(spark, tmp_path):
    from tessera.operators import coach

    met = '{"performance_evaluation": [{"objective_content": "o", "is_satisfied": true}]}'
    student = lambda: lambda asked, _: asked.map(lambda p: "a")
    teacher = lambda: lambda asked, _: asked.map(lambda p: "no JSON" if "q2" in p else met if "Objectives:" in p else "")
    got = {r["id"]: r for r in coach.coach(_questions(spark), student, teacher, "text", _saver(spark, tmp_path), objectives=[{"target": "t"}]).collect()}
    assert got["2"]["sft_case"] == "skipped" and "read" in got["2"]["skip_reason"] and got["2"]["sft_response"] is None
    assert {k: (got[k]["sft_case"][:6], got[k]["sft_response"]) for k in "13"} == {k: ("case_a", "a") for k in "13"}


def test_coaching_of_no_questions(spark, tmp_path):
    from tessera.operators import coach

    ask = lambda: lambda asked, _: asked
    assert coach.coach(_questions(spark).limit(0), ask, ask, "mcq", _saver(spark, tmp_path)).collect() == []


def test_rows_with_errors_or_without_prompts_are_not_asked(spark):
    from tessera.operators import loop

    rows = spark.createDataFrame([(1, "p", None), (2, None, None), (3, "p", "before")], "id int, prompt string, error string")
    got = {r["id"]: (r["response"], r["error"]) for r in loop.respond(rows, "prompt", lambda: lambda s: s + "!").collect()}
    assert got == {1: ("p!", None), 2: (None, None), 3: (None, "before")}


def test_templates_keep_braces_and_empty_nulls(spark):
    from pyspark.sql import functions as F
    from tessera.functions import prompts

    row = spark.range(1).select(prompts.fill("{{x}} {a}|{b}", a=F.lit(None).cast("string"), b="{y}").alias("t")).first()
    assert row["t"] == "{x} |{y}"


def test_a_model_is_made_once_in_a_process():
    from tessera.operators.calls import Once

    Once.clear()
    made = []
    factory = Once("test", lambda: made.append(1) or (lambda s: s))
    assert factory() is factory() and made == [1]
