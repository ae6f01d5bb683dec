"""Symbolic equality, durable epochs, resumed runs, the data source and skewed samples."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import symbolic
from tessera.operators import coach, loop, sample, stats
from tessera.plans import registry
from tessera.sources import epochs, loader, records, sinks


@pytest.mark.parametrize(
    ("one", "two", "want"),
    [
        ("2(x+1)", "2x+2", True),
        ("x^2-1", "(x-1)(x+1)", True),
        ("sqrt(8)", "2sqrt(2)", True),
        ("1/sqrt(2)", "sqrt(2)/2", True),
        ("2^(3/2)", "sqrt(8)", True),
        ("sqrt(-4)", "2sqrt(-1)", True),
        ("sin(x)^2", "sin(x)*sin(x)", True),
        ("sin(x+x)", "sin(2x)", True),
        ("1/2x", "x/2", True),
        ("-x^2", "0-x*x", True),
        ("0.5", "1/2", True),
        ("9^9^9", "9^9^9", True),
        ("5!", "120", True),
        ("sqrt(2)", "-sqrt(2)", False),
        ("-x^2", "x^2", False),
        ("sin(x)", "cos(x)", False),
        ("(x+1)^50", "(1+x)^51", False),
        ("1/0", "1/0", False),
        ("1/(x-x)", "1/(x-x)", False),
        ("x=5", "5", False),
        ("\\frac{1}{2}", "1/2", False),
        ("(" * 80 + "x" + ")" * 80, "x", False),
        ("x" * 401, "x" * 401, False),
        ("", "", False),
    ],
)
def test_same_expression(one, two, want):
    assert symbolic.equal(one, two) is want


def test_random_polynomials_against_their_coefficients():
    rnd = random.Random(5)
    for _ in range(60):
        roots = [rnd.randint(-4, 4) for _ in range(rnd.randint(1, 4))]
        factored = "".join(f"(x-({r}))" for r in roots)
        poly = [1]
        for r in roots:
            poly = [a - r * b for a, b in zip([*poly, 0], [0, *poly])]
        top = len(poly) - 1
        plain = "+".join(f"({c})x^{top - i}" for i, c in enumerate(poly))
        assert symbolic.equal(factored, plain)
        assert not symbolic.equal(factored, plain + "+1")


def test_epochs_are_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(5).withColumn("id", F.col("id").cast("string"))
    assert epochs.commit(rows, path, 0, {"big": F.count_if(F.col("id") > "2")})
    never = rows.withColumn("id", F.raise_error(F.lit("computed")).cast("string"))
    assert not epochs.commit(never, path, 0)
    assert epochs.once(never, path, 0).count() == 5
    with pytest.raises(Exception, match="computed"):
        epochs.commit(never, path, 1)
    rows.write.parquet(f"{path}/epoch-1-lost")
    assert epochs.read(spark, path).count() == 5
    assert [(m["epoch"], m["counts"]["rows"], m["counts"]["big"]) for m in epochs.committed(spark, path)] == [(0, 5, 2)]
    assert epochs.vacuum(spark, path) >= 1 and epochs.read(spark, path).count() == 5
    assert epochs.read(spark, str(tmp_path / "none"), registry.RUN).count() == 0


def test_a_stopped_run_asks_no_committed_round_again(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def student(stop):
        def factory():
            def model(prompts, _):
                for p in prompts:
                    with open(asked / "all", "a") as f:
                        f.write(json.dumps([p]) + "\n")
                if stop and any("again" in p for p in prompts):
                    raise SystemExit("lost")
                return prompts.map(lambda p: "\\boxed{1}" if "again" in p else "\\boxed{0}")

            return model

        return factory

    teacher = lambda: lambda asked, _: asked.map(lambda p: "[Feedback]\nagain\n[Iteration Summary]\ns\n")
    q = spark.createDataFrame([(str(i), "", f"q{i}", "\\boxed{1}") for i in range(3)], "id string, instruction string, input string, output string").coalesce(1)
    path = str(tmp_path / "run")
    run = lambda stop: lambda left, save: coach.coach(left, student(stop), teacher, "numeric", save, max_iterations=2)
    with pytest.raises(Exception, match="lost"):
        coach.resumed(spark, q, path, run(True), f"{path}-sft")
    assert epochs.read(spark, path, registry.RUN).count() == 0 and not records.exists(spark, f"{path}-sft")
    before = (asked / "all").read_text().splitlines()
    assert coach.resumed(spark, q, path, run(False), f"{path}-sft") == "ran"
    after = (asked / "all").read_text().splitlines()[len(before) :]
    assert sum("again" not in x and "q" in x for x in before) == 3
    assert not any('["q' in x and "again" not in x for x in after)
    log = epochs.read(spark, path, registry.RUN)
    row = log.orderBy("id").first()
    assert (row["sft_case"], row["question_id"], row["is_correct"]) == (registry.CASE_B, "0", True)
    assert [(h["iteration"], h["role"]) for h in row["conversation_history"]] == [(1, "student"), (1, "teacher"), (2, "student"), (2, "teacher")]
    assert spark.read.json(f"{path}-sft").count() == 3
    assert stats.summed(epochs.committed(spark, path))["case_b"] == 3
    assert coach.resumed(spark, q, path, run(True)) == "ended"


def test_an_older_log_is_taken_in(spark, tmp_path):
    path = str(tmp_path / "old")
    sinks.append_lines(spark.createDataFrame([("a", registry.CASE_A)], "id string, sft_case string"), path + ".jsonl")
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    answer = lambda left, save: save(left.select("id", F.lit(registry.CASE_C).alias("sft_case")), 1)
    assert coach.resumed(spark, ids, path, answer) == "ran"
    assert sorted((r["id"], r["sft_case"]) for r in epochs.read(spark, path, registry.RUN).collect()) == [("a", registry.CASE_A), ("b", registry.CASE_C)]


def test_replaced_lines_keep_the_old_until_the_new_are_there(spark, tmp_path):
    path = str(tmp_path / "lines")
    sinks.replace_lines(spark.range(2), path)
    with pytest.raises(Exception, match="broken"):
        sinks.replace_lines(spark.range(3).select(F.raise_error(F.lit("broken")).cast("long").alias("id")), path)
    assert spark.read.json(path).count() == 2
    sinks.replace_lines(spark.range(4), path)
    assert spark.read.json(path).count() == 4


def test_the_data_source_reads_only_what_is_asked_and_aborts_whole(spark, tmp_path):
    loader.register(spark)
    path = str(tmp_path / "records")
    kind = "dataset string, id string, instruction string, input string, output string, metadata map<string,string>"
    rows = [(["a/b", "c", None][i % 3], str(i), None, "é\n", "o", {"k": "v"} if i % 2 else None) for i in range(12)]
    df = spark.createDataFrame(rows, kind).repartition(3)
    df.write.format(loader.NAME).mode("append").save(path)
    bad = df.withColumn("id", F.when(F.col("id") == "7", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        bad.write.format(loader.NAME).mode("append").save(path)
    held = spark.read.format(loader.NAME).load(path)
    assert sorted(map(repr, held.collect())) == sorted(map(repr, spark.createDataFrame([(r[0] or "", *r[1:]) for r in rows], kind).collect()))
    one = held.where("dataset = 'a/b'")
    assert {r["id"] for r in one.collect()} == {"0", "3", "6", "9"}
    assert one.rdd.getNumPartitions() < held.rdd.getNumPartitions()
    assert held.where("dataset in ('zz')").count() == 0
    df.limit(2).write.format(loader.NAME).mode("overwrite").save(path)
    assert spark.read.format(loader.NAME).load(path).count() == 2


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_a_large_file_is_read_in_parts_and_each_line_once(tmp_path, monkeypatch, size):
    monkeypatch.setattr(loader, "_SPLIT", size)
    (tmp_path / "dataset=a").mkdir()
    (tmp_path / "dataset=a" / "x.jsonl").write_text("\n".join(f'{{"id": "{"é" * (i % 5)}{i}"}}' + "\n" * (i % 3 == 0) for i in range(20)))
    kind = T.StructType([T.StructField("dataset", T.StringType()), T.StructField("id", T.StringType())])
    reader = loader.Reader(kind, {"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) == -(-(tmp_path / "dataset=a" / "x.jsonl").stat().st_size // size)
    assert [x for p in parts for b in reader.read(p) for x in b.column(1).to_pylist()] == [f"{'é' * (i % 5)}{i}" for i in range(20)]


@pytest.mark.parametrize("k", [3, 50])
def test_bottom_is_the_first_of_each_group(spark, k):
    rnd = random.Random(k)
    rows = [("hot" if i % 3 else "cold", rnd.random(), i) for i in range(900)]
    got = sample.bottom(spark.createDataFrame(rows, "g string, x double, id long").repartition(5), ["g"], [F.col("x"), F.col("id")], k, parts=7)
    want = {(g, r[2], i + 1) for g in ("hot", "cold") for i, r in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: x[1:])[:k])}
    assert {(r["g"], r["id"], r["__rank"]) for r in got.collect()} == want


def test_no_task_ranks_a_whole_stratum(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("p"), F.lit("x").alias("s"), F.lit(1).alias("n"))
    got = sample.stratified_sample(rows, 11, F.col("p"), F.col("s"), F.col("n")).groupBy("p").count().collect()
    assert {r["p"]: r["count"] for r in got} == {"cold": 6, "hot": 5}
    cut = sample.bottom(rows, ["p"], [F.col("id")], 5)
    assert "__part" in cut._jdf.queryExecution().executedPlan().toString()


def test_places_in_groups_of_text_ids(spark):
    rows = [(g, f"k{i:03d}", n) for g in ("a", None) for i in range(40) for n in [3 if i % 4 else None]]
    got = sample.places(spark.createDataFrame(rows, "g string, id string, n int").repartition(4), "n", "id", ("g",), "of").collect()
    low = lambda v: (v is not None, v)
    for g in ("a", None):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(40)) and {r["of"] for r in mine} == {40}
        assert [(r["n"], r["id"]) for r in mine] == sorted(((r["n"], r["id"]) for r in mine), key=lambda x: (low(x[0]), x[1]))


def test_satisfaction_of_rows(spark):
    rows = [("a", True), ("a", True), ("b", True), ("b", None), ("c", False), ("c", None)]
    got = spark.createDataFrame(rows, "k string, ok boolean").groupBy("k").agg(*loop.satisfaction(F.col("ok"))).collect()
    assert {(r["k"], r["all_satisfied"], r["n_unmet"]) for r in got} == {("a", True, 0), ("b", False, 0), ("c", False, 1)}


def test_rejected_lines_have_their_place(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": "a"}\n\n{"id": \n{"id": "b"}\nnope\n')
    held = records.checked(records.located_lines(spark, str(tmp_path)), registry.RESULT)
    assert sorted((r["line"], r["value"]) for r in records.rejected(held).collect()) == [(2, '{"id": '), (4, "nope")]
    assert sorted(r["id"] for r in records.accepted(held, registry.RESULT).collect()) == ["a", "b"]


def test_a_pair_of_expressions_is_computed_once(monkeypatch):
    read, first = symbolic.parsed, []
    monkeypatch.setattr(symbolic, "parsed", lambda text: first.append(text) or read(text))
    assert [symbolic.equal("7931(x+1)", "7931x+7931") for _ in range(50)] == [True] * 50
    assert len(first) == 2
