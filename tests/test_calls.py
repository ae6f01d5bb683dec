"""Model calls: in flight, in order, by kind of error, at a rate; models kept by process."""

import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.jsonfix import extract_object, strict_object
from tessera.operators.calls import Asker, Bucket, Calls, Once, transient


def asked(n):
    return pd.DataFrame({"p": [str(i) for i in range(n)]}, dtype=object)


class Status(Exception):
    def __init__(self, code):
        super().__init__("failed")
        self.status_code = code


@pytest.mark.parametrize(
    ("error", "want"),
    [(Status(500), True), (Status(529), True), (Status(429), False), (Status(404), False), (TimeoutError(), True), (ConnectionResetError(), True), (ValueError("HTTP 502"), True), (ValueError("no"), False)],
)
def test_kinds_of_error(error, want):
    assert transient(error) is want


def test_calls_overlap_within_their_bound_and_keep_their_order():
    lock, under_way, most = threading.Lock(), [0], [0]

    def model(prompts):
        with lock:
            under_way[0] += 1
            most[0] = max(most[0], under_way[0])
        time.sleep(0.02 if int(prompts.iloc[0]) % 2 else 0.002)
        with lock:
            under_way[0] -= 1
        return "r" + prompts

    with Asker(model, Calls(in_flight=3, size=2)) as asker:
        got = asker.ask(asked(25))
    assert [x[0] for x in got] == [f"r{i}" for i in range(25)]
    assert 1 < most[0] <= 3


@pytest.mark.parametrize(("size", "in_flight"), [(1, 1), (1, 4), (5, 2), (None, 1), (None, 3)])
def test_only_errors_of_the_server_are_asked_again(size, in_flight):
    calls = {}

    def model(prompts):
        for p in prompts:
            calls[p] = calls.get(p, 0) + 1
        if "2" in set(prompts):
            raise Status(400)
        if "3" in set(prompts):
            raise Status(503)
        return prompts

    with Asker(model, Calls(attempts=3, in_flight=in_flight, size=size)) as asker:
        got = asker.ask(asked(5))
    assert [x[0] for x in got] == ["0", "1", None, None, "4"]
    together = 0 if size == 1 else 1
    assert calls["3"] - calls["2"] == 2 and calls["2"] == 1 + together


def test_too_few_responses_fail_and_are_asked_alone():
    with Asker(lambda prompts: prompts.iloc[:1], Calls()) as asker:
        assert [x[0] for x in asker.ask(asked(3))] == ["0", "1", "2"]


def test_what_no_reader_reads_is_asked_again_as_often_as_said():
    seen = []

    def model(prompts):
        seen.extend(prompts)
        return prompts.map(lambda p: '{"a": 1}' if p == "0" else "```{}```" if p == "1" else "none")

    with Asker(model, Calls(attempts=3), (strict_object, extract_object)) as asker:
        got = asker.ask(asked(3))
    assert got[:2] == [('{"a": 1}', 0, None), ("{}", 1, None)]
    assert got[2][0] is None and "read" in got[2][2]
    assert [seen.count(x) for x in "012"] == [1, 1, 3]


def test_bucket_lets_a_burst_through_and_then_its_rate():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = Bucket(10, 3, lambda: now[0], sleep)
    for _ in range(6):
        bucket.take()
    assert slept == pytest.approx([0.1, 0.1, 0.1])
    now[0] += 100
    for _ in range(3):
        bucket.take()
    assert len(slept) == 3


def test_shared_rates_add_up_and_senseless_rules_are_refused():
    assert Calls(rate=12).shared(4).rate == 3
    for wrong in ({"attempts": 0}, {"in_flight": 0}, {"size": 0}, {"rate": -1}, {"backoff": -1}):
        with pytest.raises(ValueError):
            Calls(**wrong)


def test_no_questions():
    with Asker(lambda prompts: prompts, Calls(in_flight=2)) as asker:
        assert asker.ask(asked(0)) == []


@pytest.mark.parametrize(("text", "want"), [('{"a": 1}', '{"a": 1}'), (' {"a":1} ', '{"a": 1}'), ("[1]", None), ("3", None), ('{"a": 1} so', None), ("", None), (None, None)])
def test_strict_reading(text, want):
    assert strict_object(text) == want


def test_models_by_name_and_device_the_oldest_ends_first():
    Once.clear()
    ended = []

    class Model:
        def __init__(self, name):
            self.name = name

        def close(self):
            ended.append(self.name)

    get = lambda name, device="": Once(name, lambda: Model(name + device), device)()
    a = get("a")
    assert get("a") is a and get("a", "gpu") is not a
    assert get("a") is a
    get("b")
    assert ended == ["agpu"]
    Once.clear()
    assert sorted(ended) == ["a", "agpu", "b"]


def test_questions_of_one_file_are_asked_by_many_tasks(spark, tmp_path):
    spark.range(40).coalesce(1).select(F.col("id").cast("string").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    from tessera.plans import calling

    got = calling.bounded_calls(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert got.count() == 40


def test_a_round_is_dealt_out_and_sent_in_small_batches(spark):
    from tessera.operators import coach

    model = lambda: lambda prompts, _: prompts.map(lambda _: f"\\boxed{{1}} {len(prompts)}")
    rows = spark.range(3000).coalesce(1).select("id", F.lit("").alias("instruction"), F.lit("q").alias("input"), F.lit("\\boxed{1}").alias("output"))
    tasks, sizes, held = [], set(), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def save(got, _):
        tasks.append(got.rdd.getNumPartitions())
        sizes.add(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return spark.createDataFrame(got.limit(0).collect(), got.schema)

    coach.coach(rows, model, model, "numeric", save, max_iterations=1)
    assert tasks[0] >= spark.sparkContext.defaultParallelism and sizes == {"1000"}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == held
