"""Registered queries on model calls: retries by kind of error, calls in flight, readings of JSON, shared models."""

from __future__ import annotations

import os
import threading
import time

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonfix import extract_object, strict_object
from ..operators import loop
from ..operators.calls import Calls, Once
from .catalogue import _t
from .round_trips import query


class _Stub:
    """Answers by the last digit of a prompt, and keeps count of calls, of those under way and of its own end."""

    def __init__(self) -> None:
        self.asked: dict[str, int] = {}
        self.under_way = self.most = 0
        self.lock = threading.Lock()

    def __call__(self, prompts: pd.Series) -> pd.Series:
        with self.lock:
            self.under_way += 1
            self.most = max(self.most, self.under_way)
            for p in prompts:
                self.asked[p] = self.asked.get(p, 0) + 1
        time.sleep(0.0005)
        with self.lock:
            self.under_way -= 1
        return prompts.map(self.answer)

    def answer(self, prompt: str) -> str:
        kind, n = int(prompt) % 4, self.asked[prompt]
        if kind == 1 and n == 1:
            raise RuntimeError("503 after 1")
        if kind == 2:
            raise ValueError(f"bad request after {n}")
        if kind == 3:
            raise RuntimeError(f"Internal Server Error after {n}")
        return f"{prompt}:{n}:{self.most <= 4}"


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey || ':1:true' WHEN 1 THEN c_custkey || ':2:true' END AS response,
CASE c_custkey % 4 WHEN 2 THEN 'bad request after 1' WHEN 3 THEN 'Internal Server Error after 3' END AS error FROM customer""")
def bounded_calls(spark: SparkSession, d: str) -> DataFrame:
    """Four calls in flight: a server's error is asked again, three times at most, a request's own error never."""
    rows = _t(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("prompt"))
    got = loop.respond(loop.spread(rows), "prompt", _Stub, calls=Calls(attempts=3, in_flight=4, size=1, rate=20000, burst=100))
    return got.select("c_custkey", F.regexp_replace("response", "True$", "true").alias("response"), "error")


_FORMS = ('{"a": %s}', '```json\n{"a": %s}\n```', '{"a": %s, "b": "\\d"}', "so: %s")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN CAST(c_custkey AS VARCHAR) END AS a, CAST(CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS INT) AS reader,
CASE c_custkey % 4 WHEN 3 THEN 'the response could not be read' END AS error FROM customer""")
def strict_readings(spark: SparkSession, d: str) -> DataFrame:
    """JSON as it stands, JSON that needs a fence or an escape mended, and text that is none: which reader read it."""
    model = lambda: lambda prompts: prompts.map(lambda p: _FORMS[int(p) % 4] % p)
    rows = _t(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("prompt"))
    got = loop.respond(loop.spread(rows), "prompt", model, attempts=2, read=(strict_object, extract_object), how="reader")
    return got.select("c_custkey", F.get_json_object("response", "$.a").alias("a"), "reader", "error")


def _counting():  # noqa: ANN202
    """A model that knows how many its process has made."""
    _counting.made = getattr(_counting, "made", 0) + 1
    mine = f"{os.getpid()}:{_counting.made}"
    return lambda prompts: prompts.map(lambda _: mine)


@query("SELECT l_returnflag, count(*) AS answers, true AS one_each FROM lineitem GROUP BY l_returnflag")
def shared_model(spark: SparkSession, d: str) -> DataFrame:
    """Every task asks for a student and a teacher of one name: as many models answer as processes ran tasks, no more."""
    name = f"shared-{time.time_ns()}"
    student, teacher = Once(name, _counting, "cpu"), Once(name, _counting, "cpu")
    rows = _t(spark, d, "lineitem").select("l_returnflag").repartition(16).withColumn("prompt", F.lit("p"))
    got = loop.respond(loop.respond(rows, "prompt", student, name="s"), "prompt", teacher, name="t")
    per = got.groupBy("l_returnflag", F.split("s", ":")[0].alias("process")).agg(F.count("*").alias("n"), F.count_distinct("s").alias("models"), F.bool_and(F.split("s", ":")[0] != F.split("t", ":")[0]).alias("apart"), F.bool_and(F.col("s") == F.col("t")).alias("same"))
    return per.groupBy("l_returnflag").agg(F.sum("n").alias("answers"), F.bool_and((F.col("models") == 1) & (F.col("same") | F.col("apart"))).alias("one_each"))
