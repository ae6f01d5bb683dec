"""Every pattern and fallback of the extractors, and the comparisons."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import answers, markup

CASES = [
    ("mcq", "It is \\boxed{b}", "B"),
    ("mcq", "\\boxed{E} Answer: because", "B"),
    ("mcq", "The correct answer is C", "C"),
    ("mcq", "Final Answer: D", "D"),
    ("mcq", "x\nA. this", "A"),
    ("mcq", "clearly B is the correct one", "B"),
    ("mcq", "I choose (c)", "C"),
    ("mcq", "so\n  D.  \nend\n", "D"),
    ("mcq", "nothing", None),
    ("mcq", "", None),
    ("numeric", "a 1\n#### 25", "25"),
    ("numeric", "#### 1,234,567", "1234"),
    ("numeric", "\\boxed{\\frac{1}{8}}", "1"),
    ("numeric", "\\boxed{x}", "x"),
    ("numeric", "The answer is $-3.5$", "-3.5"),
    ("numeric", "y = 42 ", "42"),
    ("numeric", "answer **7**", "7"),
    ("numeric", "1 then 2 then 3.5 units", "3.5"),
    ("numeric", "12 but no answer", "12"),
    ("numeric", "none", None),
    ("latex", "\\boxed{\\frac{1}{2}}", "\\frac{1}{2}"),
    ("latex", "The Answer is: $x^2$.", "x^2"),
    ("latex", "value 9", "9"),
    ("boolean", "Answer: TRUE", "Yes"),
    ("boolean", "hm\nno. ", "No"),
    ("boolean", "correct but invalid", "Yes"),
    ("boolean", "***", None),
    ("text", "Answer: foo bar.\nmore", "foo bar"),
    ("text", "The answer is X", "is X"),
    ("text", "a\n\n last one \n", "last one"),
    ("text", "", None),
]


@pytest.mark.parametrize("kind", sorted({c[0] for c in CASES}))
def test_extract(spark, kind):
    rows = [(i, r, e) for i, (k, r, e) in enumerate(CASES) if k == kind]
    df = spark.createDataFrame(rows, "i int, r string, e string")
    got = df.select("r", "e", answers.extract(kind, F.col("r")).alias("g"), answers.extract_by(F.lit(kind), F.col("r")).alias("h")).collect()
    for row in got:
        assert row["g"] == row["e"], row
        assert row["h"] == row["e"], row


GRADES = [
    ("mcq", "a ", "The answer is \\boxed{A}", True),
    ("mcq", None, "A", False),
    ("numeric", "1,000", "1000.0000001", True),
    ("numeric", "5", "6", False),
    ("numeric", "5", "The answer is \\boxed{5}", True),
    ("numeric", "nan", "nan", True),
    ("latex", "\\dfrac{1}{2}", "1/2", True),
    ("latex", "\\text{x y}", "xy", True),
    ("latex", "2", "3", False),
    ("boolean", "TRUE", "yes", True),
    ("boolean", "no", "yes", False),
    ("text", "Hello, World", "hello world!", True),
    ("text", "a", None, False),
]


@pytest.mark.parametrize("kind", sorted({c[0] for c in GRADES}))
def test_grade(spark, kind):
    rows = [(p, t, e) for k, p, t, e in GRADES if k == kind]
    df = spark.createDataFrame(rows, "p string, t string, e boolean")
    for row in df.select("*", answers.grade(kind, F.col("p"), F.col("t")).alias("g")).collect():
        assert row["g"] == row["e"], row


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("\\boxed{a{b}c} x", "a{b}c"),
        ("\\boxed{1} \\boxed{2}", "2"),
        ("\\boxed{open", None),
        ("\\fbox{3}", "3"),
        ("\\boxed{}", ""),
        ("}\\boxed} {4}", None),
        (None, None),
        ("", None),
    ],
)
def test_boxed(text, want):
    assert markup.boxed_of(text) == want


def test_ground_truth_and_choices(spark):
    df = spark.createDataFrame([("why\n#### 7 \n", "Q\nA. x\nB) y z\nC: no"), ("a\n last ", "A. only")], "o string, q string")
    got = df.select(answers.ground_truth(F.col("o")).alias("t"), answers.choices(F.col("q")).alias("c")).collect()
    assert [(r["t"], r["c"]) for r in got] == [("7", ["x", "y z"]), ("last", None)]
