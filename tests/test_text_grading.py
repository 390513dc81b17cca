"""Grader, split and normalisation cases (FIXTURES.md, grader table)."""

import pytest
from pyspark.sql import functions as F

from thinkframe import functions as tf
from thinkframe.functions import staged

MATH_CASES = [
    ("\\boxed{1} then \\boxed{2}", "2", True, "2"),
    ("\\boxed{1} then \\boxed{2", "1", False, None),
    ("\\boxed{x{y}z} c", "x{y}z", True, "x{y}z"),
    ("\\boxed{\\text{ab}}", "ab", True, "\\text{ab}"),
    ("\\boxed{3.0}", "3", True, "3.0"),
    ("\\boxed{1_000}", "1000", True, "1_000"),
    ("\\boxed{1d}", "1", False, "1d"),
    ("\\boxed{{a}{b}}", "{a}{b}", True, "{a}{b}"),
    ("no box", "1", False, None),
    ("\\boxed{ \\left( 1 \\right) .}", "(1)", True, " \\left( 1 \\right) ."),
    ("\\boxed{$5$}", "5", True, "$5$"),
    ("\\boxed{1e3}", "1000", True, "1e3"),
    ("\\boxed{inf}", "inf", True, "inf"),
    ("\\boxed{nan}", "NaN", False, "nan"),
]

LETTER_CASES = [
    ("\\boxed{(b)}", "B", True, "B"),
    ("It is C, not a", "A", True, "A"),
    ("no idea", "A", False, None),
    ("\\boxed{42} so D", "D", True, "D"),
    ("\\boxed{A or B}", "B", False, "A"),
]


def test_grade_math_cases(spark):
    df = spark.createDataFrame([(t, r) for t, r, _, _ in MATH_CASES], "t string, r string")
    col_rows = df.select(tf.grade_math(F.col("t"), F.col("r")).alias("g")).collect()
    staged_rows = staged.with_grade_math(df, "t", "r").select("is_correct", "extracted").collect()
    for (t, r, ok, ex), g, s in zip(MATH_CASES, col_rows, staged_rows):
        assert (g.g.is_correct, g.g.extracted) == (ok, ex), t
        assert (s.is_correct, s.extracted) == (ok, ex), t


def test_grade_letter_cases(spark):
    df = spark.createDataFrame([(t, r) for t, r, _, _ in LETTER_CASES], "t string, r string")
    col_rows = df.select(tf.grade_letter(F.col("t"), F.col("r")).alias("g")).collect()
    staged_rows = staged.with_grade_letter(df, "t", "r").select("is_correct", "extracted").collect()
    for (t, r, ok, ex), g, s in zip(LETTER_CASES, col_rows, staged_rows):
        assert (g.g.is_correct, g.g.extracted) == (ok, ex), t
        assert (s.is_correct, s.extracted) == (ok, ex), t


def test_grade_dispatch(spark):
    df = spark.createDataFrame([("gpqa_diamond", "\\boxed{C}", "C"), ("math500", "\\boxed{C}", "C"),
                                ("aime24", "\\boxed{7}", "7")], "b string, t string, r string")
    rows = df.select(tf.grade(F.col("b"), F.col("t"), F.col("r")).alias("g")).collect()
    assert [r.g.is_correct for r in rows] == [True, True, True]
    s = staged.with_grade(df, "b", "t", "r").select("is_correct", "extracted").collect()
    assert [(r.is_correct, r.extracted) for r in s] == [(True, "C"), (True, "C"), (True, "7")]


@pytest.mark.parametrize("prefix,text,thinking,answer", [
    ("<think>\n", "x</think>y", "x", "y"),
    ("", "<think>x", "", "<think>x"),
    ("", "<think>a</think>b</think>c", "a", "b</think>c"),
    ("", "pre <think> one </think> mid <think>two</think>", "one", "mid <think>two</think>"),
    ("", "　 plain answer  ", "", "plain answer"),
])
def test_split_think_answer(spark, prefix, text, thinking, answer):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(tf.split_think_answer(F.lit(prefix), F.col("t")).alias("s")).first().s
    assert (r.thinking, r.answer) == (thinking, answer)
    s = staged.with_split_think_answer(df, prefix, "t").first()
    assert (s.thinking, s.answer) == (thinking, answer)


def test_strip_matches_python(spark):
    samples = ["\t\xa0 a b  \n", "\x1c\x1dx\x85", "", "  ", "​z"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(tf.py_strip(F.col("s"))).collect()]
    assert got == [s.strip() for s in samples]


def test_whitespace_token_count(spark):
    samples = ["a b  c", "", "   ", "one\ttwo\nthree　four"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(tf.whitespace_token_count(F.col("s"))).collect()]
    assert got == [len(s.split()) for s in samples]


def test_python_float_guard(spark):
    vals = ["1.", ".5", "+1.5", "1e5", "1_000", "1__0", "_1", "1d", "0x1p3", " 3 ", "1e-3", "abc",
            "٣", "３.５", "१०", "1_٢"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(tf.python_float(F.col("s"))).collect()]

    def py(v):
        try:
            return float(v)
        except ValueError:
            return None
    assert got == [py(v) for v in vals]
