"""Structural recall against a plain reading, for answers of any length."""

from tests.test_ranking import shuffled
from tracewood.operators import quality


def test_expectations_are_looked_up_in_blocks(spark):
    answers = {"a": "callers\nx#one\nx#two\n\ncallees of it\ny#three", "b": None, "d": "callees of it\nz#é\n\nx#two", "e": ""}
    expected = [
        ("a", "x#one"), ("a", "x#one"), ("a", "x#on"), ("a", "gone"), ("a", ""), ("a", "in: callers x#two"), ("a", "in: callers y#three"), ("a", "in: callees_of_it y#three"), ("a", "in: callees_of_it "), ("a", "in: no x#one"), ("a", "in:  x"), ("a", None),
        ("b", "x"), ("b", ""), ("c", "x"), ("d", "in: callees_of_it z#é"), ("d", "in: callees_of_it x#two"), ("e", None), (None, "x"), (None, ""),
    ]
    got = quality.structural_recall(spark.createDataFrame(list(answers.items()), "question string, answer string"), spark.createDataFrame(expected, "question string, expected string"), block=2).collect()
    assert {r["question"]: tuple(r)[1:] for r in got} == {"a": (12, 6, 3, 10), "b": (2, 1, 0, 0), "c": (1, 0, 0, 0), "d": (2, 1, 2, 6), "e": (1, None, 0, 0), None: (2, 1, 0, 0)}


def test_a_long_answer_is_not_repeated_for_each_expectation(spark):
    names = [f"d/f{k}.py#name{k}" for k in range(20_000)]
    answers = spark.createDataFrame([("q", "\n".join(names))], "question string, answer string")
    expected = spark.createDataFrame([("q", n + "x" * (k % 2)) for k, n in enumerate(names)], "question string, expected string")
    rows = []
    moved = shuffled(spark, lambda: rows.extend(quality.structural_recall(answers, expected).collect()))
    assert tuple(rows[0])[1:4] == (20_000, 10_000, 20_000) and moved < 100_000
