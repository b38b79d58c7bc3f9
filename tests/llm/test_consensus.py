import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import consensus as C

NOTATIONS = [
    ("75", 75), (" 42 ", 42), ("013", 13), ("Y2: 52", 52), ("95/100", 95), ("62.0", 62), ('"73"', 73), ("11 out of 100", 11), ("98%", 98),
    ("150", None), ("-5", None), ("unclear", None), ("API failed", None), (" ", None), (None, None), ("3/5", None), ("12 13", None),
]


@pytest.mark.parametrize("text,value", NOTATIONS)
def test_number(spark, text, value):
    df = spark.createDataFrame([(text,)], "y2 string")
    assert df.select(C.number(F.col("y2"), 0, 100)).first()[0] == value


def test_words_and_fifths(spark):
    rows = ["Three", " five", "4 of 5", "2/5", "Y4: 1", "0", "6", "3/100", "n/a"]
    df = spark.createDataFrame([(r,) for r in rows], "y4 string")
    assert [r[0] for r in df.select(C.number(F.col("y4"), 1, 5)).collect()] == [3, 5, 4, 2, 1, None, None, None, None]


def answers(seed=1, n=400):
    """True labels and answers of two good answerers, a coin, and one that turns the scale round."""
    rng = np.random.default_rng(seed)
    truth = rng.integers(1, 6, n)
    rows = []
    for i, t in enumerate(truth):
        said = {
            "good": t if rng.random() < 0.9 else rng.integers(1, 6),
            "fair": t if rng.random() < 0.8 else rng.integers(1, 6),
            "coin": rng.integers(1, 6),
            "turned": 6 - t if rng.random() < 0.9 else rng.integers(1, 6),
        }
        if i >= 30:
            said["rare"] = None  # answers only thirty items
        else:
            said["rare"] = t
        rows += [(f"i{i}", a, None, str(v), i) for a, v in said.items() if v is not None]
    return truth, rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, llm string, y2 string, y4 string, at int").withColumn("answered_at", F.timestamp_seconds("at"))


def test_model_beats_the_majority(spark):
    truth, rows = answers()
    items, models, _ = C.run(frame(spark, rows))
    got = {r.id: r for r in C.consensus(items, models).collect() if r.field == "y4"}
    right = np.mean([got[f"i{i}"].label == t for i, t in enumerate(truth)])
    said = {}
    for i, _, _, v, _ in rows:
        said.setdefault(i, []).append(int(v))
    votes = np.mean([np.bincount(said[f"i{i}"]).argmax() == t for i, t in enumerate(truth)])
    assert right > 0.93 and right > votes + 0.05
    assert all(0 <= r.confidence <= 1 and 0 <= r.agreement <= 1 for r in got.values())


def test_latest_and_missing(spark):
    rows = [
        ("a", "x", "10", "1", 1), ("a", "x", "90", "API failed", 2), ("a", "x", "90", "API failed", 2), ("a", "y", "20", None, None),
        (None, "x", "1", "1", 1), ("b", None, "1", "1", 1), ("c", "x", " ", "9", 1),
    ]
    items, models, names = C.run(frame(spark, rows))
    got = {(r.id, r.field): r.n_answers for r in C.consensus(items, models).collect()}
    assert got == {("a", "y2"): 2} and names == ["x", "y"]
    items, models, _ = C.run(frame(spark, rows).limit(0))
    assert C.consensus(items, models).count() == 0


def test_reliability_is_near_the_planted_one(spark):
    truth, rows = answers(n=1500)
    _, models, names = C.run(frame(spark, rows))
    said = {(a, i): int(v) for i, a, _, v, _ in rows}
    for name, field, n, right, *_ in C.reliability(models, names):
        if field == "y4":
            own = [said[name, f"i{i}"] == t for i, t in enumerate(truth) if (name, f"i{i}") in said]
            # An answerer with few labels leans on its type.
            assert abs(right - np.mean(own)) <= (0.08 if len(own) > 100 else 0.25), (name, right, np.mean(own))
            assert abs(n - len(own)) < 1
