import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm import splitting as S

PARTS = st.sampled_from(["a", "bb", " ", "\n", "\n \n", "\r\n\r\n", "\f", ". ", "? ", "。", "ccc"])


@settings(max_examples=200, deadline=None)
@given(st.lists(PARTS, max_size=60).map("".join), st.integers(6, 25))
def test_pieces(text, limit):
    overlap = limit // 4
    level, parts = S.split(text, limit, overlap)
    assert all(0 < e - s <= limit for s, e in parts)
    if len(text) <= limit:
        assert level is None and parts == ([(0, len(text))] if text else [])
        return
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for (_, end), (start, _) in zip(parts, parts[1:]):
        assert start == max(0, end - overlap)
    rebuilt = text[: parts[0][1]] + "".join(text[a[1] : b[1]] for a, b in zip(parts, parts[1:]))
    assert rebuilt == text
    assert level == plain_level(text, limit)


def plain_level(text, limit):
    """The definition, by splitting again and again."""
    cuts = ["\f", r"(?:\r\n|[\n\r])[^\S\n\r\f]*(?:\r\n|[\n\r])", r"\r\n|[\n\r]", r"[.!?](?=\s)|[。！？]", r"\s"]
    at = {0, len(text)}
    for name, cut in zip(("page", "paragraph", "line", "sentence", "word"), cuts):
        for i in range(len(text)):
            m = re.compile(cut).match(text, i)
            if m and not (text[i] == "\n" and i and text[i - 1] == "\r"):
                at.add(m.end())
        order = sorted(at)
        if max(b - a for a, b in itertools.pairwise(order)) <= limit:
            return name
    return "char"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 39), unique=True, max_size=9).map(sorted), st.lists(st.floats(0, 5), min_size=9, max_size=9))
def test_best_cuts_is_optimal(at, costs):
    n, limit, overlap = 40, 18, 4
    cost = np.array(costs[: len(at)])
    got = S.best_cuts(n, np.array(at, int), cost, limit, overlap)
    pieces = max(2, -(-(n - overlap) // (limit - overlap)))
    target = (n - overlap) / pieces

    def price(cuts):
        total = 0.0
        for a, b in itertools.pairwise([0, *cuts, n]):
            if b - max(0, a - overlap if a else 0) > limit:
                return np.inf
            total += ((b - a - target) / limit) ** 2
        return total + sum(cost[at.index(c)] for c in cuts)

    best = min(price(c) for k in range(len(at) + 1) for c in itertools.combinations(at, k))
    assert (got is None) == (best == np.inf)
    if got is not None:
        assert abs(price(got) - best) < 1e-9


def test_frame(spark):
    rows = [(1, None), (2, ""), (3, "x" * 6000), (4, "é" * 6001), (5, ("word " * 700 + "\n\n") * 3), (5, "a\f" * 4000)]
    df = spark.createDataFrame(rows, "k long, t string")
    got = S.split_texts(df, "k", "t").orderBy("k", "level", "piece_no").collect()
    assert {(r.k, r.level) for r in got} == {(4, "char"), (5, "paragraph"), (5, "page")}
    assert all(len(r.piece) <= 6000 and r.end - r.start == len(r.piece) for r in got)
    assert S.split_texts(df.limit(0), "k", "t").count() == 0


def test_level_of_the_programme_is_the_first_sufficient_one():
    import random

    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["ab", "cde. ", "x\n", "\n\n", "\f", " ", "longword" * rng.randrange(1, 8), "! "]) for _ in range(rng.randrange(5, 80)))
        limit = rng.choice([12, 30, 60])
        level, parts = S.split(text, limit, rng.choice([0, 3, 6]))
        if len(text) > limit:
            assert level == S.boundaries(text, limit)[0] and all(e - s <= limit for s, e in parts)
