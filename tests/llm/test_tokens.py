import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docmill.llm import packing as K
from docmill.llm import tokenize as T


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(T.TOKENIZER)
    t.encode_special_tokens = True
    return t


def ids(text):
    return np.frombuffer(T.load().encode(text), np.int32).tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["the", " the", "ing", "  ", " ", "\n", "0", "é", "中国", "==", "'s", "<|endoftext|>", "　"]), max_size=30).map("".join))
def test_equals_the_library(library, text):
    text = text.encode("utf-8", "replace").decode()
    assert ids(text) == library.encode(text, add_special_tokens=False).ids


def test_long_runs(library):
    for text in ("a" * 3000, "=" * 3000, " " * 500, "\n \n" * 300, "zß" * 2000, "漢" * 3000, "😀" * 500):
        assert ids(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_decoding_gives_the_text_back(text):
    text = text.encode("utf-8", "replace").decode()
    assert T.load().decode(ids(text)) == text


def plain_bpe(word, merges):
    """Merge the leftmost pair of least rank until none is left."""
    parts = [bytes([b]) for b in word]
    while True:
        ranked = [(merges[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
        if not ranked:
            return parts
        rank, _ = min(ranked)
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and merges.get((parts[i], parts[i + 1])) == rank:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def test_automaton_against_merging():
    rng = random.Random(3)
    for _ in range(60):
        vocab = {bytes([b]): i for i, b in enumerate(b"abc")}
        merges = []
        while len(merges) < 12:
            u, v = rng.choice(list(vocab)), rng.choice(list(vocab))
            if u + v not in vocab:
                vocab[u + v] = len(vocab)
                merges.append((u, v))
        a = T.Automaton(vocab, merges)
        names = {i: t for t, i in vocab.items()}
        ranks = {p: i for i, p in enumerate(merges)}
        for n in range(1, 8):
            for word in itertools.product(b"abc", repeat=n):
                word = bytes(word)
                assert [names[i] for i in a.encode_word(word)] == plain_bpe(word, ranks), (word, merges)


def test_frame(spark, library):
    texts = [None, "", "  ", "one text", "one text"]
    rows = T.encode_texts(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t").orderBy("k").collect()
    assert [r.ids for r in rows] == [[], []] + [library.encode(t).ids for t in texts[2:]]
    assert T.encode_texts(spark.createDataFrame([], "k long, t string"), "k", "t").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
def test_bins_hold(sizes):
    s = np.array(sizes)
    bins = K.best_two_fit(s, 64)
    used = np.bincount(bins, weights=s)
    assert used.max() <= 64 and (used > 0).all()
    # Never worse than twice the least possible number of bins.
    assert len(used) <= 2 * -(-s.sum() // 64)


@pytest.fixture(scope="module")
def real_sizes():
    import duckdb

    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()]
    sizes = np.array([len(ids(t)) for t in texts]) % K.CAPACITY
    return sizes[sizes > 0]


@pytest.mark.parametrize("n", [1000, 5000, 10_000])
def test_shards_of_real_sizes_hold_every_item(real_sizes, n):
    for seed in range(4):
        s = np.random.default_rng(seed).choice(real_sizes, n)
        bins = K.best_two_fit(s)
        used = np.bincount(bins, weights=s)
        assert bins.min() == 0 and len(bins) == n and used.max() <= K.CAPACITY and (used > 0).all()
        assert len(used) <= -(-s.sum() // K.CAPACITY) + 2


def plain_two_fit(sizes, capacity):
    """The same rule with plain lists."""
    rest, bins = sorted(sizes), []
    while rest:
        own = []
        while some := [k for k in rest if k <= capacity - sum(own)]:
            own.append(some[-1])
            rest.remove(some[-1])
        while sum(own) < capacity:
            room, small = capacity - sum(own) + own[-1], own[-1]
            pairs = [(a + b, a, b) for a, b in itertools.combinations(rest, 2) if small < a + b <= room]
            if not pairs:
                break
            _, a, b = max((t, max(a, b), min(a, b)) for t, a, b in pairs)
            own.pop()
            for k in (a, b):
                rest.remove(k)
            rest = sorted([*rest, small])
            own = sorted([*own, a, b], reverse=True)
        bins.append(own)
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=14))
def test_two_fit_against_plain_lists(sizes):
    s = np.array(sizes)
    bins = K.best_two_fit(s, 30)
    got = sorted(tuple(sorted(s[bins == b].tolist())) for b in range(bins.max() + 1))
    assert got == sorted(tuple(sorted(b)) for b in plain_two_fit(sizes, 30))


def test_containers_do_not_depend_on_the_partitioning(spark):
    rows = [(i % 40 if i % 3 else None, "word " * (i * 37 % 900)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, t string")
    a, b = (sorted(map(str, K.pack(df.repartition(n), "k", "t", shard=100).collect())) for n in (1, 5))
    assert a == b and len({r.split("container=")[1].split(",")[0] for r in a}) > 4


def test_two_fit_replaces_the_smallest():
    # Greedy fills 60 + 30, the smallest gives way to 22 + 18.
    s = np.array([60, 30, 22, 18])
    assert np.bincount(K.best_two_fit(s, 100), weights=s).max() == 100


def test_pack(spark):
    texts = ["word " * n for n in (10, 500, 3000, 2047, 1)] + [None, "", "word " * 10]
    df = spark.createDataFrame([(i % 6, t) for i, t in enumerate(texts)], "k long, t string")
    rows = K.pack(df, "k", "t", shard=3).collect()
    by = {}
    for r in rows:
        if r.container is None:
            assert r.n_tokens == 0
        else:
            by[r.container] = by.get(r.container, 0) + r.n_tokens
    assert max(by.values()) <= K.CAPACITY
    assert sum(by.values()) == sum(len(ids(t)) for t in texts if t)
    assert sum(r.container is None for r in rows) == 2
    assert K.pack(df.limit(0), "k", "t").count() == 0
