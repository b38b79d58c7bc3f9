"""Problem 7: fill containers of fixed capacity by best-two-fit.

Rows are dealt by a hash of their key to shards of a bounded number of texts; each
shard is packed alone by its size histogram, so a bin costs steps in proportion to
its items, not to the shard. A shard leaves at most a few bins badly filled, which
is nothing against its thousands of bins.

Defined results: a text without tokens is in no container (null); a text above the
capacity fills whole containers and its rest is packed like a text; repeated keys and
null keys are packed once per row. The containers depend on keys and sizes only, not on
how the input is partitioned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import materialise, spread, table
from docmill.llm.tokenize import TOKENIZER, count_tokens

CAPACITY, SHARD = 2048, 25_000
#: Rows of equal key and size that are dealt to one shard together.
BLOCK = 64


def best_two_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin number of each item (sizes 1..capacity).

    Each bin takes the largest item that still fits, again and again; then its
    smallest item gives way to two unpacked items that together fill the widened gap
    better, as long as such a pair exists.
    """
    left = np.bincount(sizes, minlength=capacity + 1).tolist()
    there = sum(1 << k for k in range(1, capacity + 1) if left[k])  # bit k: an item of size k is unpacked
    up_to = [(2 << k) - 1 for k in range(capacity + 1)]

    def largest(limit: int) -> int:
        """The largest unpacked size up to limit, 0 if there is none."""
        return max((there & up_to[min(limit, capacity)]).bit_length() - 1, 0) if limit > 0 else 0

    def take(k: int) -> None:
        nonlocal there
        left[k] -= 1
        if not left[k]:
            there ^= 1 << k

    def put_back(k: int) -> None:
        nonlocal there
        left[k] += 1
        there |= 1 << k

    def pair(limit: int, least: int) -> tuple[int, int] | None:
        """Two unpacked sizes with the largest sum within least < sum <= limit."""
        best, found = least, None
        a = largest(limit - 1)
        while a and 2 * a > best:
            take(a)
            b = largest(min(a, limit - a))
            put_back(a)
            if b and a + b > best:
                best, found = a + b, (a, b)
                if best == limit:
                    break
            a = largest(a - 1)
        return found

    bins: list[list[int]] = []
    top = largest(capacity)
    while top:
        gap, own = capacity, []
        while gap and (k := largest(gap)):
            take(k)
            own.append(k)
            gap -= k
        while gap and own:
            small = own[-1]
            two = pair(gap + small, small)
            if two is None:
                break
            own.pop()
            for k in two:
                take(k)
            put_back(small)
            own = sorted([*own, *two], reverse=True)
            gap += small - sum(two)
        bins.append(own)
        top = largest(capacity)
    order = np.argsort(sizes, kind="stable")
    start = np.concatenate(([0], np.cumsum(np.bincount(sizes, minlength=capacity + 1)))).tolist()
    out = np.full(len(sizes), -1, np.int64)
    for number, own in enumerate(bins):
        for k in own:
            out[order[start[k]]] = number
            start[k] += 1
    if (out < 0).any():
        raise AssertionError("an item is in no container")
    return out


def pack(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, shard: int = SHARD, path: str = TOKENIZER) -> DataFrame:
    """(key, container, piece_no, token_start, n_tokens): one row per piece; containers are `shard-number`."""
    sizes = materialise(count_tokens(df, key, text, path), "p7")
    shards = max(1, -(-sizes.count() // shard))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "n_tokens"]).loc[lambda p: p.index.repeat(p["copies"])]  # in an order of its own
        size = pdf["n_tokens"].to_numpy(np.int64)
        rest = size % capacity
        bins = np.full(len(size), -1, np.int64)
        some = rest > 0
        bins[some] = best_two_fit(rest[some], capacity)
        n_bins = int(bins.max(initial=-1)) + 1
        name = str(pdf["shard"].iloc[0]) + "-"
        whole = np.repeat(np.arange(len(size)), size // capacity)
        number = np.arange(len(whole)) - np.repeat(np.cumsum(size // capacity) - size // capacity, size // capacity)
        last = np.flatnonzero(some | (size == 0))
        row = np.concatenate((whole, last))
        container = [f"{name}{n_bins + i}" for i in range(len(whole))] + [f"{name}{b}" if b >= 0 else None for b in bins[last]]
        piece = np.concatenate((number, size[last] // capacity))
        return pd.DataFrame(
            {
                key: pdf[key].to_numpy()[row],
                "container": container,
                "piece_no": piece.astype(np.int32),
                "token_start": piece * capacity,
                "n_tokens": np.concatenate((np.full(len(whole), capacity), rest[last])),
            }
        )

    # Rows of equal key and size differ in nothing that is returned: they are dealt by their number, in
    # blocks, so that the shards are the same however the input is partitioned, and no key fills a shard.
    c = F.col("copies")
    same = sizes.groupBy(key, "n_tokens").agg(F.count(F.lit(1)).alias("copies"))
    blocks = same.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((c - 1) / BLOCK).cast("int"))))
    blocks = blocks.withColumn("copies", F.least(F.lit(BLOCK), c - F.col("block") * BLOCK).cast("int"))
    dealt = blocks.withColumn("shard", F.pmod(F.xxhash64(key, "n_tokens", "block"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(run, f"{key} long, container string, piece_no int, token_start long, n_tokens long")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens and the share of the capacity that they use."""
    used = packed.filter("container IS NOT NULL")
    return used.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("n").alias("tokens"),
        F.max("n").alias("fullest"),
        (F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("fill"),
    )


def p7_containers(spark, sf_dir):
    return pack(spread(table(spark, sf_dir, "documents")), "doc_id", "text")


def p7_fill(spark, sf_dir):
    return fill(p7_containers(spark, sf_dir))
