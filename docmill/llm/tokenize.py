"""Problem 6: token ids of a byte-level BPE by a tokenization automaton.

The automaton reads tokens. Its states are the start and one state per token ("the
last arc read was t"), because every gadget below sends all arcs of a label to one
state. Merges are compiled in rank order; the gadget of `u v -> w` cuts the v-arc
out of u's state and adds a w-arc wherever a u-arc is, leading to a state with the
arcs that v's state has at that time. A path is a correct tokenization exactly if
the automaton has it. The rows are kept as tables that share their past: per token
the merge's rank and the tokens whose outgoing and incoming arcs it took over, and
per cut arc the rank of the cut.

A pre-split word is encoded from left to right: each byte position has exactly one
state, found among the tokens that end there by the table of transitions, which is filled
from the tables above where a word first needs it; the ids are the arc
labels on the way back. Decoding emits the labels of the arcs, the tokens' bytes. Words and the space-separated pieces of a text are cached,
so a repeated piece is a dictionary lookup.

Defined results: null and empty texts have an empty list, blank texts are encoded,
special-token strings are ordinary text, repeated rows are encoded again.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import spread, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pre-splitting pattern of byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Cached pieces; beyond it a cache starts anew. It bounds memory, not results.
CACHE = 400_000
_START, _NEVER = -1, 1 << 30


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next code from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The compiled tables and the encoder over them."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.ids = dict(vocab)
        size = max(vocab.values()) + 1
        self.born = [-1] * size
        self.row = [_START] * size
        self.column = [_START] * size
        self.cut: dict[int, int] = {}
        self.size = size
        for rank, (u, v) in enumerate(merges):
            if u not in self.ids or v not in self.ids or not self.arc(vocab[u], vocab[v]):
                # No path has these arcs in a row, so no text ever leads to the merged token.
                self.ids.pop(u + v, None)
                continue
            self._gadget(rank, vocab[u], vocab[v], vocab[u + v])
        self.steps: dict[int, bool] = {}
        self.suffixes = {t[i:] for t in self.ids for i in range(len(t))}
        self._word: dict[str, bytes] = {}
        self._piece: dict[str, bytes | None] = {}
        self._first: dict[str, bytes] = {}
        self._split = regex.compile(PATTERN).findall

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        self.cut[u * self.size + v] = rank
        self.born[w], self.row[w], self.column[w] = rank, v, u

    def arc(self, s: int, t: int) -> bool:
        """Whether state s has a t-arc once all merges are compiled."""
        if s == _START:
            return True
        # Followed back to the time at which the younger of both took over its arcs.
        row, column, born, cut, size = self.row, self.column, self.born, self.cut, self.size
        before = _NEVER
        while True:
            if cut.get(s * size + t, _NEVER) < before:
                return False
            if born[s] < 0 and born[t] < 0:
                return True
            if born[s] > born[t]:
                before, s = born[s], row[s]
            elif born[s] < born[t]:
                before, t = born[t] + 1, column[t]
            else:
                # The same token twice: its incoming arcs were added last, then its own row.
                before, t = born[t] + 1, column[t]

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-split word."""
        known = self.ids.get(word)
        n = len(word)
        if known is not None and n < 3:
            return [known]
        state = [_START] * (n + 1)
        ids, suffixes, steps, size = self.ids, self.suffixes, self.steps, self.size
        if len(steps) > 4 * CACHE:
            steps.clear()
        for i in range(1, n + 1):
            k = i - 1
            while k >= 0 and (tail := word[k:i]) in suffixes:
                t = ids.get(tail)
                if t is not None:
                    step = state[k] * size + t
                    go = steps.get(step)
                    if go is None:
                        go = steps[step] = self.arc(state[k], t)
                    if go:
                        state[i] = t
                        break
                k -= 1
            else:
                raise ValueError("the vocabulary lacks a byte")
        out, i = [], n
        length = self.length
        while i:
            out.append(state[i])
            i -= length(state[i])
        return out[::-1]

    @property
    def length(self):
        if not hasattr(self, "_length"):
            by_id = [0] * self.size
            for t, i in self.ids.items():
                by_id[i] = len(t)
            self._length = by_id.__getitem__
        return self._length

    def _words(self, text: str) -> bytes:
        cache, parts = self._word, []
        for w in self._split(text):
            got = cache.get(w)
            if got is None:
                if len(cache) >= CACHE:
                    cache.clear()
                got = cache[w] = np.array(self.encode_word(w.encode("utf-8", "replace")), np.int32).tobytes()
            parts.append(got)
        return b"".join(parts)

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of a space and the chunk, or None where white space at its edge ties it to its neighbours."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        return self._words(" " + chunk)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers.

        The pattern always splits before a space that stands between two other
        characters, so such pieces are encoded by themselves; pieces with white
        space at an edge are joined with their neighbours first.
        """
        if not text:
            return b""
        chunks = text.split(" ")
        cache, parts = self._piece, []
        first = chunks[0]
        tied = not first or first[-1].isspace()
        if not tied:
            for c in chunks[1:]:
                try:
                    got = cache[c]
                except KeyError:
                    if len(cache) >= CACHE:
                        cache.clear()
                    got = cache[c] = self._chunk(c)
                if got is None:
                    tied = True
                    break
                parts.append(got)
        if not tied:
            return self._words(first) + b"".join(parts)
        out, run = [], [first]
        for c in chunks[1:]:
            last = run[-1]
            if not last or last[-1].isspace() or not c or c[0].isspace():
                run.append(c)
                continue
            out.append(self._join(run, not out))
            run = [c]
        out.append(self._join(run, not out))
        return b"".join(out)

    def _join(self, run: list[str], first: bool) -> bytes:
        if len(run) == 1 and not first:
            got = self._piece.get(run[0])
            if got is not None:
                return got
        return self._words(("" if first else " ") + " ".join(run))


    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: the labels of their arcs; bytes that are no text become the replacement character."""
        if not hasattr(self, "_labels"):
            self._labels = {i: t for t, i in self.ids.items()}
        return b"".join(map(self._labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str = TOKENIZER) -> Automaton:
    """Compile the automaton of a byte-level BPE file; once per worker process."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    symbols = byte_symbols()
    raw = lambda s: bytes(symbols[c] for c in s)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = [(raw(a), raw(b)) for a, b in pairs]
    made = {a + b for a, b in merges}
    vocab = {raw(t): i for t, i in model["vocab"].items() if all(c in symbols for c in t)}
    # A whole word that no merge makes (a special token's text) is no arc label.
    return Automaton({t: i for t, i in vocab.items() if len(t) == 1 or t in made}, merges)


def encode_texts(df: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(key, ids) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(path).encode
        for batch in batches:
            parts = [encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
            flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"{key} long, ids array<int>")


def decode_texts(df: DataFrame, key: str, ids: str = "ids", path: str = TOKENIZER) -> DataFrame:
    """(key, text) of each row; null and empty lists give an empty text, an unknown id fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = load(path).decode
        for batch in batches:
            texts = [decode(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"{key} long, text string")


def count_tokens(df: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens) of each row; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(path).encode
        for batch in batches:
            sizes = [len(encode(t)) // 4 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], [key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"{key} long, n_tokens long")


def p6_ids(spark, sf_dir):
    return encode_texts(spread(table(spark, sf_dir, "documents")), "doc_id", "text")


def p6_decoded(spark, sf_dir):
    """Every text encoded and decoded again."""
    texts = decode_texts(p6_ids(spark, sf_dir), "doc_id")
    return texts.select("doc_id", F.md5("text").alias("text_md5"), F.char_length("text").cast("long").alias("n"))


SQL = {"p6_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM documents"}
