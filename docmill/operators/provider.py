"""External model calls: one Arrow stage, called once per row and action.

A stage is a `mapInArrow`, so the optimiser neither repeats nor reorders its calls;
write its result (`session.materialise`) before a second action. Pass-through
columns travel as Arrow arrays and keep their types.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class ModelProvider(Protocol):
    """Answers a prompt with raw text or raises."""

    def complete(self, prompt: str, question: str, row: Mapping[str, Any]) -> str: ...


@dataclass(frozen=True)
class ReplayProvider:
    """Answers from a column of the row: text, or a map from question to text; null is a failed call.

    With `of`, the column maps each model to such a value.
    """

    column: str = "replay"
    of: str | None = None

    def complete(self, prompt: str, question: str, row: Mapping[str, Any]) -> str:
        got = row[self.column]
        if got is not None and self.of is not None:
            got = dict(got).get(self.of)
        if got is not None and not isinstance(got, str):
            got = dict(got).get(question)
        if got is None:
            raise LookupError("no replayed reply")
        return got


class TriesProvider:
    """Answers a row's first call from the first of some columns, its second from the next; null is a failed call."""

    def __init__(self, columns: tuple[str, ...], key: str = "row_ordinal") -> None:
        self.columns, self.key = columns, key
        self.calls: dict[Any, int] = {}

    def complete(self, prompt: str, question: str, row: Mapping[str, Any]) -> str:
        k = self.calls[row[self.key]] = self.calls.get(row[self.key], -1) + 1
        got = row[self.columns[min(k, len(self.columns) - 1)]]
        if got is None:
            raise LookupError("no replayed reply")
        return got


def _post(url: str, body: Mapping[str, Any], headers: Mapping[str, str], timeout: float) -> Any:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as got:
        return json.load(got)


def _key(setting: str) -> str:
    from docmill.config import Config

    return Config().require(setting)[setting]


@dataclass(frozen=True)
class HttpProvider:
    """A chat-completions endpoint; the key is read on the executor."""

    endpoint: str
    model: str
    key_setting: str
    max_tokens: int = 3000
    temperature: float | None = 0
    timeout: float = 60

    def complete(self, prompt: str, question: str, row: Mapping[str, Any]) -> str:
        body: dict[str, Any] = {"model": self.model, "max_tokens": self.max_tokens, "messages": [{"role": "user", "content": prompt}]}
        if self.temperature is not None:
            body["temperature"] = self.temperature
        got = _post(self.endpoint, body, {"Authorization": "Bearer " + _key(self.key_setting)}, self.timeout)
        return got["choices"][0]["message"]["content"]


@dataclass(frozen=True)
class GenerateProvider:
    """A generate-content endpoint with a thinking level and no temperature; thoughts are left out of the reply."""

    endpoint: str
    model: str
    key_setting: str
    max_tokens: int = 3000
    thinking: str | None = "high"
    timeout: float = 60

    def complete(self, prompt: str, question: str, row: Mapping[str, Any]) -> str:
        settings: dict[str, Any] = {"maxOutputTokens": self.max_tokens}
        if self.thinking:
            settings["thinkingConfig"] = {"thinkingLevel": self.thinking}
        body = {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": settings}
        got = _post(f"{self.endpoint}/models/{self.model}:generateContent", body, {"x-goog-api-key": _key(self.key_setting)}, self.timeout)
        return "".join(p["text"] for p in got["candidates"][0]["content"]["parts"] if "text" in p and not p.get("thought"))


@dataclass(frozen=True)
class CallPolicy:
    """Tries per call, seconds between them (2, 4, 8, ...), least seconds after each of a thread's calls, and how many run at once.

    `threads` calls of a task run at the same time. `at_once` bounds the calls of all
    tasks together, so that at most `at_once / pause` start in a second.
    """

    tries: int = 1
    base: float = 2.0
    pause: float = 0.0
    sleep: Callable[[float], None] = time.sleep
    threads: int = 1
    at_once: int | None = None

    def waits(self) -> list[float]:
        return [self.base**k for k in range(1, self.tries)]

    def ask(
        self, provider: ModelProvider, prompt: str, question: str, row: Mapping[str, Any],
        read: Callable[[str | None], tuple[str, Any]], again: Callable[[str], bool],
    ) -> tuple[str, Any]:
        """What `read` makes of the reply: (status, value). A failed call and a status for which `again` holds are tried again."""
        waits = self.waits()
        for k in range(self.tries):
            try:
                got = read(provider.complete(prompt, question, row))
            except Exception:  # any failure of a provider is a failed call
                got = read(None)
                failed = True
            else:
                failed = again(got[0])
            if not failed:
                break
            if k < len(waits):
                self.sleep(waits[k])
        if self.pause:
            self.sleep(self.pause)
        return got

    def call(self, provider: ModelProvider, prompt: str, question: str, row: Mapping[str, Any]) -> str | None:
        """The reply, or None when every try failed."""
        return self.ask(provider, prompt, question, row, lambda raw: ("", raw), lambda status: False)[1]


#: Rows that a stage hands on together: a task holds no more results back.
ROWS = 64


def row_stage(
    df: DataFrame,
    added: T.StructType,
    fn: Callable[[Mapping[str, Any]], Mapping[str, Any]],
    needs: Iterable[str],
    drop: Iterable[str] = (),
    threads: int = 1,
    at_once: int | None = None,
) -> DataFrame:
    """Apply fn to each row's `needs` columns and append its values; columns of the same name are overwritten.

    A task works on `threads` rows at the same time. With `at_once`, rows are dealt to as
    few tasks as keep all tasks together within that number.
    """
    needs, gone = list(needs), {*drop, *added.names}
    kept = [f for f in df.schema.fields if f.name not in gone]
    schema = T.StructType([*kept, *added.fields])
    names = [f.name for f in kept]
    if at_once is not None:
        threads = max(1, min(threads, at_once))
        df = df.repartition(max(1, at_once // threads))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in added.fields]
        with ThreadPoolExecutor(threads) if threads > 1 else nullcontext() as pool:
            each = pool.map if pool else map
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    inputs = {n: batch.column(n).to_pylist() for n in needs}
                    rows = list(each(fn, (dict(zip(inputs, values)) for values in zip(*inputs.values())))) if needs else []
                    new = [pa.array([r.get(f.name) for r in rows], t) for f, t in zip(added.fields, types)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new], names=[*names, *added.names])

    return df.mapInArrow(run, schema)
