"""Fetch a document, read its pages, decide on OCR, join the pages: one stage, errors as columns."""

from __future__ import annotations

import io
import os
import subprocess
import tempfile
import time
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions import text as X
from docmill.operators.provider import row_stage


class Fetcher(Protocol):
    def fetch(self, url: str) -> bytes: ...


class PageReader(Protocol):
    def pages(self, body: bytes) -> list[str | None]: ...


class Ocr(Protocol):
    def read(self, body: bytes) -> bytes: ...


@dataclass(frozen=True)
class HttpFetcher:
    """GET with a time limit; any answer but 2xx raises."""

    timeout: float = 30

    def fetch(self, url: str) -> bytes:
        with urllib.request.urlopen(url, timeout=self.timeout) as got:
            return got.read()


@dataclass(frozen=True)
class ColumnFetcher:
    """A document that is already in a column of the row, as text or bytes; null was not found."""

    column: str

    @property
    def needs(self) -> tuple[str, ...]:
        return (self.column,)

    def fetch_row(self, row: Mapping[str, Any]) -> bytes:
        got = row[self.column]
        if got is None:
            raise LookupError("no document")
        return got.encode("utf-8", "replace") if isinstance(got, str) else bytes(got)


class TextReader:
    """Pages of a plain text, cut at form feeds; an empty document has none and cannot be read."""

    def pages(self, body: bytes) -> list[str | None]:
        if not body:
            raise ValueError("an empty document")
        return list(body.decode("utf-8", "replace").split("\f"))


class PdfReader:
    """Pages of a PDF by a library that is imported only here. Not tested offline."""

    def pages(self, body: bytes) -> list[str | None]:
        import pypdf

        return [page.extract_text() for page in pypdf.PdfReader(io.BytesIO(body)).pages]


class CommandOcr:
    """OCR by an external program on a temporary folder that is always removed. Not tested offline."""

    def read(self, body: bytes) -> bytes:
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "document.pdf")
            with open(path, "wb") as f:
                f.write(body)
            subprocess.run(["ocrmypdf", "--deskew", "--force-ocr", path, path], check=True, capture_output=True)
            with open(path, "rb") as f:
                return f.read()


@dataclass(frozen=True)
class ExtractPolicy:
    """Page cap, character cap and whether the OCR gate strips."""

    max_pages: int
    max_chars: int | None
    strict_gate: bool

    def wants_ocr(self, pages: list[str | None]) -> bool:
        first = pages[: X.GATE_PAGES]
        if self.strict_gate:
            return len("".join(p or "" for p in first).strip()) < X.GATE_CHARS
        return len("".join(p or " " for p in first)) < X.GATE_CHARS

    def text(self, pages: list[str | None]) -> str:
        return "".join(p or "" for p in pages[: self.max_pages])[: self.max_chars]

    def column(self, pages: Column) -> Column:
        """The same text by native functions, for pages that are already in a column."""
        joined = X.page_concat(pages, self.max_pages)
        return joined if self.max_chars is None else X.truncate(joined, self.max_chars)


CLASSIFY = ExtractPolicy(X.CLASSIFY_PAGES, X.CLASSIFY_CHARS, True)
ANALYSE = ExtractPolicy(X.ANALYSE_PAGES, None, False)

_OUT = T.StructType(
    [
        T.StructField("pdf_text", T.StringType()),
        T.StructField("extract_status", T.StringType()),
        T.StructField("extract_error", T.StringType()),
        T.StructField("used_ocr", T.BooleanType()),
        T.StructField("extract_seconds", T.DoubleType()),
    ]
)


def extract(
    df: DataFrame, fetcher: Fetcher, reader: PageReader, policy: ExtractPolicy = CLASSIFY,
    url: str = "pdf_url", ocr: Ocr | None = None, threads: int = 1,
) -> DataFrame:
    """Append the text of each address, null on any error; the row always goes on.

    Status is ok, no_url, fetch_failed, read_failed or ocr_failed; `extract_seconds` is the
    time the document took. Bytes stay inside the stage and never enter a shuffle. A
    fetcher with `needs` reads the document from those columns of the row.
    """
    own = tuple(getattr(fetcher, "needs", ()))

    def call(row: Mapping[str, Any]) -> Mapping[str, Any]:
        began = time.perf_counter()
        return read(row) | {"extract_seconds": time.perf_counter() - began}

    def read(row: Mapping[str, Any]) -> dict[str, Any]:
        at, used = "fetch_failed", False
        if row[url] is None:
            return {"extract_status": "no_url", "used_ocr": False}
        try:
            body = fetcher.fetch_row(row) if own else fetcher.fetch(str(row[url]))
            at = "read_failed"
            pages = reader.pages(body)
            if policy.wants_ocr(pages) and ocr is not None:
                at, used = "ocr_failed", True
                pages = reader.pages(ocr.read(body))
            return {"pdf_text": policy.text(pages), "extract_status": "ok", "used_ocr": used}
        except Exception as e:  # whatever the source raises, the row gets a null text
            return {"extract_status": at, "extract_error": f"{type(e).__name__}: {e}", "used_ocr": used}

    return row_stage(df, _OUT, call, (url, *own), drop=own, threads=threads)


def replay_extract(df: DataFrame, pages: str, fetched: str, policy: ExtractPolicy = CLASSIFY) -> DataFrame:
    """The stage over pages already in column `pages`; `fetched` says whether a document came at all."""
    got = F.col(pages)
    status = F.when(~F.col(fetched), "fetch_failed").when(got.isNull(), "read_failed").otherwise("ok")
    return df.withColumns({"pdf_text": policy.column(got), "extract_status": status})


def text_stats(df: DataFrame, text: str = "pdf_text") -> DataFrame:
    """Characters of each text; null stays null."""
    return df.withColumn("text_chars", F.char_length(text).cast("long"))
