"""Prompt templates that render alike as a Spark column and as a Python string.

The wording is this project's own; the contract is what each prompt carries and
which JSON keys the reply must have. `{name}` marks a value; a null value renders
as the word `unknown`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"


@dataclass(frozen=True)
class Template:
    source: str

    def _parts(self) -> list[str]:
        return re.split(r"\{(\w+)\}", self.source)

    def column(self, **values: Column) -> Column:
        parts = [
            F.coalesce(values[p].cast("string"), F.lit(UNKNOWN)) if i % 2 else F.lit(p)
            for i, p in enumerate(self._parts())
            if i % 2 or p
        ]
        return F.concat(*parts)

    def render(self, **values: object) -> str:
        return "".join(
            (UNKNOWN if values[p] is None else str(values[p])) if i % 2 else p
            for i, p in enumerate(self._parts())
        )

    def sql(self, **values: str) -> str:
        """The same text as a SQL expression over the given expressions."""
        parts = [
            f"coalesce(cast({values[p]} as varchar), '{UNKNOWN}')" if i % 2 else "'" + p.replace("'", "''") + "'"
            for i, p in enumerate(self._parts())
            if i % 2 or p
        ]
        return "(" + " || ".join(parts) + ")"


_ANNUAL = (
    "Decide whether a document is the yearly report an organisation publishes about its "
    "activities, results and finances. Filings made for a tax office are not such reports. "
)
_VERDICT = 'Reply with one JSON object with the keys "is_annual_report" (true or false), "confidence" (high, medium or low) and "reason" (one sentence).'

CLASSIFY_TEXT = Template(_ANNUAL + "Address: {url} Text: {text} " + _VERDICT)
CLASSIFY_URL = Template(_ANNUAL + "The text is not available; judge by the address alone. Address: {url} " + _VERDICT)

Y1 = Template('Name the main issue of this document in ten words or fewer. Address: {url} Text: {text} Reply with JSON: {"Y1": text}.'.replace('{"Y1": text}', 'an object with the key "Y1"'))
Y2 = Template(
    "On the issue below, rate the stance of the document from 0 (fully for) over 50 (neutral) to 100 (fully against). "
    'Issue: {y1} Address: {url} Text: {text} Reply with JSON: an object with the key "Y2", an integer.'
)
Y3 = Template(
    "Quote one or two passages, word for word, that show the stance. Issue: {y1} Stance: {y2} "
    'Address: {url} Text: {text} Reply with JSON: an object with the key "Y3", an array of strings.'
)
Y4 = Template(
    "Rate the political orientation of the document from 1 (left) to 5 (right). "
    'Address: {url} Text: {text} Reply with JSON: an object with the key "Y4", an integer.'
)


def classify_prompt(url: Column, text: Column) -> Column:
    """The text prompt, or the address-only prompt where the text is null or empty."""
    return F.when(F.coalesce(text, F.lit("")) != "", CLASSIFY_TEXT.column(url=url, text=text)).otherwise(
        CLASSIFY_URL.column(url=url)
    )
