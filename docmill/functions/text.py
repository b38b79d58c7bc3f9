"""Text operators as native columns: strip, OCR gates, page concatenation, caps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() sees it; `trim` would only remove U+0020.
_EDGE = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"

GATE_PAGES, GATE_CHARS = 15, 50
CLASSIFY_PAGES, CLASSIFY_CHARS = 15, 200_000
ANALYSE_PAGES = 2000


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends; null stays null."""
    return F.regexp_replace(c, _EDGE, "")


def pages_of(text: Column) -> Column:
    """The pages of a text, cut at form feeds; null text gives null."""
    return F.split(text, "\f", -1)


def page_concat(pages: Column, max_pages: int) -> Column:
    """The first pages joined without a separator; a null page counts as empty, null pages give null."""
    filled = F.transform(F.slice(pages, 1, max_pages), lambda p: F.coalesce(p, F.lit("")))
    return F.array_join(filled, "")


def ocr_gate_strict(pages: Column) -> Column:
    """True where the first 15 pages hold under 50 characters after a strip (stage 1)."""
    return F.char_length(strip(page_concat(pages, GATE_PAGES))) < GATE_CHARS


def ocr_gate_lenient(pages: Column) -> Column:
    """As the strict gate without the strip; an empty page counts as one space (stage 2)."""
    spaced = F.transform(
        F.slice(pages, 1, GATE_PAGES),
        lambda p: F.when(F.coalesce(p, F.lit("")) == "", F.lit(" ")).otherwise(p),
    )
    return F.char_length(F.array_join(spaced, "")) < GATE_CHARS


def truncate(text: Column, max_chars: int = CLASSIFY_CHARS) -> Column:
    """The first code points of a text."""
    return F.substring(text, 1, max_chars)


def url_prefix(url: Column, chars: int = 100) -> Column:
    """The start of an address as run logs show it; null stays null."""
    return F.substring(url, 1, chars)
