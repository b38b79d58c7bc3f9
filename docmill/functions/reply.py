"""Reply operators: fences, envelope, strict decoding, defaults, gates."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.text import strip

OK, CALL_FAILED, BAD_JSON, NOT_OBJECT, EMPTY_OBJECT, BAD_TYPE = (
    "ok", "call_failed", "bad_json", "not_object", "empty_object", "bad_type",
)


def fence_strip_prefix(c: Column) -> Column:
    """Drop a leading json fence, a leading bare fence and a trailing fence, in this order."""
    return strip(F.regexp_extract(strip(c), r"(?s)\A(?:```json)?(?:```)?(.*?)(?:```)?\z", 1))


def fence_strip_charset(c: Column) -> Column:
    """Drop any of the characters of a json fence from both ends, then backticks."""
    return strip(F.btrim(F.btrim(strip(c), F.lit("`json")), F.lit("`")))


def reply_content(envelope: Column) -> Column:
    """The message text of a chat envelope; null where a level is missing."""
    return F.get_json_object(envelope, "$.choices[0].message.content")


def get_or_default(reply: Column, key: str, default: str) -> Column:
    """The value at key as text; the default only where the key is absent, an explicit null stays null."""
    present = F.coalesce(F.array_contains(F.json_object_keys(reply), key), F.lit(False))
    return F.when(present, F.get_json_object(reply, f"$.{key}")).otherwise(F.lit(default))


def object_status(reply: Column) -> Column:
    """`ok` for a JSON object with at least one key, by native functions, for clean replayed replies."""
    keys = F.json_object_keys(reply)
    return (
        F.when(reply.isNull(), CALL_FAILED)
        .when(keys.isNull() & F.get_json_object(reply, "$").isNull(), BAD_JSON)
        .when(keys.isNull(), NOT_OBJECT)
        .when(F.size(keys) == 0, EMPTY_OBJECT)
        .otherwise(OK)
    )


def unfence(text: str) -> str:
    """The prefix style of fence removal on a Python string."""
    text = text.strip()
    for mark in ("```json", "```"):
        text = text.removeprefix(mark)
    return text.removesuffix("```").strip()


def unfence_charset(text: str) -> str:
    """The character style of fence removal on a Python string."""
    return text.strip().strip("`json").strip("`").strip()


def decode(text: str | None, charset: bool = False) -> tuple[str, dict[str, Any] | None]:
    """(status, object) of a raw reply, decoded strictly: trailing text and single quotes are errors.

    Stage 1 removes fences by their prefix, stage 2 by their characters (`charset`).
    """
    if text is None:
        return CALL_FAILED, None
    try:
        value = json.loads(unfence_charset(text) if charset else unfence(text))
    except ValueError:
        return BAD_JSON, None
    if not isinstance(value, dict):
        return NOT_OBJECT, None
    return (OK, value) if value else (EMPTY_OBJECT, None)


def unreadable(status: str) -> bool:
    """Whether a reply of this status is worth asking for again."""
    return status == BAD_JSON
