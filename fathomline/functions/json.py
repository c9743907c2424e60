"""JSON values inside free text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _first_object(text: str | None) -> str:
    """One pass over the characters: depth, and whether a string or an escape is open."""
    start, depth, quoted, escaped = -1, 0, False, False
    for i, c in enumerate(text or ""):
        if start < 0:
            if c == "{":
                start, depth = i, 1
        elif quoted:
            quoted, escaped = (escaped or c != '"'), (c == "\\" and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
    return ""


@F.pandas_udf(T.StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """JSN02: the first balanced object in a text, aware of strings and escapes; empty without one."""
    return texts.map(_first_object)


def is_object(c: Column) -> Column:
    """JSN03: whether a text is one JSON object."""
    return F.coalesce(F.startswith(F.trim(c), F.lit("{")) & F.try_parse_json(c).isNotNull(), F.lit(False))


def typed(c: Column, schema: str, default: str) -> Column:
    """JSN06: parsed as ``schema``, or ``default`` (JSON) where that fails."""
    return F.coalesce(F.from_json(c, schema), F.from_json(F.lit(default), schema))
