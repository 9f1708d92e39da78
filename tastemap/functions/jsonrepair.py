"""Recovery of a JSON object from a model answer: built-ins first, a small helper for the rest."""
from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

PLAIN_OBJECT = "map<string,string>"


def without_thoughts(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", ""))


def without_fence(text: Column) -> Column:
    """Content of a fenced block that spans the whole text."""
    t = F.trim(text)
    inner = F.regexp_extract(t, r"(?s)^```[^\n]*\n(.*)\n\s*```$", 1)
    return F.when(inner != "", F.trim(inner)).otherwise(t)


def _scan(text: str, start: int) -> tuple[int, list[str], bool, bool]:
    """End of the first object (or -1), open closers, and whether a string or an escape is open."""
    stack, quoted, escaped = [], False, False
    for i in range(start, len(text)):
        ch = text[i]
        if quoted:
            quoted = escaped or ch != '"'
            escaped = ch == "\\" and not escaped
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif stack and ch == stack[-1]:
            stack.pop()
            if not stack:
                return i, stack, False, False
    return -1, stack, quoted, escaped


def _object_text(text: str) -> str | None:
    """The outer object of a text, closed where it was cut off."""
    start = text.find("{")
    if start < 0:
        return None
    end, stack, quoted, escaped = _scan(text, start)
    tries = [text[start : end + 1]] if end >= 0 else [text[start : text.rfind("}") + 1]]
    if end < 0:
        body = (text[start:-1] if escaped else text[start:]) + ('"' if quoted else "")
        for closer in reversed(stack):
            body = re.sub(r",\s*$", "", body.rstrip()) + closer
        tries.append(body)
    tries += [re.sub(r",\s*([}\]])", r"\1", t) for t in tries]
    for t in tries:
        try:
            if isinstance(json.loads(t), dict):
                return t
        except ValueError:
            pass
    return None


@pandas_udf(T.StringType())
def _repaired(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _object_text(t) for t in text], dtype="object")


def json_object(text: Column) -> Column:
    """JSON text of the object in an answer, null when there is none.

    The helper only sees answers that are not plain JSON objects.
    """
    bare = without_fence(without_thoughts(text))
    fine = bare.startswith("{") & F.try_parse_json(bare).isNotNull()
    return F.when(fine, bare).otherwise(_repaired(F.when(~F.coalesce(fine, F.lit(False)), bare)))


def is_suspicious(text: Column) -> Column:
    """Objects that look like an echoed schema: empty, or a version and hardly anything else."""
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    # Keys an echoed schema may consist of.
    shell = F.array(*[F.lit(k) for k in ["schema_version", "domain", "user_id", "stable_interests", "short_term_interests", "weak_or_uncertain_interests", "candidate_interests"]])
    versioned = F.array_contains(keys, "schema_version")
    return (F.size(keys) == 0) | (versioned & ((F.size(keys) <= 3) | ((F.size(F.array_except(keys, shell)) == 0) & (F.size(keys) <= 4))))
