"""Feature names: ``stream__calculator__params``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "__"


def stream_of(feature: Column) -> Column:
    return F.split_part(feature, F.lit(SEP), F.lit(1))


def calculator_of(feature: Column) -> Column:
    return F.split_part(feature, F.lit(SEP), F.lit(2))


def glob_to_regex(glob: str) -> str:
    """Shell pattern as an anchored regular expression (``*``, ``?`` and ``[...]``)."""
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = close
        else:
            out += re.escape(ch)
        i += 1
    return f"^(?s:{out})$"


def glob_match(feature: Column, glob: str) -> Column:
    return feature.rlike(glob_to_regex(glob))


def feature_line(line: Column) -> tuple[Column, Column]:
    """P-value and name of one line of a model's feature list."""
    pattern = r"^\s*(\S+)\s+(.*\S)\s*$"
    return (
        F.regexp_extract(line, pattern, 1).try_cast("double"),
        F.regexp_replace(F.regexp_extract(line, pattern, 2), r"\s+", " "),
    )
