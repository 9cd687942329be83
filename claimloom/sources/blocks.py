"""Block formats in text: fenced key-value blocks, answer envelopes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPEN = re.compile(r"^\s*:::([\w-]+)\s*$")
_CLOSE = re.compile(r"^\s*:::\s*$")
_PAIR = re.compile(r"^\s*([A-Za-z_][\w.-]*):\s*(.*?)\s*$")


def parse_blocks(text: str | None) -> list[dict[str, str]]:
    """Blocks between ``:::kind`` and ``:::``; indented lines continue a value; text outside is
    ignored, and so is a block that does not end."""
    out: list[dict[str, str]] = []
    block: dict[str, str] | None = None
    key: str | None = None
    for line in (text or "").splitlines():
        if block is None:
            if m := _OPEN.match(line):
                block, key = {"_kind": m.group(1)}, None
        elif _CLOSE.match(line):
            out.append(block)
            block = None
        elif key and line[:1] == "\t" or key and line[:2] == "  ":
            block[key] += "\n" + line.strip()
        elif m := _PAIR.match(line):
            key = m.group(1)
            block[key] = m.group(2)
    return out


@F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
def blocks(texts: pd.Series) -> pd.Series:
    return texts.map(parse_blocks)


def answer(text: Column, mark: str = "ANSWER") -> Column:
    """What stands between <ANSWER> and </ANSWER>, else the whole text."""
    inner = F.regexp_extract(text, rf"(?s)<{mark}>(.*?)</{mark}>", 1)
    return F.trim(F.when(inner != "", inner).otherwise(text))


def block_text(kind: str, fields: dict[str, Column]) -> Column:
    """A fenced block from Columns; nulls are left out, booleans in lower case, continued lines
    indented."""
    cells = [F.concat(F.lit(f"{k}: "), F.replace(v.cast("string"), F.lit("\n"), F.lit("\n  "))) for k, v in fields.items()]
    return F.concat(F.concat_ws("\n", F.lit(f":::{kind}"), *cells, F.lit(":::")), F.lit("\n"))
