"""Structured answers in free text: envelopes, key-value blocks, tagged entries, slots.

What an answer holds is read line by line, because a line's meaning depends on the block it stands
in; whole texts go through Arrow batches.  Nothing raises on odd text: what cannot be read is left
out.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.model import ROLES

# The slots of an ontology answer, those that hold a list, the keys of a compound.
SLOTS = ["HEAD", "MODIFIER", "IS_A", "HAS_PART", "HAS_ATTRIBUTE", "HAS_PURPOSE"]
LIST_SLOTS = ["MODIFIER", "IS_A", "HAS_PART", "HAS_ATTRIBUTE"]
COMPOUND_KEYS = ["new_lemma", "new_gloss", "new_microgloss", "bow", "is_a_parents"]

_MARK = re.compile(r"[A-Z][A-Z0-9_-]+")
_SLOT = re.compile(rf"[\s*•→-]*({'|'.join(SLOTS)}):(.*)", re.IGNORECASE)
_BLOCK = re.compile(r"(event|link)_(\d+):", re.IGNORECASE)
_ENTRY = re.compile(r'<answer entry_id="([^"]*)"(.*?)</answer>', re.DOTALL)

_MAPS = T.ArrayType(T.MapType(T.StringType(), T.StringType()))


def envelope(text: Column, mark: str = "answer") -> Column:
    """What stands between <answer> and </answer>, trimmed; null without both or when blank."""
    inner = F.regexp_extract(text, rf"(?s)<{mark}>(.*?)</{mark}>", 1)
    return F.nullif(F.regexp_replace(inner, r"^\s+|\s+$", ""), F.lit(""))


def _pair(line: str) -> tuple[str, str] | None:
    key, mark, value = line.partition(":")
    return (key.strip().lower(), value.strip()) if mark else None


def read_blocks(text: str | None) -> list[dict[str, str]]:
    """Key-value blocks.  A line of capitals such as RELATION_1 marks a block, and where any does,
    lines outside marked blocks are prose.  Without marks the lines form blocks by themselves.  A blank
    line ends a block, a line without a colon continues the value before it."""
    lines = [x.strip() for x in (text or "").splitlines()]
    marked = any(_MARK.fullmatch(x) for x in lines)
    out: list[dict[str, str]] = []
    here: dict[str, str] | None = None
    key = None
    for line in lines:
        if _MARK.fullmatch(line):
            here, key = {"_marker": line}, None
            out.append(here)
        elif not line:
            here = None
        elif here is None and marked:
            continue
        else:
            if here is None:
                here, key = {"_marker": "BLOCK"}, None
                out.append(here)
            pair = _pair(line)
            if pair and pair[0]:
                key = pair[0]
                here[key] = pair[1]
            elif not pair and key:
                here[key] = f"{here[key]} {line}".strip()
    return [b for b in out if len(b) > 1]


@F.pandas_udf(_MAPS)
def kv_blocks(texts: pd.Series) -> pd.Series:
    return texts.map(read_blocks)


def read_compounds(text: str | None) -> list[dict[str, str]]:
    """Compounds of an answer whose DECISION is YES, each after a line such as "Compound 2:"."""
    agreed, groups = False, [{}]
    for line in (text or "").splitlines():
        line = line.strip()
        if line.startswith("DECISION:"):
            agreed = line[9:].strip().upper() == "YES"
        elif re.match(r"Compound\s+\d+:", line):
            groups.append({})
        elif (pair := _pair(line)) and pair[0] in COMPOUND_KEYS:
            groups[-1][pair[0]] = pair[1]
    return [g for g in groups if g] if agreed else []


@F.pandas_udf(_MAPS)
def compounds(texts: pd.Series) -> pd.Series:
    return texts.map(read_compounds)


def _items(text: str) -> list[str]:
    return [x.strip() for x in re.split("[,;|]", text) if x.strip()]


def read_slots(text: str | None) -> dict:
    """The six slots of an ontology answer; lines without a label continue the slot before them."""
    out: dict = {s: [] if s in LIST_SLOTS else "" for s in SLOTS}
    slot = None
    for line in filter(None, map(str.strip, (text or "").splitlines())):
        found = _SLOT.fullmatch(line)
        if found:
            slot = found.group(1).upper()
            value = found.group(2).strip()
            out[slot] = _items(value) if slot in LIST_SLOTS else value
        elif slot in LIST_SLOTS:
            out[slot] += _items(line)
        elif slot == "HAS_PURPOSE" or slot == "HEAD" and not out[slot]:
            out[slot] = f"{out[slot]} {line}".strip()
    return {s.lower(): v for s, v in out.items()}


_SLOT_TYPE = T.StructType([T.StructField(s.lower(), T.ArrayType(T.StringType()) if s in LIST_SLOTS else T.StringType()) for s in SLOTS])


@F.pandas_udf(_SLOT_TYPE)
def ontology_slots(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_slots(t) for t in texts], columns=[f.name for f in _SLOT_TYPE.fields])


def read_parents(value: str) -> list[dict[str, str]]:
    """Parents as lemmas, or as lemma: gloss."""
    out = []
    for part in filter(None, map(str.strip, value.split(","))):
        lemma, mark, gloss = part.partition(":")
        named = bool(mark) and bool(lemma)
        out.append({"lemma": lemma.strip() if named else part, "gloss": gloss.strip().strip("\"'") if named else ""})
    return out


def read_entry(block: str) -> dict:
    """Fields, parents, events and links of one entry's answer."""
    out: dict = {"fields": {}, "parents": [], "parts": [], "attributes": [], "events": [], "links": []}
    event: dict | None = None
    link: dict | None = None
    for line in filter(None, map(str.strip, block.splitlines())):
        begin = _BLOCK.fullmatch(line)
        if begin and begin.group(1).lower() == "event":
            event, link = {"key": f"event_{begin.group(2)}", "verb": "", "epistemic_status": "CONSTITUTIVE", "roles": {}}, None
            out["events"].append(event)
        elif begin:
            event, link = None, {}
            out["links"].append(link)
        elif pair := _pair(line):
            key, value = pair
            if key == "event_group":
                out["fields"][key] = value
            elif event is not None:
                if key == "verb":
                    event["verb"] = value
                elif key == "epistemic_status":
                    event[key] = value.upper()
                else:
                    role = key.upper()
                    held = event["roles"].get(role)
                    event["roles"][role] = f"{held}, {value}" if held and role in ROLES else value
            elif link is not None and key in ("source", "link_type", "target"):
                link[key] = value
            elif key in ("is_a_parents", "is_instance_of"):
                out["parents"] += [p | {"kind": key} for p in read_parents(value)]
            elif key == "has_part":
                out["parts"] += [x.strip() for x in value.split(",") if x.strip()]
            elif key == "has_attribute":
                out["attributes"] += [x.strip() for x in value.split(",") if x.strip()]
            elif key in ("bow", "purpose", "new_gloss", "new_microgloss"):
                out["fields"][key] = value
    out["links"] = [x for x in out["links"] if len(x) == 3]
    return out


def read_entries(text: str | None) -> list[dict]:
    """Entries between <answer entry_id="n"> and </answer>; the last answer of an id counts."""
    found: dict[int, dict] = {}
    for m in _ENTRY.finditer(text or ""):
        if re.fullmatch(r"\s*[+-]?\d+\s*", m.group(1)):
            entry = read_entry(m.group(2).lstrip(">"))
            if any(entry.values()):
                found[int(m.group(1))] = entry
    return [{"entry_id": i, **e} for i, e in found.items()]


_STRINGS = T.ArrayType(T.StringType())
_TEXT = lambda *names: [T.StructField(n, T.StringType()) for n in names]
ENTRY_ANSWER = T.StructType(
    [
        T.StructField("entry_id", T.LongType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("parents", T.ArrayType(T.StructType(_TEXT("lemma", "gloss", "kind")))),
        T.StructField("parts", _STRINGS),
        T.StructField("attributes", _STRINGS),
        T.StructField("events", T.ArrayType(T.StructType([*_TEXT("key", "verb", "epistemic_status"), T.StructField("roles", T.MapType(T.StringType(), T.StringType()))]))),
        T.StructField("links", T.ArrayType(T.StructType(_TEXT("source", "link_type", "target")))),
    ]
)


@F.pandas_udf(T.ArrayType(ENTRY_ANSWER))
def entry_answers(texts: pd.Series) -> pd.Series:
    return texts.map(read_entries)
