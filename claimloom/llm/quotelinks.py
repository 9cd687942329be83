"""Chat formatting: quotation linking.

A line's quote level is the number of ``>`` marks it begins with.  Quoted text is cut into units
(each line, each paragraph, each whole run of one level), normalised (letters and digits, lower
case) and hashed; so are the unquoted lines, paragraphs and bodies of all messages.  A quoted unit
is joined to the earliest message of its conversation that holds it, else to the earliest message
anywhere; both sides of that join have one row for a hash (and conversation), so a unit that
thousands of messages share makes no pairs.  The earlier message whose units carry the most quoted
letters, at the least level that links at all, is the one replied to.

Conversations come back in reply order, without quotes: roots by turn, each followed by the
replies to it.  The order is that of paths of turns, found by pointer doubling over links.

Edges: a null text is empty; a quote without an original stays unlinked and still goes; null
conversations form one conversation; messages with a null turn link to nothing and come first;
repeated rows each keep their place, ordered by role and text; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import _common as C

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_INTRO = re.compile(r"^[^\n]{0,200}\b(?:wrote|writes|said):[ \t]*$")
_TOKENS = re.compile(r"[^\W_]+")


def parse_quotes(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """The unquoted text, and runs (level, lines) of quoted text.  A line that introduces a quote
    ("... wrote:") goes with it; blank lines left over at both ends go as well."""
    own: list[str] = []
    runs: list[tuple[int, list[str]]] = []
    inside = False
    for line in text.split("\n"):
        m = _MARKS.match(line)
        if not m:
            own.append(line)
            inside = False
            continue
        level = m.group(1).count(">")
        if not inside:
            while own and not own[-1].strip():
                own.pop()
            if own and _INTRO.match(own[-1]):
                own.pop()
        if not (inside and runs[-1][0] == level):
            runs.append((level, []))
        runs[-1][1].append(line[m.end() :])
        inside = True
    if not runs:
        return text, []
    return "\n".join(own).strip("\n"), runs


def units(lines: list[str]) -> dict[int, int]:
    """Hash to number of letters, of the lines, paragraphs and whole of some text."""
    out: dict[int, int] = {}

    def add(part: list[str]):
        words = _TOKENS.findall(" ".join(part).lower())
        if words:
            digest = hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest()
            out[int.from_bytes(digest, "little", signed=True)] = sum(map(len, words))

    paragraph: list[str] = []
    for line in lines:
        add([line])
        if line.strip():
            paragraph.append(line)
        else:
            add(paragraph)
            paragraph = []
    add(paragraph)
    add(lines)
    return out


def parsed(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, clean, n_quoted, quote_depth, kind 0) and units as arrays."""

    def run(batches):
        for batch in batches:
            clean, quoted, depth, own_u, quote_u, quote_l, quote_w = [], [], [], [], [], [], []
            for text in batch.column(3).to_pylist():
                body, runs = parse_quotes(text) if text and ">" in text else (text or "", [])
                clean.append(body)
                quoted.append(sum(len(lines) for _, lines in runs))
                depth.append(max([0, *(level for level, _ in runs)]))
                own_u.append(list(units(body.split("\n"))))
                seen: dict[tuple[int, int], int] = {}
                for level, lines in runs:
                    for h, w in units(lines).items():
                        seen[level, h] = w
                quote_l.append([k[0] for k in seen])
                quote_u.append([k[1] for k in seen])
                quote_w.append(list(seen.values()))
            n = batch.num_rows
            yield C.record(
                [
                    *zip(("conv", "turn", "role", "text"), batch.columns),
                    ("clean", pa.array(clean, pa.string())),
                    ("n_quoted", pa.array(quoted, pa.int32())),
                    ("quote_depth", pa.array(depth, pa.int32())),
                    ("own", pa.array(own_u, pa.list_(pa.int64()))),
                    ("units", pa.array(quote_u, pa.list_(pa.int64()))),
                    ("levels", pa.array(quote_l, pa.list_(pa.int32()))),
                    ("weights", pa.array(quote_w, pa.list_(pa.int32()))),
                ]
            )

    base = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(C.lean(run), "conv long, turn long, role string, text string, clean string, n_quoted int, quote_depth int, own array<long>, units array<long>, levels array<int>, weights array<int>")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv, turn, role, clean, n_quoted, quote_depth, n_linked (quoted units
    that some message holds), reply_turn (in its conversation), origin_conv and origin_turn (the
    message quoted, wherever it stands), thread_turn (root), depth, position (from 0)."""
    rows = C.written(parsed(messages, conv_col, turn_col, role_col, text_col), "messages")
    asked = rows.where("turn IS NOT NULL AND n_quoted > 0").select("conv", "turn", F.explode(F.arrays_zip("units", "levels", "weights")).alias("u"))
    asked = asked.select("conv", "turn", F.col("u.units").alias("unit"), F.col("u.levels").alias("level"), F.col("u.weights").alias("weight")).distinct()
    held = rows.where("turn IS NOT NULL").select("conv", "turn", F.explode("own").alias("unit"))
    here = held.groupBy("conv", "unit").agg(F.min("turn").alias("here"))
    by_conv = here.select("unit", F.struct("conv", F.col("here").alias("turn")).alias("holder"))
    anywhere = by_conv.groupBy("unit").agg(F.min("holder").alias("first"))
    # the earliest holder from a different conversation, for those who ask in the first one's
    others = by_conv.join(anywhere, "unit").where(~F.col("holder.conv").eqNullSafe(F.col("first.conv")))
    second = others.groupBy("unit").agg(F.min("holder").alias("second"))
    anywhere = anywhere.join(second, "unit", "left")
    found = (
        asked.alias("a")
        .join(here.alias("h"), F.col("a.conv").eqNullSafe(F.col("h.conv")) & (F.col("a.unit") == F.col("h.unit")), "left")
        .join(anywhere.alias("w"), F.col("a.unit") == F.col("w.unit"), "left")
        .select("a.conv", "a.turn", "level", "weight", "here", "first", "second")
    )
    found = found.withColumn("first", F.when(F.col("first.conv").eqNullSafe(F.col("conv")), F.col("second")).otherwise(F.col("first")))
    inside = F.col("here") < F.col("turn")
    other = F.col("first").isNotNull()
    found = found.withColumn("origin", F.when(inside, F.struct("conv", F.col("here").alias("turn"))).when(other, F.col("first"))).where("origin IS NOT NULL").withColumn("inside", F.coalesce(inside, F.lit(False)))
    votes = found.groupBy("conv", "turn", "inside", "level", "origin").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    # own conversation first, then the least level, the most letters, the latest message
    best = F.max(F.struct("inside", -F.col("level"), "weight", "origin.turn", "origin")).alias("best")
    links = votes.groupBy("conv", "turn").agg(best, F.sum("n").alias("n_linked"))
    links = links.select("conv", "turn", "n_linked", F.col("best.origin.conv").alias("origin_conv"), F.col("best.origin.turn").alias("origin_turn"), F.when(F.col("best.inside"), F.col("best.origin.turn")).alias("reply_turn"))
    links = C.written(links, "links")
    paths = reply_paths(links.where("reply_turn IS NOT NULL").select("conv", "turn", "reply_turn"))
    same = lambda a, b: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.turn") == F.col(f"{b}.turn"))
    out = rows.alias("m").join(links.alias("l"), same("m", "l"), "left").join(paths.alias("p"), same("m", "p"), "left")
    out = out.select("m.conv", "m.turn", "role", "clean", "n_quoted", "quote_depth", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "origin_conv", "origin_turn", "reply_turn", F.coalesce(F.col("path"), F.array(F.col("m.turn"))).alias("path"))
    ranked, _ = C.group_ranks(out, "conv", ["path", "role", "clean"], "replies")
    return ranked.select("conv", "turn", "role", "clean", "n_quoted", "quote_depth", "n_linked", "origin_conv", "origin_turn", "reply_turn", F.col("path")[0].alias("thread_turn"), (F.size("path") - 1).cast("int").alias("depth"), F.col("rank").alias("position"))


def reply_paths(links: DataFrame) -> DataFrame:
    """(conv, turn, path): turns from the root to the message, by doubling; a reply's turn is
    larger than its original's, so paths end."""
    now = links.select("conv", "turn", F.col("reply_turn").alias("up"), F.array("turn").alias("path"))
    now = C.written(now, "paths")
    while True:
        mine, over = now.alias("a"), now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("path").alias("path2")).alias("b")
        joined = mine.join(over, F.col("a.conv").eqNullSafe(F.col("c")) & (F.col("a.up") == F.col("t")), "left")
        if not joined.where("t IS NOT NULL").limit(1).count():
            break
        new = C.written(joined.select("conv", "turn", F.when(F.col("t").isNotNull(), F.col("up2")).otherwise(F.col("up")).alias("up"), F.when(F.col("t").isNotNull(), F.concat("path2", "path")).otherwise(F.col("path")).alias("path")), "paths")
        C.dropped(now)
        now = new
    return now.select("conv", "turn", F.concat(F.array("up"), F.col("path")).alias("path"))


def op1_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_quotes(C.read_table(spark, sf_dir, "conversations"))
    return out.select(F.col("conv").alias("conv_id"), "turn", "role", "position", "depth", "thread_turn", "reply_turn", "origin_conv", "origin_turn", "quote_depth", F.col("n_quoted").alias("n_quoted_lines"), F.col("n_linked").alias("n_linked_units"), F.sha2("clean", 256).alias("clean_sha256"))
