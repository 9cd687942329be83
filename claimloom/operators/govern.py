"""Rules over proposals, message admission, data-quality validators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verdicts(proposals: DataFrame, fired: DataFrame, key: str) -> DataFrame:
    """Final verdict of each proposal: highest priority, then DENY over UNKNOWN over ALLOW, then
    rule id; DENY by default.  ``fired``: key, rule_id, priority, status."""
    strength = F.when(F.col("status") == "DENY", 0).when(F.col("status") == "UNKNOWN", 1).otherwise(2)
    order = Window.partitionBy(key).orderBy(F.desc("priority"), strength, "rule_id")
    best = fired.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(key, F.col("status").alias("verdict"), F.col("rule_id").alias("decided_by"))
    return proposals.join(best, key, "left").withColumn("verdict", F.coalesce("verdict", F.lit("DENY"))).withColumn("decided_by", F.coalesce("decided_by", F.lit("default")))


def contributions(proposals: DataFrame, rules: list[dict], key: str) -> DataFrame:
    """One row for each rule in whose scope a proposal is.  A rule: rule_id, priority, effect (ALLOW
    or DENY), scope and predicate (Columns).  A predicate that is null for want of an observation
    contributes UNKNOWN, never a verdict."""
    each = [
        F.when(F.coalesce(r["scope"], F.lit(False)), F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["priority"]).alias("priority"), F.when(r["predicate"].isNull(), "UNKNOWN").when(r["predicate"], r["effect"]).alias("status")))
        for r in rules
    ]
    return proposals.select(key, F.explode(F.array_compact(F.array(*each))).alias("r")).select(key, "r.*").where("status IS NOT NULL")


def first_failure(gates: list[tuple[str, Column]]) -> Column:
    """Name of the first gate that does not hold, in the given order; null when all hold."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(gates):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def validators(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """How many rows fail each check: validator, failed, total; one pass over the table."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("validator"), F.col(n).alias("failed"), F.col("_n").alias("total")) for n in checks])).alias("v")).select("v.*")


# ---------------------------------------------------------------- predicate language

_TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|\"([^\"]*)\"|(>=|<=|==|!=|[<>(),\[\]])|([A-Za-z_][\w.]*))")


class PredicateError(ValueError):
    pass


class Registry:
    """Predicates of a host by name: builders of a boolean Column from Columns."""

    def __init__(self):
        self.predicates: dict = {}

    def add(self, name: str, build) -> None:
        if name in self.predicates:
            raise ValueError(f"{name} is registered")
        self.predicates[name] = build


def compile_predicate(text: str, registry: Registry | None = None) -> Column:
    """Comparisons, IN lists, calls of registered predicates, NOT over AND over OR over XOR, parentheses;
    three-valued like SQL."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise PredicateError(f"cannot read {text[at:]!r}")
        kind = ("number", "string", "mark", "name")[m.lastindex - 1]
        tokens.append((kind, m.group(m.lastindex)))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def peek(*words: str) -> bool:
        return tokens[place][1].upper() in words and tokens[place][0] != "string"

    def take(*words: str) -> tuple[str, str]:
        nonlocal place
        if words and not peek(*words):
            raise PredicateError(f"expected {' or '.join(words)}, found {tokens[place][1]!r}")
        place += 1
        return tokens[place - 1]

    def value() -> Column:
        kind, word = take()
        if kind == "number":
            return F.lit(float(word) if "." in word else int(word))
        if kind == "string":
            return F.lit(word)
        if kind == "name" and peek("("):
            if registry is None or word not in registry.predicates:
                raise PredicateError(f"no predicate {word!r} is registered")
            take("(")
            items = [value()]
            while peek(","):
                take(",")
                items.append(value())
            take(")")
            return registry.predicates[word](*items)
        if kind == "name":
            return F.lit(word.upper() == "TRUE") if word.upper() in ("TRUE", "FALSE") else F.col(word)
        raise PredicateError(f"unexpected {word!r}")

    def atom() -> Column:
        if peek("("):
            take("(")
            inner = lowest()
            take(")")
            return inner
        left = value()
        if peek("IN"):
            take("IN")
            take("[", "(")
            items = [value()]
            while peek(","):
                take(",")
                items.append(value())
            take("]", ")")
            out = left == items[0]
            for i in items[1:]:
                out = out | (left == i)
            return out
        if peek(">=", "<=", "==", "!=", "<", ">"):
            sign, right = take()[1], value()
            return {">=": left >= right, "<=": left <= right, "==": left == right, "!=": left != right, "<": left < right, ">": left > right}[sign]
        return left

    def negated() -> Column:
        if peek("NOT"):
            take("NOT")
            return ~negated()
        return atom()

    def chain(word: str, inner, join) -> Column:
        out = inner()
        while peek(word):
            take(word)
            out = join(out, inner())
        return out

    def conjunction() -> Column:
        return chain("AND", negated, lambda a, b: a & b)

    def disjunction() -> Column:
        return chain("OR", conjunction, lambda a, b: a | b)

    def lowest() -> Column:
        return chain("XOR", disjunction, lambda a, b: (a & ~b) | (~a & b))

    out = lowest()
    take("")
    return out


# ---------------------------------------------------------------- specifications

# The primitives of a specification and the fields that each requires.
PRIMITIVES = {
    "STATE_TRANSITION": ["ACTION", "PRECONDITION", "GOVERNED_BY"], "GOVERNANCE_RULE": ["SCOPE", "PREDICATE", "ENFORCEMENT_MODE", "PRIORITY"],
    "PERCEPTION_MAP": ["SOURCE", "OUTPUT"], "DATA_TYPE_SCHEMA": ["FIELDS"], "MUTATION_RULE": ["TARGET_REFERENCE", "APPROVED_BY"],
    "SELF_REFERENCE_POINT": ["TARGET_TYPE"], "RESOURCE_BOUND": ["METRIC", "THRESHOLD"], "LEARNING_AXIOM": ["KNOWLEDGE_UPDATE_RULE", "CONSTRAINT_SET"],
    "ENTITY": ["TYPE"], "CONTEXT": ["SCOPE"], "TEMPORAL_RELATION": ["LEFT", "RELATION", "RIGHT"], "CAUSAL_LINK": ["CAUSE", "EFFECT"],
    "META_DEFINITION_RULE": ["TARGET"],
}
MODES = {"PERMIT": "ALLOW", "PROHIBIT": "DENY"}
REFERENCES = {
    ("STATE_TRANSITION", "GOVERNED_BY"): "GOVERNANCE_RULE", ("MUTATION_RULE", "TARGET_REFERENCE"): "SELF_REFERENCE_POINT",
    ("LEARNING_AXIOM", "KNOWLEDGE_UPDATE_RULE"): "MUTATION_RULE", ("LEARNING_AXIOM", "CONSTRAINT_SET"): "RESOURCE_BOUND",
}

_CALL = re.compile(r"\s*([A-Z_]+)\s+([A-Za-z_]\w*)\s*\{")
_FIELD = re.compile(r"\s*([A-Z_]+)\s*:\s*([^;]*);")
_END = re.compile(r"\s*\}")


class SpecError(ValueError):
    pass


def _where(text: str, at: int) -> str:
    return f"line {text.count(chr(10), 0, at) + 1}, column {at - text.rfind(chr(10), 0, at)}"


def load_spec(text: str) -> dict[str, dict]:
    """A specification, ``PRIMITIVE name { FIELD: value; ... }`` again and again, as name to its kind
    and fields.  Checked on loading: grammar, primitives, required fields, references, enforcement
    modes, predicates, cycles among the rules that change rules.  The first fault raises, with its place."""
    spec: dict[str, dict] = {}
    body = re.sub(r"#[^\n]*", lambda m: " " * len(m.group()), text)
    at = 0
    while body[at:].strip():
        call = _CALL.match(body, at)
        if not call:
            raise SpecError(f"{_where(text, at + len(body[at:]) - len(body[at:].lstrip()))}: a primitive is expected")
        kind, name = call.groups()
        if kind not in PRIMITIVES:
            raise SpecError(f"{_where(text, call.start(1))}: unknown primitive {kind}")
        if name in spec:
            raise SpecError(f"{_where(text, call.start(2))}: {name} is defined twice")
        at, fields = call.end(), {}
        while not (end := _END.match(body, at)):
            field = _FIELD.match(body, at)
            if not field:
                raise SpecError(f"{_where(text, at)}: a field is expected in {name}")
            fields[field.group(1)] = field.group(2).strip()
            at = field.end()
        at = end.end()
        lacking = [f for f in PRIMITIVES[kind] if f not in fields]
        if lacking:
            raise SpecError(f"{name} lacks {', '.join(lacking)}")
        spec[name] = {"kind": kind, **fields}
    for name, one in spec.items():
        for (kind, field), target in REFERENCES.items():
            if one["kind"] == kind:
                for ref in re.split(r"\s*,\s*", one[field]):
                    if spec.get(ref, {}).get("kind") != target:
                        raise SpecError(f"{name}: {field} names no {target}: {ref}")
        if one["kind"] == "GOVERNANCE_RULE" and one["ENFORCEMENT_MODE"] not in MODES:
            raise SpecError(f"{name}: unknown enforcement mode {one['ENFORCEMENT_MODE']}")
    changes = {n: re.split(r"\s*,\s*", spec[o["TARGET_REFERENCE"]].get("CONTAINS", "")) for n, o in spec.items() if o["kind"] == "MUTATION_RULE"}
    for name in changes:
        seen, front = set(), [name]
        while front:
            for nxt in changes.get(front.pop(), []):
                if nxt == name:
                    raise SpecError(f"{name} can change itself")
                if nxt in changes and nxt not in seen:
                    seen.add(nxt)
                    front.append(nxt)
    for name, one in spec.items():
        for field in ("PREDICATE", "PRECONDITION", "SCOPE"):
            if one["kind"] in ("GOVERNANCE_RULE", "STATE_TRANSITION") and field in one:
                parse_predicate(one[field], name)
    return spec


def parse_predicate(text: str, name: str = "") -> None:
    """Reads a predicate without a session's help; raises where it is no predicate."""
    try:
        compile_predicate(text)
    except PredicateError as e:
        raise SpecError(f"{name}: {e}") from e


def evaluate(proposals: DataFrame, spec: dict[str, dict], key: str, action: str = "action") -> DataFrame:
    """A report on each proposal: key, status, rule_id, reason, gap_report (sorted names of missing
    observations; null unless UNKNOWN).

    A proposal needs a transition for its action; of transitions, a precondition that is false gives
    nothing and one that cannot be seen gives UNKNOWN; then the rules in whose scope it is decide by
    priority, DENY over UNKNOWN over ALLOW, then by name."""
    moves = [(n, o) for n, o in spec.items() if o["kind"] == "STATE_TRANSITION"]
    rules = [(n, o) for n, o in spec.items() if o["kind"] == "GOVERNANCE_RULE"]
    none, no = F.lit(None).cast("string"), F.lit(False)
    fits = [F.col(action) == o["ACTION"].strip('"') for _, o in moves]
    holds = [F.when(f, compile_predicate(o["PRECONDITION"])) for f, (_, o) in zip(fits, moves)]
    any_of = lambda cols: F.array_contains(F.array(no, *cols), True)
    some = any_of([F.coalesce(f, no) for f in fits])
    open_, unseen = any_of([F.coalesce(h, no) for h in holds]), any_of([F.coalesce(f & h.isNull(), no) for f, h in zip(fits, holds)])
    strength = {"DENY": 0, "UNKNOWN": 1, "ALLOW": 2}
    votes, scopes, gaps = [], [], []
    for name, o in rules:
        scope, seen = F.coalesce(compile_predicate(o["SCOPE"]), no), compile_predicate(o["PREDICATE"])
        effect = MODES[o["ENFORCEMENT_MODE"]]
        status = F.when(scope & seen.isNull(), "UNKNOWN").when(scope & seen, effect)
        rank = F.when(status == "UNKNOWN", strength["UNKNOWN"]).otherwise(strength[effect])
        votes.append(F.when(status.isNotNull(), F.struct(F.lit(-int(o["PRIORITY"])).alias("p"), rank.alias("r"), F.lit(name).alias("rule_id"), status.alias("status"))))
        scopes.append(scope)
        names = sorted({w for k, w in _words(o["PREDICATE"]) if k == "name"} & set(proposals.columns))
        gaps += [F.when(scope & seen.isNull() & F.col(c).isNull(), c) for c in names]
    for f, h, (_, o) in zip(fits, holds, moves):
        names = sorted({w for k, w in _words(o["PRECONDITION"]) if k == "name"} & set(proposals.columns))
        gaps += [F.when(f & h.isNull() & F.col(c).isNull(), c) for c in names]
    vote = F.array_min(F.array_compact(F.array(*votes))) if votes else F.lit(None).cast("struct<p:int,r:int,rule_id:string,status:string>")
    r = proposals.select(key, some.alias("_some"), open_.alias("_open"), unseen.alias("_unseen"), any_of(scopes).alias("_scope"), vote.alias("_v"), F.array_sort(F.array_distinct(F.array_compact(F.array(none, *gaps)))).alias("_gaps"))
    status = F.when(~F.col("_some"), "DENY").when(F.col("_open"), F.coalesce("_v.status", F.lit("DENY"))).when(F.col("_unseen"), "UNKNOWN").otherwise("DENY")
    reason = F.when(~F.col("_some"), "no_matching_transition").when(~F.col("_open"), "precondition_failed").when(~F.col("_scope"), "no_matching_rule").when(F.col("_v").isNull(), "no_rule_fired").otherwise("prohibitive_rule_fired")
    out = r.withColumn("status", status)
    return out.select(key, "status", F.when(F.col("_open"), F.col("_v.rule_id")).alias("rule_id"), F.when(F.col("status") == "DENY", reason).alias("reason"), F.when(F.col("status") == "UNKNOWN", F.col("_gaps")).alias("gap_report"))


def _words(text: str) -> list[tuple[str, str]]:
    return [(("number", "string", "mark", "name")[m.lastindex - 1], m.group(m.lastindex)) for m in _TOKEN.finditer(text)]


def postconditions(before: DataFrame, after: DataFrame, key: str, check: str) -> DataFrame:
    """(key, verified): did the state after an action meet its postcondition?  Names prefixed old_ are
    of the state before; null where it cannot be seen or the row is gone."""
    old = before.select(F.col(key), *[F.col(c).alias(f"old_{c}") for c in before.columns if c != key])
    return old.join(after, key, "left").select(key, compile_predicate(check).alias("verified"))


# ---------------------------------------------------------------- stages


def answer_block(text: str = "value") -> Column:
    return F.col(text).rlike(r"(?s)<answer>.*\S.*</answer>")


def required_keys(record: Column, keys: list[str]) -> Column:
    """A map that has every key, none of them null."""
    out = F.lit(True)
    for k in keys:
        out = out & record[k].isNotNull()
    return out


def file_present(spark, path: str) -> bool:
    """Is there a file or a folder at a path of any file system that Spark reads?"""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def written(spark, path: str, rows: int | None = None) -> bool:
    """Did a write or an export end, with as many rows as it should have?"""
    done = file_present(spark, f"{path}/_SUCCESS")
    return done and (rows is None or spark.read.parquet(path).count() == rows)


def conforms(df: DataFrame, schema) -> bool:
    """Does a table have the columns and types of a schema, whatever else it has?"""
    have = {f.name: f.dataType for f in df.schema.fields}
    return all(have.get(f.name) == f.dataType for f in schema.fields)


def referential(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """One row: how many references have no target, of how many."""
    known = target.select(F.col(key).alias(column), F.lit(True).alias("_known")).distinct()
    asked = df.where(F.col(column).isNotNull()).select(column).join(known, column, "left")
    return asked.agg(F.count_if(F.col("_known").isNull()).alias("failed"), F.count(F.lit(1)).alias("total"))


def content_hash(df: DataFrame) -> Column:
    """A hash of a table's rows whatever their order, as an aggregate."""
    return F.lower(F.hex(F.bit_xor(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]))))


def run_stages(needs: dict[str, list[str]], stages: dict, optional: list[str] | None = None) -> dict[str, str]:
    """Runs stages in the order of their needs, each once: stage to done, failed or skipped.  A stage
    whose needs failed is skipped; an optional one may fail without that."""
    from claimloom.operators.graph import stage_order

    out: dict[str, str] = {}
    for name in stage_order(needs):
        if any(out[n] != "done" and n not in (optional or []) for n in needs.get(name, [])):
            out[name] = "skipped"
            continue
        try:
            stages[name]()
            out[name] = "done"
        except Exception:
            out[name] = "failed"
    return out


def not_run(wanted: DataFrame, done: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Runs whose fingerprint no finished run has, each once."""
    return wanted.dropDuplicates([fingerprint]).join(done.select(fingerprint).distinct(), fingerprint, "left_anti")
