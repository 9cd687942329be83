"""RSKV text: sets of sparse records.  A batch data source, one file per partition, read line by
line; and a writer that packs rows as text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The marks of the format and its types.
ROW_MARK = "---ROW---"
NULL_MARK = "\\N"
TYPES = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean", "date": "date", "datetime": "timestamp", "json": "string", "base64": "binary"}

_EXTENSION = re.compile(r"#([A-Z]+):\s*(.*)")
_ESCAPE = re.compile(r"\\---ROW---|\\[\\n#]|\\.")
_DECODED = {"\\---ROW---": ROW_MARK, "\\\\": "\\", "\\n": "\n", "\\#": "#"}


class RskvError(ValueError):
    pass


def decode(value: str, strict: bool = False) -> str | None:
    """One scan from left to right, so that an escaped backslash never meets what follows it."""
    if value == NULL_MARK:
        return None

    def one(m: re.Match) -> str:
        found = _DECODED.get(m.group())
        if found is None:
            if strict:
                raise RskvError(f"unknown escape {m.group()}")
            return m.group()
        return found

    return _ESCAPE.sub(one, value)


def _unpacked(value: str | None, how: list[str]) -> str | None:
    """A value as its set's #ENCODE and #COMPRESS say: base64, then zlib or gzip."""
    import base64
    import zlib

    if value is None or not how:
        return value
    raw = base64.b64decode(value, validate=True)
    if any(h in ("zlib", "gzip", "deflate") for h in how):
        raw = zlib.decompress(raw, 47)
    return raw.decode()


# Directives that describe a set; they are kept with its metadata.
EXTENSIONS = ("INDEX", "ENCODE", "COMPRESS", "VALIDATE", "PROVENANCE", "ENCRYPT")


def records(lines, strict: bool = False, most_length: int | None = None, lax: bool = False):
    """(set, position, schema, meta, record) for each record; a record is a dict in which null,
    empty and missing stay apart.  Repeated sets append; unknown directives are skipped unless
    ``strict``.  ``#CONTINUE: key`` appends a line to a value of the record at hand.

    Directives of ``EXTENSIONS`` stand in the set's metadata; values of keys that #ENCODE names are
    unpacked, what an #ENCRYPT names stays as it is.  ``lax`` also takes "key=value" lines and records
    before any set, as a set without a name, and keeps what it cannot unpack."""
    name: str | None = None
    schema: dict[str, str] = {}
    meta: dict[str, str] = {}
    row: dict[str, str | None] = {}
    place: dict[str, int] = {}
    begun = False

    def close():
        nonlocal row
        if name is not None and row:
            at = place[name] = place.get(name, -1) + 1
            yield name, at, dict(schema), dict(meta), row
        row = {}

    for number, line in enumerate(lines):
        line = line.rstrip("\r\n")
        if number == 0:
            line = line.removeprefix("\ufeff")
            if lax:
                name = ""
        if most_length and len(line) > most_length:
            raise RskvError(f"line {number + 1} is too long")
        if line.startswith("#SET: "):
            yield from close()
            name, schema, meta, begun = line[6:].strip(), {}, {}, False
        elif line == "#ENDSET":
            yield from close()
            name = None
        elif name is None or not line:
            continue
        elif line == ROW_MARK:
            yield from close()
            begun = True
        elif line.startswith("#SCHEMA:"):
            if strict and begun:
                raise RskvError("schema after records")
            for part in line[8:].split(","):
                key, mark, kind = part.strip().partition(":")
                if mark:
                    schema[key.strip()] = kind.split(":")[0].strip()
        elif line.startswith("#META:"):
            key, _, value = line[6:].strip().partition(": ")
            meta[key.strip()] = value
        elif line.startswith("#") and (m := _EXTENSION.match(line)) and m.group(1) in EXTENSIONS:
            meta[m.group(1).lower()] = m.group(2)
        elif line.startswith("#CONTINUE: "):
            key, mark, value = line[11:].partition(": ")
            if mark and row.get(key.strip()) is not None:
                row[key.strip()] += "\n" + (decode(value, strict) or "")
        elif line.startswith("#") and ": " not in line:
            if strict:
                raise RskvError(f"unknown directive {line}")
        elif ": " in line or line.endswith(":"):
            key, _, value = line.partition(": ") if ": " in line else (line[:-1], "", "")
            key, begun = key.strip(), True
            if strict and key in row:
                raise RskvError(f"duplicate key {key}")
            how = [p.split(":")[1] for d in ("encode", "compress") for p in meta.get(d, "").replace(" ", "").split(",") if p.partition(":")[0] == key and ":" in p]
            row[key] = decode(value, strict)
            try:
                row[key] = _unpacked(row[key], how)
            except ValueError as e:
                if strict:
                    raise RskvError(f"cannot unpack {key}: {e}") from e
        elif lax and "=" in line:
            key, _, value = line.partition("=")
            row[key.strip()] = decode(value.strip())
    yield from close()


def invalid(record: dict, rules: str) -> list[str]:
    """Keys that break a set's #VALIDATE rules: "key:required" or "key:/pattern/", by commas."""
    out = []
    for rule in filter(None, map(str.strip, rules.split(","))):
        key, _, test = rule.partition(":")
        value = record.get(key)
        if test == "required" and value is None or test[:1] == test[-1:] == "/" and value is not None and not re.fullmatch(test[1:-1], value):
            out.append(key)
    return out


class RskvSource(DataSource):
    """``spark.read.format("rskv").option("paths", "a.rskv,b.rskv").load()``; option mode: permissive,
    strict or lax.  Files are read line by line, where executors can open their paths; other files go
    through ``parse_column``."""

    @classmethod
    def name(cls) -> str:
        return "rskv"

    def schema(self) -> str:
        return "file string, set string, position bigint, declared map<string,string>, meta map<string,string>, record map<string,string>"

    def reader(self, schema):
        return _Reader(self.options)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in (options.get("paths") or options.get("path") or "").split(",") if p]
        self.mode = options.get("mode", "permissive")

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        with open(partition.path, encoding="utf-8", newline="\n") as lines:
            for row in records(lines, self.mode == "strict", lax=self.mode == "lax"):
                yield (partition.path, *row)


_RECORDS = "array<struct<set:string,position:bigint,declared:map<string,string>,meta:map<string,string>,record:map<string,string>>>"


def parse_column(text: Column, mode: str = "permissive") -> Column:
    """Records of whole texts, for files that only Spark can open: read them with
    ``spark.read.text(path, wholetext=True)``."""

    @F.pandas_udf(_RECORDS)
    def parse(values: pd.Series) -> pd.Series:
        read = lambda t: [dict(zip(("set", "position", "declared", "meta", "record"), r)) for r in records(t.split("\n"), mode == "strict", lax=mode == "lax")]
        return values.map(lambda t: [] if t is None else read(t))

    return parse(text)


def read_files(spark: SparkSession, path: str, mode: str = "permissive") -> DataFrame:
    """Records of all files under a path that Spark can open: file, set, position, declared, meta,
    record."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.select("file", F.explode(parse_column(F.col("value"), mode)).alias("r")).select("file", "r.*")


def declared_types(rows: DataFrame, name: str) -> dict[str, str]:
    """Columns of a set and their types, as its first record declares them, by name; keys without a
    type come after and are text.  One row reaches the driver."""
    first = rows.where(F.col("set") == name).agg(F.min_by(F.struct("declared", F.map_keys("record").alias("keys")), "position").alias("f")).first()["f"]
    told = {} if first is None else first["declared"] or {}
    return {} if first is None else {k: told.get(k, "str") for k in [*sorted(told), *sorted(set(first["keys"]) - set(told))]}


def as_table(rows: DataFrame, name: str) -> DataFrame:
    """One set as a table with the columns that it declares."""
    return typed(rows.where(F.col("set") == name), declared_types(rows, name)).drop("set", "record")


def stream_lines(spark: SparkSession, path: str, schema: str = "value string") -> DataFrame:
    """Files as they arrive, for incremental reading: each whole, parsed like any other text."""
    raw = spark.readStream.schema(schema).text(path, wholetext=True)
    return raw.select(F.explode(parse_column(F.col("value"))).alias("r")).select("r.*")


def typed(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns of records by declared types; what cannot be read as its type is null, and its raw
    text stays in ``record``."""
    out = []
    for key, kind in columns.items():
        raw = F.col("record")[key]
        out.append((F.unbase64(raw) if kind == "base64" else raw if kind in ("str", "json") else raw.try_cast(TYPES.get(kind, "string"))).alias(key))
    return rows.select("set", "position", *out, "record")


def encode(value: Column) -> Column:
    """Escapes a value; null becomes the null mark."""
    text = value.cast("string")
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), (ROW_MARK, "\\" + ROW_MARK)):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.when(F.startswith(text, F.lit("#")), F.concat(F.lit("\\"), text)).otherwise(text)
    return F.coalesce(text, F.lit(NULL_MARK))


def lines(df: DataFrame) -> DataFrame:
    """One text per row: its cells between row marks."""
    cells = [F.concat(F.lit(f"{c}: "), encode(F.col(c))) for c in df.columns]
    return df.select(F.concat_ws("\n", F.lit(ROW_MARK), *cells).alias("value"))


def write(df: DataFrame, name: str, path: str) -> None:
    """Part files that are each a whole document: the set's header leads every part."""
    kinds = {"bigint": "int", "int": "int", "double": "float", "float": "float", "boolean": "bool", "date": "date", "timestamp": "datetime"}
    schema = ", ".join(f"{c}:{kinds.get(t, 'str')}" for c, t in df.dtypes)
    head = f"#SET: {name}\n#SCHEMA: {schema}"

    def led(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            values = batch.column(0).to_pylist()
            if first and values:
                values[0] = f"{head}\n{values[0]}"
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])

    lines(df).mapInArrow(led, "value string").write.text(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RskvSource)

