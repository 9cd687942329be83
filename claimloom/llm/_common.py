"""Shared plumbing: written tables that cut lineage, Arrow helpers, distributed ranks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_DIR: str | None = None


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of fewer rows for this session: whole texts make batches large, and each
    stage of Python work holds some in the JVM and in its worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only where none is set."""
    global _OWN_DIR
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="claimloom-")
    return f"file://{_OWN_DIR}"


_TABLES: list[str] = []
_CATALOG: dict[str, str] = {}


def written(df: DataFrame, name: str, free: bool = False, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends here, and
    the rows survive the loss of any executor.  ``free`` lets Spark delete the shuffle files that
    only this table needed; ``keep`` leaves it out of ``tables``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    if free:
        # shuffle files go when the driver's garbage collector meets their owners
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._claimloom_path = path
    if not keep:
        _TABLES.append(path)
    return out


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` written once in buckets of ``key``, one for each shuffle partition: joins on ``key``
    then move only their other side.  A table of the session's catalog until ``dropped``."""
    spark = df.sparkSession
    parts = shuffle_parts(spark)
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.repartition(parts, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, key).saveAsTable(table)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.table(table)
    out._claimloom_path = path
    _CATALOG[path] = table
    _TABLES.append(path)
    return out


def one_per_document(df: DataFrame, id_col: str, text_col: str, own: str) -> DataFrame:
    """``df`` with a column ``own``, the number of each document in the order of ids.  Rows with one
    id and one text are one document.  Ids serve as they are unless one is null or stands on
    different texts; then documents are numbered by id and text hash, and each row with a null id is
    a document of its own, after all others."""
    hashed = df.withColumn("_h", F.xxhash64(F.coalesce(text_col, F.lit(""))))
    odd = hashed.groupBy(F.col(id_col).alias("_id")).agg((F.min("_h") != F.max("_h")).alias("differ")).where("_id IS NULL OR differ")
    if not odd.limit(1).count():
        return df.withColumn(own, F.col(id_col).cast("long"))
    alone = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).otherwise(0)
    rows = written(hashed.withColumn("_own", alone).withColumn("_last", F.col(id_col).isNull().cast("int")).withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.lit(0))), "rows")
    key = ["_last", "_id", "_h", "_own"]
    ranks, _ = group_ranks(rows.select(F.lit(0).alias("_all"), *key).distinct(), "_all", key, "numbers")
    return rows.join(ranks.drop("_all"), key).withColumn(own, F.col("rank")).select(*df.columns, own)


def one_per_row(df: DataFrame, id_col: str, own: str) -> DataFrame:
    """``df`` with a column ``own`` that no two rows share: the id where ids do that, else a number
    given once, in a written table."""
    odd = df.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_id IS NULL OR _n > 1")
    if not odd.limit(1).count():
        return df.withColumn(own, F.col(id_col).cast("long"))
    return written(df.withColumn(own, F.monotonically_increasing_id()), "rows")


def _delete(spark: SparkSession, path: str) -> None:
    if path in _CATALOG:
        spark.sql(f"DROP TABLE IF EXISTS {_CATALOG.pop(path)}")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    path = getattr(df, "_claimloom_path", None)
    if path:
        _delete(df.sparkSession, path)
        if path in _TABLES:
            _TABLES.remove(path)


def tables() -> set[str]:
    """The tables that operators have written and that still stand."""
    return set(_TABLES)


def drop_unread(df: DataFrame, paths: set[str]) -> set[str]:
    """Delete those of the tables ``paths`` that ``df`` does not read; returns the others."""
    files = df.inputFiles() if paths else []
    read = {p for p in paths if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in files)}
    for path in paths - read:
        if path in _TABLES:
            _delete(df.sparkSession, path)
            _TABLES.remove(path)
    return read


def shuffle_parts(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def col_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary Arrow column as (bytes, offsets); nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def byte_slices(offs: np.ndarray, most: int = 4 << 20):
    """Ranges of rows whose bytes together stay near ``most``: bounds the scratch arrays.  One
    row longer than that makes a range of its own, so no text is cut."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def even_keys(spark: SparkSession, n: int) -> np.ndarray:
    """Longs k_0 ... k_(n-1) such that ``repartition(n, column)`` sends k_i to partition i, so that
    n buckets fill n partitions one each."""
    found = spark.range(0, 16 * n + 64, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()  # n rows
    out = np.arange(n, dtype=np.int64) + 16 * n + 64
    for r in found:
        out[r["p"]] = r["id"]
    return out


def long_col(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def binary_rows(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """Slices of a NumPy array's bytes as a binary Arrow column; ``offs`` counts elements."""
    raw = np.ascontiguousarray(data)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offs) - 1, [None, pa.py_buffer((offs.astype(np.int64) * raw.itemsize)), pa.py_buffer(raw)]
    ).cast(pa.binary())


def record(schema_cols: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x for _, x in schema_cols], names=[n for n, _ in schema_cols])


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser over uint64 (public splitmix constants)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trim() -> None:
    """Hands this process's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(function):
    """The same Arrow function, after which the worker hands free memory back to the system: workers
    are reused, and what one task's scratch arrays held must not add to the next one's."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            trim()

    return run


GATHERED = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges (a, b) and the smallest vertex that each one reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        x, y = root[x], root[y]
        low, high = np.minimum(x, y), np.maximum(x, y)
        open_ = low != high
        x, y = low[open_], high[open_]
        np.minimum.at(root, y, x)
        while (root[root] != root).any():
            root = root[root]
    return ids, ids[root]


def contracted(edges: DataFrame, own: bool = False) -> DataFrame:
    """``edges`` (a, b) with those of each partition replaced by stars to the smallest vertex, which join
    the same vertices; with ``own`` each such centre is also given, as its own."""

    def run(batches):
        a = b = np.zeros(0, np.int64)
        fresh: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            fresh.append((long_col(batch, "a"), long_col(batch, "b")))
            if sum(len(x) for x, _ in fresh) > max(GATHERED, len(a)):  # stars bound what is held by the vertices
                a, b = roots(np.concatenate([a, *[x for x, _ in fresh]]), np.concatenate([b, *[y for _, y in fresh]]))
                fresh = []
        a, b = roots(np.concatenate([a, *[x for x, _ in fresh]]), np.concatenate([b, *[y for _, y in fresh]]))
        if not own:
            a, b = a[a != b], b[a != b]
        for i in range(0, len(a), 100_000):
            yield record([("a", pa.array(a[i : i + 100_000])), ("b", pa.array(b[i : i + 100_000]))])

    return edges.mapInArrow(lean(run), "a long, b long")


def min_components(edges: DataFrame, name: str, most_rounds: int = 200) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): columns id, component (smallest id).

    Each partition first turns its edges into stars, as they come and once more by vertex.  No more
    than GATHERED edges that remain are settled in one task.  More take large-star and small-star
    rounds over aggregates and joins; each round is written to the shared folder, and only a count
    reaches the driver.  Isolated vertices do not occur.
    """

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            both = both.where("v <= u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        linked = both.join(least, "u")
        if large:
            return linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        more = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        return linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(more).where("a <> b").distinct()

    def measure(e: DataFrame):
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    spark = edges.sparkSession
    near = contracted(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b"))
    now = written(contracted(near.repartition(shuffle_parts(spark), "a")), name, free=True)
    state = measure(now)
    if state[0] <= GATHERED:
        out = written(contracted(now.coalesce(1), own=True), name)
        dropped(now)
        return out.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        if not state[0]:
            break
        new = written(stars(stars(now, True), False), name, free=True)
        dropped(now)
        now, before, state = new, state, measure(new)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    own = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(own)


def group_ranks(df: DataFrame, key: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Add ``rank`` (0-based, by ``order`` within ``key``) without gathering a key in one task.

    Rows are range-partitioned by key and order, so that a hot key spans many partitions; each
    partition counts its own rows by key, and a prefix sum over those counts (a row for each
    partition and key) gives the offsets.  Returns the ranked rows and the written table.
    """
    spark = df.sparkSession
    fields = [f.name for f in df.schema.fields]
    parts = shuffle_parts(spark)
    laid = df.repartitionByRange(parts, F.col(key), *[F.col(c) for c in order]).sortWithinPartitions(key, *order)
    ki = fields.index(key)
    schema = T.StructType(df.schema.fields + [T.StructField("_pid", T.LongType()), T.StructField("_at", T.LongType())])

    def number(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last, seen = object(), 0
        for batch in batches:
            keys = batch.column(ki).to_pylist() if not pa.types.is_integer(batch.column(ki).type) or batch.column(ki).null_count else long_col(batch, fields[ki])
            n = len(keys)
            if not n:
                continue
            change = np.ones(n, bool)
            if isinstance(keys, np.ndarray):
                change[1:] = keys[1:] != keys[:-1]
            else:
                change[1:] = [keys[i] != keys[i - 1] for i in range(1, n)]
            change[0] = not (type(last) is not object and keys[0] == last)
            starts = np.flatnonzero(change)
            at = np.arange(n, dtype=np.int64)
            base = np.zeros(n, np.int64)
            if len(starts):
                base = np.where(np.cumsum(change) > 0, starts[np.maximum(np.cumsum(change) - 1, 0)], 0)
            at = at - base
            head = starts[0] if len(starts) else n
            at[:head] += seen
            seen = int(at[-1]) + 1
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, pid, np.int64)), pa.array(at)], names=[*fields, "_pid", "_at"])

    rows = written(laid.mapInArrow(lean(number), schema), name)
    from pyspark.sql import Window

    counts = rows.groupBy(F.col(key).alias("_k"), F.col("_pid").alias("_p")).agg(F.max("_at").alias("_n"))
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_k", "_p", F.coalesce(F.sum(F.col("_n") + 1).over(before), F.lit(0)).alias("_off"))
    ranked = rows.join(offsets, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_pid") == F.col("_p"))).select(*fields, (F.col("_at") + F.col("_off")).alias("rank"))
    return ranked, rows


def key_runs(batches, keys: list[str]):
    """Tables of whole runs of equal ``keys`` from sorted batches; a run may span batches.  Runs
    that end within a batch are handed out together as slices, so small groups stay cheap."""
    held: list[pa.RecordBatch] = []

    def same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
        return all(a.column(k)[i].as_py() == b.column(k)[j].as_py() for k in keys)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cut = np.zeros(n, bool)
        for k in keys:
            x = batch.column(k).to_numpy(zero_copy_only=False)
            cut[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(cut)
        if held and not same(held[-1], held[-1].num_rows - 1, batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        begin = 0
        for s in starts.tolist():
            held.append(batch.slice(begin, s - begin))
            yield pa.Table.from_batches(held)
            held, begin = [], s
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)
