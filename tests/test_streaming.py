from datetime import datetime, timedelta

from pyspark.sql import functions as F

from claimloom.streaming import messages as M

T0 = datetime(2024, 1, 1)


def run(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def source(spark, rows, schema, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_admission(spark):
    rows = [("a", "INFORM", None, T0), ("b", "INFORM", T0, T0 + timedelta(hours=1)), ("c", "ACCEPT", T0, T0 + timedelta(hours=1))]
    df = spark.createDataFrame(rows, "id string, act string, expires_at timestamp, received_at timestamp").withColumn("deadline", F.lit(None).cast("timestamp"))
    assert {r.id: r.admission for r in M.admit(df).collect()} == {"a": "ADMIT", "b": "EXPIRED", "c": "AUDIT_ONLY"}


def test_replays(spark, tmp_path):
    rows = [("s", "n1", T0), ("s", "n1", T0 + timedelta(minutes=1)), ("t", "n1", T0), ("s", "n2", T0)]
    got = run(spark, M.without_replays(source(spark, rows, "sender string, nonce string, created_at timestamp", tmp_path)), tmp_path, "replays")
    assert sorted((r.sender, r.nonce) for r in got) == [("s", "n1"), ("s", "n2"), ("t", "n1")]


def test_states(spark, tmp_path):
    acts = {"x": ["PROPOSE", "ACCEPT", "EXECUTE", "CONFIRM"], "y": ["PROPOSE", "EXECUTE"], "z": ["PROPOSE", "REFUSE", "ACCEPT"]}
    rows = [(t, f"{t}{i}", a, T0 + timedelta(minutes=i)) for t, seq in acts.items() for i, a in enumerate(seq)]
    got = run(spark, M.conversation_states(source(spark, rows, "thread_id string, message_id string, transition string, created_at timestamp", tmp_path)), tmp_path, "states")
    by = {r.message_id: r for r in got}
    assert by["x3"].state == "CONFIRM" and all(by[f"x{i}"].legal for i in range(4))
    assert by["y1"].state == "ERROR" and not by["y1"].legal
    assert by["z2"].state == "REFUSE" and not by["z2"].legal


def test_counts(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=m), "a") for m in (1, 2, 70)]
    got = run(spark, M.windowed_counts(source(spark, rows, "ts timestamp_ntz, k string", tmp_path), "ts", "k"), tmp_path, "counts", "complete")
    assert sorted(r.n for r in got) == [1, 2]


def test_snapshot(spark, tmp_path):
    sink = M.snapshot_sink(str(tmp_path / "snap"), ["k"], "at")
    sink(spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 5, 1)], "k string, v int, at int"), 0)
    sink(spark.createDataFrame([("a", 3, 3), ("b", 4, 0)], "k string, v int, at int"), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "snap" / "v=1")).select("k", "v").collect())) == [("a", 3), ("b", 5)]


def test_batches_meet_the_table_of_their_time(spark, tmp_path):
    step = M.against_current(str(tmp_path / "lexicon"), ["k"], str(tmp_path / "out"))
    batch = spark.createDataFrame([("a",), ("b",)], "k string")
    for epoch, name in ((0, "old"), (1, "new")):
        spark.createDataFrame([("a", name)], "k string, sense string").write.mode("overwrite").parquet(str(tmp_path / "lexicon"))
        for _ in range(2):  # a repeated batch changes nothing
            step(batch, epoch)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.v, r.k, r.sense) for r in got) == [(0, "a", "old"), (0, "b", None), (1, "a", "new"), (1, "b", None)]
