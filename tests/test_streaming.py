from __future__ import annotations

import random
from datetime import datetime, timedelta

from keyloom.operators import folds, state
from keyloom.sources import logs
from keyloom.streaming import apply


def mutations(n, first=0):
    r = random.Random(n)
    return [(1, first + k, 0, r.choice(["put", "delete", "put"]), 1, r.randrange(15), f"v{first + k}", 1, 1, 1) for k in range(n)]


def test_stream_equals_batch_however_it_is_cut(spark, tmp_path):
    path, at, marks = (f"file://{tmp_path}/{n}" for n in ("log", "state", "marks"))
    everything = []
    for part in range(3):
        rows = mutations(40 + part, 100 * part)
        everything += rows
        logs.append(spark.createDataFrame(rows, logs.LOG), path)
        apply.run_fold(logs.stream(spark, path, 1), at, marks).awaitTermination()
    want = state.fold(spark.createDataFrame(everything, logs.LOG), ["term", "idx", "ordinal"], ["keyspace_id", "key"]).collect()
    assert sorted(map(tuple, apply.read_state(spark, at).collect())) == sorted(map(tuple, want))


def test_repeated_batch_changes_nothing(spark, tmp_path):
    at = f"file://{tmp_path}/state"
    step = apply.fold_batch(at)
    rows = spark.createDataFrame(mutations(30), logs.LOG)
    step(rows, 0)
    first = sorted(map(tuple, apply.read_state(spark, at).collect()))
    step(rows, 0)
    step(rows, 1)  # the same positions again
    assert sorted(map(tuple, apply.read_state(spark, at).collect())) == first


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    at = f"file://{tmp_path}/state"
    step = apply.fold_batch(at)
    rows = [(1, k, 0, "put", 1, k, "v", 1, 1, 1) for k in range(500)]
    step(spark.createDataFrame(rows, logs.LOG), 0)
    step(spark.createDataFrame([(1, 900, 0, "put", 1, 7, "new", 1, 1, 1), (1, 901, 0, "delete", 1, 8, None, 1, 1, 1)], logs.LOG), 1)
    assert len(list((tmp_path / "state" / "batch=000000000000").glob("bucket=*"))) > 50
    assert len(list((tmp_path / "state" / "batch=000000000001").glob("bucket=*"))) <= 2
    got = {r.key: r.value for r in apply.read_state(spark, at).collect()}
    assert got == {k: "new" if k == 7 else "v" for k in range(500) if k != 8}


def test_token_bucket_stream_equals_batch(spark, tmp_path):
    r = random.Random(1)
    rows = sorted((r.randrange(3), k * 1000 + r.randrange(900), k, r.randrange(1, 4)) for k in range(90))
    schema = "tenant long, ts_us long, request_id long, cost long"
    for part in range(3):
        spark.createDataFrame([x for x in rows if x[2] // 30 == part], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = apply.token_bucket_stream(read, 5, 3).writeStream.format("memory").queryName("buckets").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    want = folds.token_bucket(spark.createDataFrame(rows, schema), 5, 3).collect()
    assert sorted(tuple(x) for x in spark.table("buckets").collect()) == sorted(tuple(x) for x in want)


def test_expiry_timers(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    schema = "key long, value string, at timestamp, expires_at timestamp"
    s = lambda n: t0 + timedelta(seconds=n)
    parts = [[(1, "a", s(1), s(5)), (2, "b", s(1), s(5)), (3, "c", s(1), None)], [(2, "b2", s(2), s(500))], [(9, "z", s(100), None)], [(9, "z", s(101), None)]]
    (tmp_path / "in").mkdir()
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        q = apply.expire_stream(read).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    got = [(r.key, r.value) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()]
    assert got == [(1, "a")]
