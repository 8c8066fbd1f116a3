import random
from collections import deque
from datetime import datetime, timedelta

from inkwarden.streaming import limiter


def greedy(rows, window, most):
    held, out = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        q = held.setdefault(k, deque())
        while q and (t - q[0]).total_seconds() > window:
            q.popleft()
        out[i] = len(q) < most
        if out[i]:
            q.append(t)
    return out


def requests():
    rng, start = random.Random(8), datetime(2024, 1, 1)
    return [(i, f"k{rng.randint(0, 3)}", start + timedelta(seconds=rng.randint(0, 600))) for i in range(400)]


def test_batch_limit(spark):
    rows = requests()
    df = spark.createDataFrame(rows, "event_id long, client string, ts timestamp")
    got = {r["event_id"]: r["accepted"] for r in limiter.limit(df, "client", window=60, most=5).collect()}
    assert got == greedy(rows, 60, 5) and not all(got.values())


def test_boundary_counts_the_request_exactly_a_window_old():
    assert limiter.admit([0.0, 60.0, 60.5], deque(), 60.0, 1) == [True, False, True]


def test_stream_limit(spark, tmp_path):
    rows = sorted(requests(), key=lambda r: (r[2], r[0]))
    schema = "event_id long, client string, ts timestamp"
    for n in range(4):
        spark.createDataFrame(rows[n * 100 : n * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}

    def sink(batch, _):
        got.update({r["event_id"]: r["accepted"] for r in batch.collect()})

    q = limiter.limit_stream(stream, "client", window=60, most=5).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and got == greedy(rows, 60, 5)

