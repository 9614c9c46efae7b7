"""The cleaner's memory as a stream: keys, timers and a restart, against a plain loop and against the batch form."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kindred.operators import state
from kindred.streaming import cleaning

START = datetime(2024, 1, 1)
SCHEMA = "key string, at timestamp, event string, reason string, extra int"


def loop(events, watermark):
    """The rules of the docstring, event by event in the order of time (goings before listings of the same time)."""
    order = {"gone": 0, "listed": 1, "released": 2, "held": 3, "failed": 4}
    out = {}
    for key in {e[0] for e in events}:
        first, held, failed = None, False, {}
        for _, at, event, reason in sorted((e[:4] for e in events if e[0] == key), key=lambda e: (e[1], order[e[2]])):
            if event == "gone":
                first, held, failed = None, False, {}
            elif event == "listed":
                first = first or at
            elif first is not None and event in ("held", "released"):
                held = event == "held"
            elif first is not None and event == "failed":
                failed[reason] = at
        live = [r for r, at in failed.items() if at + timedelta(days=1) > watermark]
        out[key] = (first, held, max(live, default=None))
    return out


def batches(seed):
    """Runs 7 hours apart; each lists every key once, so that what is told of a key follows its listing."""
    rng = random.Random(seed)
    for run in range(9):
        at, rows = START + timedelta(hours=7 * run), []
        for k in "abcdefgh":
            there = rng.random() < 0.8
            rows.append((k, at, "listed" if there else "gone", None, 1))
            if there and rng.random() < 0.4:
                rows.append((k, at + timedelta(minutes=1), "failed", rng.choice(["in use", "no room"]), 1))
            if there and rng.random() < 0.3:
                rows.append((k, at + timedelta(minutes=rng.randrange(2, 9)), rng.choice(["held", "released"]), None, 1))
        rng.shuffle(rows)
        yield rows


@pytest.fixture
def few(spark):
    """Few partitions: each has a worker and a store of its own in every batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run(spark, source, folder):
    """One start of the stream, over what is new: each start goes on from the checkpoint of the last."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)

    def put(rows, number):
        rows.withColumn("n", F.lit(number)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    cleaning.memory(stream).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()


def latest(spark, folder):
    found = {}
    for r in sorted(spark.read.parquet(f"{folder}/out").collect(), key=lambda r: (r.n, r.failed is None)):
        found[r.key] = r
    return found


def test_memory_over_restarts_equals_the_loop_and_the_batch_form(spark, few, tmp_path):
    source, everything = str(tmp_path / "in"), []
    for number, rows in enumerate(batches(3)):
        everything += rows
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if number in (2, 5):
            run(spark, source, str(tmp_path))  # stops and starts again: state and timers come from the checkpoint
    # long after: one more key, twice, so that the watermark passes all failures but those of the last day
    end = START + timedelta(hours=7 * 8 + 20)
    for minutes in (0, 1):
        tail = [("z", end + timedelta(minutes=minutes), "listed", None, 1)]
        everything += tail
        spark.createDataFrame(tail, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run(spark, source, str(tmp_path))
    watermark = end + timedelta(minutes=1)
    got = {k: (r.first_seen, r.held, r.failed) for k, r in latest(spark, str(tmp_path)).items()}
    want = loop(everything, watermark)
    assert got == want
    assert any(v[2] for v in want.values()) and any(e[2] == "failed" and not want[e[0]][2] and want[e[0]][0] for e in everything)

    # the batch form on the same events: observed() run by run, then plan() with the failures since each key was first seen
    seen = spark.createDataFrame([], "key string, first_seen timestamp")
    times = sorted({e[1] for e in everything if e[2] in ("listed", "gone") and e[0] != "z"})
    for at in times:
        listed = spark.createDataFrame([(e[0],) for e in everything if e[1] == at and e[2] == "listed"], "key string")
        seen = spark.createDataFrame(state.observed(seen, listed, F.lit(at)).collect(), "key string, first_seen timestamp")
    failures = [(e[0], e[1], e[3]) for e in everything if e[2] == "failed" and want[e[0]][0] and e[1] >= want[e[0]][0]]
    failed = spark.createDataFrame(failures, "key string, at timestamp, reason string")
    sets = seen.select("key", F.lit(None).cast("string").alias("barred_by"))
    held = spark.createDataFrame([(k,) for k, v in want.items() if v[1]], "key string")
    planned = {r.key: r.reason for r in state.plan(sets, seen, held, failed, None, 30, F.lit(watermark)).collect()}
    assert {r.key: r.first_seen for r in seen.collect()} == {k: v[0] for k, v in got.items() if v[0] and k != "z"}
    assert planned == {k: v[2] and f"could not be moved: {v[2]}" for k, v in got.items() if v[0] and k != "z"}


def test_one_batch_in_any_order_with_nulls_and_unknown_events(spark, few, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    rows = [("a", at(h), "listed", None, 0) for h in (1, 2, 3, 5, 6)] + [("a", at(4), "gone", None, 0), ("a", at(2), "failed", "old", 0), ("a", at(6), "failed", "new", 0), ("a", at(2), "held", None, 0)]
    rows += [("b", at(1), "failed", "never listed", 0), ("b", at(1), "held", None, 0), ("c", at(3), "listed", None, 0), ("c", at(3), "gone", None, 0), ("c", at(3), "failed", None, 0)]
    rows += [(None, at(1), "listed", None, 0), ("d", None, "listed", None, 0), ("d", at(1), "what", None, 0), ("d", at(1), None, None, 0)]
    random.Random(5).shuffle(rows)
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(source)
    run(spark, source, str(tmp_path))
    got = {k: (r.first_seen, r.held, r.failed, r.listed) for k, r in latest(spark, str(tmp_path)).items()}
    assert got == {"a": (at(5), False, "new", True), "b": (None, False, None, False), "c": (at(3), False, "", True)}
