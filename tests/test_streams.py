"""Keyed streams against the batch operators: any order of micro-batches, and after a restart."""

import random

from pyspark.sql import functions as F

from docquarry.operators import controller, results
from docquarry.streaming import keyed

RECORDS = "question bigint, line bigint, status string, score double, at timestamp"


def arrive(spark, rows, schema, folder, end):
    """Rows as files, a micro-batch each; ``end`` moves the watermark past all of them."""
    for i, part in enumerate([*rows, end]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")


def opened(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def at(seconds):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_last_good_record_of_a_stream(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(30), line, rng.choice(["F", "O", "P"]), line / 7, at(line)) for line in range(300)]
    batch = results.compact(spark.createDataFrame(rows, RECORDS), "question", "line", F.col("status") != "F")
    want = {(r.question, r.line, r.first_line, r.score) for r in batch.collect()}
    rng.shuffle(rows)
    folder = str(tmp_path / "in")
    stream = lambda: keyed.last_good(opened(spark, RECORDS, folder), "question", "line", F.col("status") != "F", "at", late="1 day")
    # the first half is drained, and the second goes on from the checkpoint
    arrive(spark, [rows[:70], rows[70:150]], RECORDS, f"{folder}/a", [(999, 0, "F", 0.0, at(0))])
    assert keyed.drain_appends(spark, stream(), str(tmp_path / "run")).count() == 0
    arrive(spark, [rows[150:210], rows[210:]], RECORDS, f"{folder}/b", [(998, 1000, "O", 0.0, at(90_000 * 10))])
    got = {(r.question, r.line, r.first_line, r.score) for r in keyed.drain_appends(spark, stream(), str(tmp_path / "run")).collect()}
    assert got == want and len(want) > 25


ACTIONS = "user_id bigint, page int, node int, ts timestamp, event_id bigint, action string, allowed boolean"


def test_state_machine_on_a_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(4), rng.randrange(3), rng.randrange(5), at(i // 2 * 2), i, rng.choice(["activate", "activate", "open", "prune", "look"]), rng.random() < 0.8) for i in range(400)]
    batch = controller.replay(spark.createDataFrame(rows, ACTIONS), ["user_id", "page"], ["ts", "event_id"], 5)
    want = {tuple(map(str, r)) for r in batch.select("user_id", "page", "states", "n_actions", "n_refused").collect()}
    # out of order by less than a minute, in five micro-batches
    rows.sort(key=lambda r: r[4] + rng.randrange(120))
    folder = str(tmp_path / "in")
    stream = lambda: keyed.state_machine(opened(spark, ACTIONS, folder), ["user_id", "page"], ["ts", "event_id"], 5, late="2 minutes")
    arrive(spark, [rows[:100], rows[100:200]], ACTIONS, f"{folder}/a", rows[200:260])
    some = keyed.drain_appends(spark, stream(), str(tmp_path / "run")).count()
    arrive(spark, [rows[260:330]], ACTIONS, f"{folder}/b", rows[330:])
    arrive(spark, [], ACTIONS, f"{folder}/c", [(-1, 0, 0, at(100_000), 10_000, "look", True)])
    got = keyed.drain_appends(spark, stream(), str(tmp_path / "run")).where("user_id >= 0")
    last = got.groupBy("user_id", "page").agg(F.max_by(F.struct("states", "n_actions", "n_refused"), "n_actions").alias("x")).select("user_id", "page", "x.*")
    assert {tuple(map(str, r)) for r in last.collect()} == want and len(want) == 12
    assert got.count() > some >= 0 and got.count() > len(want)  # states were given out on the way


def test_last_good_needs_no_calls_for_each_key(spark, tmp_path):
    """A stage of Spark's own; and a pause of a key ends its run, also where one micro-batch holds both sides of it."""
    rows = [(q, line, "O" if line % 3 else "F", line / 7, at(3 * 86_400 * (line // 100) + line)) for q in range(3) for line in range(200)]
    folder = str(tmp_path / "in")
    arrive(spark, [rows], RECORDS, folder, [(998, 1000, "O", 0.0, at(90_000 * 100))])
    stream = keyed.last_good(spark.readStream.schema(RECORDS).option("recursiveFileLookup", "true").parquet(folder), "question", "line", F.col("status") != "F", "at", late="1 day")
    assert "TransformWithState" not in stream._jdf.queryExecution().analyzed().toString()
    got = {(r.question, r.line, r.first_line, r.score) for r in keyed.drain_appends(spark, stream, str(tmp_path / "run")).collect()}
    assert got == {x for q in range(3) for x in [(q, 98, 1, 98 / 7), (q, 199, 100, 199 / 7)]}


def test_state_machine_with_all_pages_in_one_bucket(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(20), rng.randrange(3), rng.randrange(5), at(i), i, rng.choice(["activate", "open", "prune", "look"]), rng.random() < 0.8) for i in range(600)]
    batch = controller.replay(spark.createDataFrame(rows, ACTIONS), ["user_id", "page"], ["ts", "event_id"], 5)
    want = {tuple(map(str, r)) for r in batch.select("user_id", "page", "states", "n_actions", "n_refused").collect()}
    folder = str(tmp_path / "in")
    arrive(spark, [rows[:300], rows[300:]], ACTIONS, folder, [(-1, 0, 0, at(100_000), 10_000, "look", True)])
    stream = keyed.state_machine(opened(spark, ACTIONS, folder), ["user_id", "page"], ["ts", "event_id"], 5, late="1 minute", buckets=1)
    got = keyed.drain_appends(spark, stream, str(tmp_path / "run")).where("user_id >= 0")
    last = got.groupBy("user_id", "page").agg(F.max_by(F.struct("states", "n_actions", "n_refused"), "n_actions").alias("x")).select("user_id", "page", "x.*")
    assert {tuple(map(str, r)) for r in last.collect()} == want and len(want) == 60
