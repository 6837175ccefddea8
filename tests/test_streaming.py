from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from surveyloom.operators.feedback import latest_per_event
from surveyloom.streaming.feedback import MAX_ATTEMPTS, AppendSink, retry_candidates, start_append

SCHEMA = "client_key string, event_id string, rating string, created_at timestamp"
TEXT_SCHEMA = "client_key string, event_id string, rating string, created_at string"
START = datetime(2024, 1, 1)


def _deliver(spark, base, sink, rows, schema=SCHEMA, files=1):
    spark.createDataFrame(rows, schema).repartition(files).write.mode("append").parquet(f"{base}/inbox")
    stream = spark.readStream.schema(schema).parquet(f"{base}/inbox")
    start_append(stream, sink, F.col("rating").isin("up", "down")).awaitTermination()


def _sink(tmp_path):
    base = str(tmp_path)
    return base, AppendSink(f"{base}/table", f"{base}/bad", f"{base}/ck", source_app="survey")


def at(hours):
    return START + timedelta(hours=hours)


def test_append_is_idempotent_and_isolates_bad_rows(spark, tmp_path):
    base, sink = _sink(tmp_path)
    good, bad = ("a", "e1", "up", at(0)), ("z", "e9", "broken", at(0))
    keyless = (None, "e2", "down", at(0))
    _deliver(spark, base, sink, [good, good, bad, keyless, keyless], files=3)
    _deliver(spark, base, sink, [("b", "e3", "up", at(100)), good])
    _deliver(spark, base, sink, [("c", "e4", "up", at(200)), ("a", "e1", "up", at(200)), bad])
    stored = spark.read.parquet(sink.table)
    assert sorted((r["client_key"] or "", r["event_id"]) for r in stored.collect()) == [
        ("", "e2"), ("", "e2"), ("a", "e1"), ("b", "e3"), ("c", "e4")]
    assert {r["source_app"] for r in stored.collect()} == {"survey"}
    tries = spark.read.parquet(sink.quarantine).filter("client_key = 'z'").agg(F.max("attempts")).first()[0]
    assert tries == 2 and retry_candidates(spark.read.parquet(sink.quarantine)).count() == 1
    _deliver(spark, base, sink, [("z", "e9", "broken", at(200 + h)) for h in range(MAX_ATTEMPTS - 2)])
    assert spark.read.parquet(sink.quarantine).filter("client_key = 'z' and dropped").count() >= 1
    assert retry_candidates(spark.read.parquet(sink.quarantine)).count() == 0


def test_late_rows_are_judged_by_their_key_alone(spark, tmp_path):
    base, sink = _sink(tmp_path)
    _deliver(spark, base, sink, [("a", "e1", "up", at(10_000))])
    _deliver(spark, base, sink, [("late", "e2", "up", at(0)), ("a", "e1", "up", at(1))], files=2)
    stored = spark.read.parquet(sink.table).collect()
    assert sorted((r["client_key"], r["created_at"]) for r in stored) == [("a", at(10_000)), ("late", at(0))]


def test_rows_without_a_readable_time_are_kept_apart_with_their_text(spark, tmp_path):
    base, sink = _sink(tmp_path)
    _deliver(spark, base, sink, [("a", "e1", "up", "2024-01-01 00:00:00"), ("m", "e2", "up", "yesterday"), ("n", "e3", "up", None)], TEXT_SCHEMA)
    _deliver(spark, base, sink, [("m", "e2", "up", "2024-01-02 00:00:00"), ("n", "e3", "up", None)], TEXT_SCHEMA)
    assert sorted(r["client_key"] for r in spark.read.parquet(sink.table).collect()) == ["a", "m"]
    bad = spark.read.parquet(sink.quarantine)
    assert sorted(((r["client_key"], r["created_at_raw"] or "", r["attempts"]) for r in bad.collect())) == [
        ("m", "yesterday", 1), ("n", "", 1), ("n", "", 2)]


def test_a_batch_that_failed_before_its_first_file_is_taken_up_again(spark, tmp_path):
    base, sink = _sink(tmp_path)
    for folder in (sink.table, sink.quarantine):
        (tmp_path / folder.rsplit("/", 1)[1]).mkdir()
    _deliver(spark, base, sink, [("a", "e1", "up", at(0)), ("z", "e9", "broken", at(0))])
    assert spark.read.parquet(sink.table).count() == 1 and spark.read.parquet(sink.quarantine).count() == 1


@pytest.mark.parametrize("times, newest", [((None, None), "b"), ((1, None), "a"), ((2, 2), "b"), ((1, 2), "b")])
def test_latest_row_survives_missing_times_and_ties(spark, times, newest):
    rows = [("e", t, v) for t, v in zip(times, "ab", strict=True)]
    found = latest_per_event(spark.createDataFrame(rows, "event_id string, created_at int, v string")).collect()
    assert [(r["event_id"], r["v"]) for r in found] == [("e", newest)]


def test_a_key_that_most_rows_have_and_ties(spark, tmp_path):
    base, sink = _sink(tmp_path)
    hot = [("hot", f"e{i}", "up", at(50 - i % 50)) for i in range(5000)] + [("hot", "x", "broken", at(9))] * 3
    _deliver(spark, base, sink, hot + [("z", "e", "broken", at(3)), ("z", "f", "broken", at(1))], files=4)
    stored = spark.read.parquet(sink.table).collect()
    assert [(r["client_key"], r["created_at"]) for r in stored] == [("hot", at(1))]
    bad = spark.read.parquet(sink.quarantine).select("client_key", "event_id", "attempts", "dropped").collect()
    assert sorted(map(tuple, bad)) == [("hot", "x", 3, False), ("z", "f", 2, False)]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    base, sink = _sink(tmp_path)
    _deliver(spark, base, sink, [("a", "e1", "up", at(0)), ("z", "e9", "broken", at(0))])
    _deliver(spark, base, sink, [("b", "e2", "up", at(1)), ("a", "e1", "up", at(0)), ("z", "e9", "broken", at(0))])
    before = sorted(map(tuple, spark.read.parquet(sink.table).collect()), key=repr), sorted(map(tuple, spark.read.parquet(sink.quarantine).collect()), key=repr)
    commits = tmp_path / "ck" / "commits"
    for name in ("1", ".1.crc"):  # as if the engine had failed between writing the batch and noting it
        (commits / name).unlink(missing_ok=True)
    _deliver(spark, base, sink, [("c", "e3", "up", at(2)), ("b", "e2", "up", at(2))])
    table = spark.read.parquet(sink.table)
    assert sorted(r["client_key"] for r in table.collect()) == ["a", "b", "c"]
    assert sorted(map(tuple, table.filter("batch < 2").collect()), key=repr) == before[0]
    assert sorted(map(tuple, spark.read.parquet(sink.quarantine).filter("batch < 2").collect()), key=repr) == before[1]


def test_a_batch_reads_nothing_that_earlier_ones_wrote(spark, tmp_path):
    base, sink = _sink(tmp_path)
    for i in range(4):
        _deliver(spark, base, sink, [(f"k{i}", "e", "up", at(i)), ("k0", "e", "up", at(0)), ("z", "e", "broken", at(0))])
        if i:  # the tables are gone, and still every key is known
            import shutil

            shutil.rmtree(sink.table)
            shutil.rmtree(sink.quarantine)
    _deliver(spark, base, sink, [(f"k{i}", "e", "up", at(9)) for i in range(5)] + [("z", "e", "broken", at(9))])
    assert [r["client_key"] for r in spark.read.parquet(sink.table).collect()] == ["k4"]
    assert [(r["attempts"], r["dropped"]) for r in spark.read.parquet(sink.quarantine).collect()] == [(5, True)]


def test_names_that_the_append_needs(spark, tmp_path):
    base, sink = _sink(tmp_path)
    with pytest.raises(ValueError, match="attempts"):
        _deliver(spark, base, sink, [("a", "e", "up", at(0), 1)], f"{SCHEMA}, attempts int")
