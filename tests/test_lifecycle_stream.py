"""Event states kept by timers, and late rows set aside."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsengine.streaming import lifecycle, stages

T0 = datetime(2024, 1, 1)
LINK = "event_id string, link_action string, ts timestamp"


def at(**kw):
    return T0 + timedelta(**kw)


@pytest.fixture
def rocks(spark):
    spark.conf.set(*lifecycle.ROCKS)
    yield spark
    spark.conf.unset(lifecycle.ROCKS[0])


def feed(spark, path, rows):
    spark.createDataFrame(rows, LINK).coalesce(1).write.mode("append").parquet(path)


def test_events_publish_and_close_by_timers(rocks, tmp_path):
    spark, path, out = rocks, str(tmp_path / "in"), str(tmp_path / "out")
    changes = lambda: sorted((r.event_id, r.at, r.old_state, r.state, r.articles) for r in spark.read.parquet(out).collect())

    def step():
        put = lambda df, k: df.write.mode("append").parquet(out)
        made = lifecycle.event_changes(spark.readStream.schema(LINK).parquet(path))
        made.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    feed(spark, path, [("a", "TRIGGER_CREATE", at()), ("b", "TRIGGER_CREATE", at(minutes=1)), ("a", "LINKED_EXISTING", at(hours=2))])
    step()
    pending = [("a", at(), "DETECTED", "PENDING_PUBLISH", 1), ("b", at(minutes=1), "DETECTED", "PENDING_PUBLISH", 1)]
    published = [("a", at(minutes=5), "PENDING_PUBLISH", "PUBLISHED", 2), ("b", at(minutes=6), "PENDING_PUBLISH", "PUBLISHED", 1)]
    assert changes() == sorted(pending + published)
    feed(spark, path, [("c", "TRIGGER_CREATE", at(days=7, hours=2)), ("a", "LINKED_EXISTING", at(days=5))])
    step()
    b_closed = ("b", at(days=7, minutes=1), "PUBLISHED", "CLOSED", 1)
    assert b_closed in changes() and not [c for c in changes() if c[0] == "a" and c[3] == "CLOSED"]
    feed(spark, path, [("d", "TRIGGER_CREATE", at(days=30))])
    step()
    closed = {c[0]: (c[1], c[4]) for c in changes() if c[3] == "CLOSED"}
    assert closed == {"a": (at(days=12), 3), "b": (at(days=7, minutes=1), 1), "c": (at(days=14, hours=2), 1)}


def test_on_time_and_late_rows_add_up(spark, tmp_path):
    path, out, side = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "side")
    put = lifecycle.without_late(stages.stage_sink(lambda b: b, out, ["event_id"]), side, 3_600_000)

    def step(rows):
        feed(spark, path, rows)
        spark.readStream.schema(LINK).parquet(path).writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    step([("a", "x", at(hours=10)), ("b", "x", at(hours=1)), ("n", "x", None)])  # nothing came before: only the row without a time is late
    step([("c", "x", at(hours=9)), ("d", "x", at(hours=8, minutes=59)), ("e", "x", at(hours=20))])
    step([("f", "x", at(hours=12)), ("g", "x", at(hours=19))])
    on_time = {r.event_id for r in spark.read.parquet(out).collect()}
    late = {(r.event_id, r.batch) for r in spark.read.parquet(f"{side}/late").collect()}
    assert on_time == set("abceg") and late == {("n", 0), ("d", 1), ("f", 2)}
    again = spark.createDataFrame([("f", "x", at(hours=12)), ("g", "x", at(hours=19))], LINK)
    put(again, 2)  # a batch that runs again
    assert spark.read.parquet(out).count() == 5 and spark.read.parquet(f"{side}/late").count() == 3
    assert spark.read.parquet(out).count() + spark.read.parquet(f"{side}/late").count() == spark.read.parquet(path).count()


def test_rows_with_a_day_are_laid_out_by_it(spark, tmp_path):
    out = str(tmp_path / "out")
    put = stages.stage_sink(lambda b: b.withColumn("sink_day", F.to_date("ts")), out, ["event_id"])
    for k in range(3):
        put(spark.createDataFrame([(f"e{k}", "x", at(days=k)), ("e0", "x", at(days=k))], LINK), k)
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == ["e0", "e1", "e2"]
    plan = spark.read.parquet(out).where(F.col("sink_day") >= "2024-01-03")
    assert plan.count() == 1 and len(plan.inputFiles()) <= 3
