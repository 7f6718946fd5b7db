"""Structured Streaming forms of the stages: keyed, watermarked, idempotent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsengine.functions import lexicons as L
from newsengine.operators import eventlog as E
from newsengine.operators.bias import FEATURES
from newsengine.sources.shared import checkpointed


def envelopes(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """Valid messages of a stream or table of JSON envelopes, with ts TIMESTAMP and payload JSON."""
    good, _ = E.quarantine(E.validate_envelope(raw, json_col))
    j = F.col(json_col)
    return good.select(E.field(j, "event_name").alias("event_name"), E.field(j, "event_id").alias("event_id"), F.to_timestamp(E.field(j, "occurred_at")).alias("ts"), E.field(j, "trace.trace_id").alias("trace_id"), E.field(j, "payload").alias("payload"))


def deduplicated(messages: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each message id once within the watermark; what comes again after a retry is dropped."""
    return messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def counters_per_slot(messages: DataFrame, slot: str = "30 minutes", delay: str = "1 hour", names: dict[str, str] | None = None) -> DataFrame:
    """Pipeline counters per tumbling slot; messages later than ``delay`` no longer count."""
    return E.pipeline_counters(messages.withWatermark("ts", delay), names, [F.window("ts", slot).alias("slot")])


def momentum(messages: DataFrame, window: str = "6 hours", slide: str = "30 minutes", delay: str = "1 hour", key: str = "key") -> DataFrame:
    """Messages per key in sliding windows."""
    return messages.withWatermark("ts", delay).groupBy(F.window("ts", window, slide).alias("window"), key).agg(F.count("*").alias("n"))


def closing_sessions(linked: DataFrame, quiet: str = "7 days", delay: str = "1 hour", key: str = "event_key") -> DataFrame:
    """Events whose session ended, with the end as the time of closing; in append mode each closes once."""
    s = linked.withWatermark("ts", delay).groupBy(F.session_window("ts", quiet).alias("session"), key).agg(F.count("*").alias("articles"))
    return s.select(key, F.col("session.start").alias("t0"), F.col("session.end").alias("closed_at"), "articles", F.lit("INACTIVITY_7D").alias("close_reason"))


PROFILE = T.StructType([T.StructField("media_id", T.StringType()), *[T.StructField(k, T.DoubleType()) for k in FEATURES], T.StructField("articles_processed", T.LongType())])


def running_profiles(means: DataFrame) -> DataFrame:
    """Running outlet profiles from rows (media_id, features, articles), one state per outlet.

    Rows of a batch are folded in the order of their ``ord`` column: 0.7 of the
    history and 0.3 of each row. The updated profile of every touched outlet
    is emitted. State is a fixed number of values per outlet.
    """
    state_type = T.StructType(PROFILE.fields[1:])

    def fold(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        for row in pd.concat(list(rows)).sort_values("ord").itertuples():
            fresh = [float(getattr(row, k)) for k in FEATURES]
            if now is None:
                now = [*fresh, int(row.articles)]
            else:
                now = [*[L.HISTORY_SHARE * a + (1 - L.HISTORY_SHARE) * b for a, b in zip(now[:-1], fresh, strict=True)], now[-1] + int(row.articles)]
        state.update(tuple(now))
        yield pd.DataFrame([[str(key[0]), *now]], columns=PROFILE.names)

    return means.groupBy("media_id").applyInPandasWithState(fold, PROFILE, state_type, "update", "NoTimeout")


#: Parts of a sink by key; a batch reads only the parts that it has keys in.
SINK_PARTS = 256


def written(spark: SparkSession, path: str) -> bool:
    """Whether a sink has any committed file."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def stage_sink(stage: Callable[[DataFrame], DataFrame], path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: apply the stage, append what is new by ``keys``.

    A batch that runs again after a failure finds its rows there and appends
    none, so the sink holds each key once. The sink is partitioned by a hash
    of the keys; a batch looks up its keys in its own parts only, and there
    reads the key columns alone. Rows with a ``sink_day`` are laid out by day
    below that, so that later stages can read recent days alone.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        made = checkpointed(stage(batch).dropDuplicates(keys).withColumn("sink_part", F.pmod(F.xxhash64(*keys), F.lit(SINK_PARTS)).cast("int")))
        spark = batch.sparkSession
        # At most SINK_PARTS numbers.
        parts = [r[0] for r in made.select("sink_part").distinct().collect()]
        if not parts:
            return
        if written(spark, path):
            old = spark.read.schema(made.schema).parquet(path).where(F.col("sink_part").isin(parts)).select(*keys)
            made = made.join(old, keys, "left_anti")
        by = ["sink_part", *[c for c in made.columns if c == "sink_day"]]
        made.repartition("sink_part").write.mode("append").partitionBy(*by).parquet(path)

    return run


def chain(source: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame], list[str]]], folder: str, trigger: dict | None = None) -> None:
    """Run stages one after another over files, each with its own checkpoint and sink under ``folder``.

    The first stage reads ``source``, a stream; each next one streams from the
    sink before it. With the default trigger all available data is processed
    and the call returns; a stage that has left nothing ends the chain.
    """
    spark = source.sparkSession
    for name, stage, keys in steps:
        sink = f"{folder}/{name}"
        q = source.writeStream.foreachBatch(stage_sink(stage, sink, keys)).option("checkpointLocation", f"{folder}/_checkpoints/{name}").trigger(**(trigger or {"availableNow": True})).start()
        q.awaitTermination()
        if not written(spark, sink):
            return
        source = spark.readStream.schema(spark.read.parquet(sink).schema).parquet(sink).drop("sink_part", "sink_day")


def slot_of(ts: Column, minutes: int = 30) -> Column:
    """Start of the slot that a time falls into."""
    size = minutes * 60_000
    return F.timestamp_millis((F.floor(F.unix_millis(ts) / size) * size).cast("long"))
