"""Resumable append workloads as Structured Streaming (SM1 to SM4)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def append_new(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, key: str, parts: int = 256) -> None:
    """SM1, SM4: files that arrive in ``source`` are appended to ``sink`` once per key. A batch that is run again after a
    failure finds its own rows in the sink, so nothing is doubled. Rows with an error are kept and not tried again. The sink is
    partitioned by the hash of the key (column _part), and a batch reads the partitions of its own keys only."""

    def write(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates([key]).withColumn("_part", F.expr(f"pmod(xxhash64({key}), {parts})"))
        mine = [r[0] for r in new.select("_part").distinct().collect()]  # at most ``parts`` numbers
        try:
            seen = spark.read.schema(new.schema).parquet(sink).where(F.col("_part").isin(mine)).select(key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            seen = None
        (new if seen is None else new.join(seen, key, "left_anti")).write.mode("append").partitionBy("_part").parquet(sink)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """JN17, SP13: what is not done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def check_manifest(spark: SparkSession, path: str, wanted: dict) -> None:
    """SM2: writes the manifest at the first start; a later start with another one is refused. The file lies where the path
    says, by the file systems that Spark knows, so a driver on another machine finds it; it is created, never overwritten."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(place):
        have = json.loads(spark.read.text(path, wholetext=True).first()[0])
        if have != wanted:
            raise ValueError("the inputs changed since the first start: " + ", ".join(sorted(k for k in {*have, *wanted} if have.get(k) != wanted.get(k))))
        return
    out = fs.create(place, False)
    try:
        out.write(json.dumps(wanted, sort_keys=True).encode())
    finally:
        out.close()


def attempts(events: DataFrame) -> DataFrame:
    """SM3 over a finished journal: (item_id, attempts, finished, interrupted, state)."""
    a = events.groupBy("item_id", "attempt").agg(F.count_if(F.col("event") == "started").alias("s"), F.count_if(F.col("event") == "finished").alias("f"), F.max(F.when(F.col("event") == "finished", F.col("status"))).alias("status"))
    per = a.groupBy("item_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("f") > 0).alias("finished"), F.count_if((F.col("s") > 0) & (F.col("f") == 0)).alias("interrupted"), F.count_if(F.col("status") == "valid").alias("valid"))
    return per.select("item_id", "attempts", "finished", "interrupted", F.when(F.col("valid") > 0, "done").when(F.col("interrupted") > 0, "interrupted").otherwise("open").alias("state"))


def attempts_stream(events: DataFrame):
    """SM3 as a stateful stream: the state of an item is updated with each micro-batch; output mode is update."""
    out = "item_id string, attempts int, finished int, interrupted int, state string"

    def step(key, frames, state: GroupState):
        started, finished, valid = state.get if state.exists else ([], [], 0)
        started, finished = set(started), set(finished)
        for pdf in frames:
            started |= set(pdf.loc[pdf.event == "started", "attempt"].tolist())
            done = pdf[pdf.event == "finished"]
            finished |= set(done["attempt"].tolist())
            valid = valid or int((done["status"] == "valid").any())
        state.update((sorted(started), sorted(finished), valid))
        open_ = started - finished
        yield pd.DataFrame([(key[0], len(started | finished), len(finished), len(open_), "done" if valid else "interrupted" if open_ else "open")], columns=["item_id", "attempts", "finished", "interrupted", "state"])

    return events.groupBy("item_id").applyInPandasWithState(step, out, "started array<int>, finished array<int>, valid int", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Event counts in windows with a watermark: rows later than it are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
