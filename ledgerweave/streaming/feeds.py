"""Continuous feeds: runs, logs, submissions, workflow events and uploaded lines as structured streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerweave.operators import workflow
from ledgerweave.sources.scratch import shared_folder


def drained(stream: DataFrame, path: str, mode: str = "append", partition: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there and reads back what it wrote."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    (writer.partitionBy(*partition) if partition else writer).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def each_batch(stream: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, mode: str = "append") -> DataFrame:
    """Runs a batch job on every micro-batch. A batch writes its own folder and overwrites it when replayed, so a
    restart leaves every row once; only in complete mode the newest batch, which holds all, replaces the others."""
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        folder = path if mode == "complete" else f"{path}/batch={number}"
        job(batch).write.mode("overwrite").parquet(folder)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(run).start().awaitTermination()
    return spark.read.parquet(path).drop("batch")


def each_upload(stream: DataFrame, key: str, job: Callable[[DataFrame], DataFrame], path: str, out_key: str, buckets: int = 256) -> DataFrame:
    """Runs ``job`` on every upload that a micro-batch touches, with all of its rows that have come so far.

    Rows are recorded by batch and by a hash of the upload's key; a batch reads only the folders of the hashes that it
    touches, reruns its uploads whole and writes its own folder, so an upload split over batches or a replayed batch counts
    once. Read back is each upload as its newest batch left it.
    """
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        hashed = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        hashed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={number}")
        kind = T.StructType([*batch.schema.fields, T.StructField("batch", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
        recorded = spark.read.schema(kind).parquet(f"{path}/rows")
        mine = recorded.where(F.col("batch") == number)
        touched = [r.bucket for r in mine.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        # the batch's own rows stay where they are; only what earlier batches left of its uploads is looked for
        earlier = recorded.where((F.col("batch") < number) & F.col("bucket").isin(touched)).drop("batch", "bucket")
        so_far = mine.drop("batch", "bucket")
        if not earlier.isEmpty():
            so_far = so_far.unionAll(earlier.join(mine.select(key).distinct().hint("merge"), key, "left_semi").select(*so_far.columns))
        job(so_far).write.mode("overwrite").parquet(f"{path}/result/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(run).start().awaitTermination()
    done = spark.read.parquet(f"{path}/result")
    if len(done.select("batch").distinct().take(2)) < 2:
        return done.drop("batch")
    newest = done.groupBy(out_key).agg(F.max("batch").alias("batch"))
    return done.join(newest.hint("merge"), [out_key, "batch"], "left_semi").drop("batch")


def tail(spark: SparkSession, folder: str, glob: str, like: DataFrame, files: int = 1) -> DataFrame:
    """The Parquet files of a folder that match ``glob``, as a stream with a declared schema; times count as UTC."""
    stream = spark.readStream.schema(like.schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.withColumns({c: F.col(c).cast("timestamp") for c, kind in like.dtypes if kind == "timestamp_ntz"})


def daily_runs(runs: DataFrame, late: str = "2 days") -> DataFrame:
    """ST4: runs of each day in tumbling windows."""
    day = F.window("run_at", "1 day")
    return runs.withWatermark("run_at", late).groupBy(day).agg(F.count("*").alias("n_runs")).select(F.col("window.start").cast("date").alias("day"), "n_runs")


def without_repeats(submissions: DataFrame, late: str = "30 days") -> DataFrame:
    """ST3: the first submission of an invoice within the watermark."""
    return submissions.withWatermark("submitted_at", late).dropDuplicatesWithinWatermark(["lib_facture"])


def parsed_logs(lines: DataFrame) -> DataFrame:
    """ST2: JSON log lines with their date; a line that does not parse keeps its text in ``bad``."""
    e = F.from_json("value", "struct<timestamp:timestamp,level:string,message:string>")
    ok = F.col("e.timestamp").isNotNull()
    return lines.withColumn("e", e).select(F.coalesce(F.to_date("e.timestamp").cast("string"), F.lit("unknown")).alias("log_date"), "e.level", "e.message", F.when(~ok, F.col("value")).alias("bad"))


MOVES = "submission_id long, state string, n_events long, n_illegal long"
STATE = "current string, n long, illegal long, at array<long>, ids array<long>, states array<string>"


def _judged(current: str | None, illegal: int, states: list[str]) -> tuple[str | None, int]:
    for to in states:
        illegal += to not in workflow.MOVES.get(current or None, ())
        current = to
    return current, illegal


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    current, n, illegal, *lists = state.get if state.exists else (None, 0, 0, [], [], [])
    waiting = list(zip(*lists, strict=True))
    events = [] if state.hasTimedOut else pd.concat(list(batches))
    if len(events):
        waiting += zip((events["event_at"].astype("int64") // 1000 if events["event_at"].dt.unit == "ns" else events["event_at"].astype("int64")).tolist(), events["event_id"].tolist(), events["state"].tolist(), strict=True)
        waiting.sort()
    # what the watermark has passed can get no event before it
    passed = [e for e in waiting if e[0] < 1000 * state.getCurrentWatermarkMs()]
    current, illegal = _judged(current, illegal, [to for _, _, to in passed])
    n, waiting = n + len(passed), waiting[len(passed) :]
    state.update((current, n, illegal, *([e[i] for e in waiting] for i in range(3))))
    if waiting:
        state.setTimeoutTimestamp(max(waiting[-1][0] // 1000, state.getCurrentWatermarkMs()) + 1)
    if len(events):
        last, wrong = _judged(current, illegal, [to for _, _, to in waiting])
        yield pd.DataFrame({"submission_id": [key[0]], "state": [last], "n_events": [n + len(waiting)], "n_illegal": [wrong]})


def tracked(events: DataFrame, late: str = "30 days") -> DataFrame:
    """ST5: workflow state of each submission over time, one row whenever an event comes.

    Moves are judged in the order of (event_at, event_id), however they arrive: those within ``late`` of the newest event
    wait in the state and are judged again with every newcomer; what the watermark has passed is folded into three
    values by a timer, so the state of a submission stays short. Events later than that are dropped.
    """
    timed = events.withWatermark("event_at", late)
    return timed.groupBy("submission_id").applyInPandasWithState(_advance, MOVES, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def submissions(stream: DataFrame, root: str, posted: DataFrame) -> None:
    """ST3: every micro-batch of submissions is judged against the posted invoices and all that earlier batches recorded
    (J4, J5), and recorded under its number; a batch that Spark replays adds nothing."""
    spark = stream.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        workflow.record_submissions(spark, root, f"{number:012d}", batch, posted)

    stream.writeStream.option("checkpointLocation", f"{root}-state").trigger(availableNow=True).foreachBatch(run).start().awaitTermination()


def folder(spark: SparkSession, name: str) -> str:
    return shared_folder(spark, name)
