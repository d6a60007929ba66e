"""Resumable and incremental runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.joins import pending
from corpusloom.sources import writers


def resume_batch(spark: SparkSession, todo: DataFrame, out: str, key: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Run `work` on rows whose key is not in the Parquet table `out` yet, append, and return how
    many rows were open. The output itself is the record of progress, so nothing runs twice."""
    p = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    done = fs.exists(p) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(out + "/_SUCCESS"))
    rest = pending(todo, spark.read.parquet(out), key) if done else todo
    n = rest.count()
    if n:
        work(rest).write.mode("append").parquet(out)
    return n


def ingest_stream(
    spark: SparkSession, src: str, schema: str, out: str, ckpt: str, transform: Callable[[DataFrame], DataFrame] | None = None,
    fmt: str = "json", max_files: int | None = None,
) -> StreamingQuery:
    """Process files of `src` that were not seen yet, then stop. The checkpoint and the file
    sink's log make each input file count exactly once, also after a restart."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    s = r.load(src)
    s = transform(s) if transform else s
    return s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()


def dedup_stream(df: DataFrame, key: str, event_time: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Drop keys seen before, across restarts. Without an event time the state grows with the
    number of keys; with one, it is dropped once the watermark has passed."""
    if event_time:
        return df.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([key])
    return df.dropDuplicates([key])


def append_new(out: str, key: str, order: Sequence[Column]) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: append rows whose key the output does not hold; state lives in the
    table, not in memory. A replayed batch replaces its own folder."""
    def run(batch: DataFrame, batch_id: int) -> None:
        from corpusloom.operators.windows import keep_one

        spark = batch.sparkSession
        fresh = keep_one(batch, [key], order)
        p = spark._jvm.org.apache.hadoop.fs.Path(out)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            seen = spark.read.parquet(out).where(F.col("batch_id") < batch_id)
            fresh = pending(fresh, seen, key)
        fresh.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return run


def upsert_batches(path: str, key: str, order: Sequence[Column], buckets: int | None = None) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: keep the first row by `order` per key in a Parquet table, over all batches."""
    def run(batch: DataFrame, batch_id: int) -> None:
        writers.upsert_parquet(batch, path, key, order, buckets)

    return run
