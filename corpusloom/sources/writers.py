"""Writers."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import skew, windows
from corpusloom.session import stable


# Bytes of a written file, about: how far a shuffled partition is filled before it is cut.
FILE_BYTES = 128 << 20
# Folders of a keyed table that its first batch does not need more of: a batch rewrites whole folders.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 1_000_000, 8, 8192


@contextmanager
def _file_size(spark: SparkSession, size: int) -> Iterator[None]:
    """Adaptive plans run inside cut and join rebalanced partitions at about `size` bytes."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": str(size), "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.5"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def write_partitioned(df: DataFrame, path: str, by: str, file_bytes: int = FILE_BYTES) -> None:
    """Overwrite Parquet partitioned by a column. The data decide how many tasks write: rows are rebalanced by the column, small
    partitions joined and large ones, a hot value's too, cut to files of about `file_bytes`."""
    with _file_size(df.sparkSession, file_bytes):
        df.hint("rebalance", by).write.partitionBy(by).mode("overwrite").parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def with_rotation(df: DataFrame, order: Sequence[Column | str], rotate: int = 1000) -> DataFrame:
    """Adds `file_idx` (whole number of `rotate` rows before the row) and `pos` within the file."""
    n = skew.dense_ids(df, order, "_row")
    return n.withColumn("file_idx", F.floor(F.col("_row") / rotate).cast("bigint")).withColumn(
        "pos", (F.col("_row") % rotate).cast("int")
    ).drop("_row")


def rotated_arrays(df: DataFrame, order: Sequence[Column | str], rotate: int = 1000) -> DataFrame:
    """(file_idx, records, value): each row is one file's JSON array of at most `rotate` records."""
    cols = df.columns
    r = with_rotation(df, order, rotate)
    return (
        r.groupBy("file_idx")
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.struct(*cols).alias("r")))).alias("l"))
        .select("file_idx", F.size("l").alias("records"), F.to_json(F.transform("l", lambda x: x["r"])).alias("value"))
    )


def write_rotating_json(df: DataFrame, path: str, order: Sequence[Column | str], rotate: int = 1000, flat: bool = False) -> None:
    """One valid JSON array per file, a new file after every `rotate` records, in order.
    File i lies in folder file_idx=i; with `flat` it is renamed to file_i.json in `path`, one
    rename on the file system for each file."""
    arrays = rotated_arrays(df, order, rotate).select("file_idx", "value")
    arrays.write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("file_idx").text(path)
    if flat:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in fs.listStatus(hadoop(path)):
            name = folder.getPath().getName()
            if name.startswith("file_idx="):
                part = next(f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
                fs.rename(part, hadoop(path, f"file_{name.removeprefix('file_idx=')}.json"))
                fs.delete(folder.getPath(), True)


def write_rotating(df: DataFrame, path: str, rotate: int = 1000) -> None:
    """JSON lines, at most `rotate` records per file, no order among files: no shuffle at all."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rotate).json(path)


def to_index_docs(sections: DataFrame) -> DataFrame:
    """Search documents (id, title, heading, content, entities) from sections; text lower-cased."""
    return sections.select(
        text.doc_id("title", "heading").alias("id"), F.lower("title").alias("title"),
        F.lower("heading").alias("heading"), F.lower("content").alias("content"),
        F.transform("links", lambda e: F.lower(e)).alias("entities"),
    )


def upsert_parquet(df: DataFrame, path: str, key: str, order: Sequence[Column], buckets: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Insert or replace rows by key: of all rows a key has had, in this batch and in the table, the first by `order`
    stays, so a late older row changes nothing; of rows equal in `order` the new one stays.

    Rows lie in folders by hash of the key, and only folders that receive rows are rewritten, by one committed dynamic
    overwrite, in files of about `file_bytes`. Running the same batch twice leaves the same table. The number of folders belongs to the table: it is
    written beside it, and another number is refused. Without `buckets` the first batch decides it, one folder for each BUCKET_ROWS rows.
    """
    spark = df.sparkSession
    kept = windows.keep_one(df, [key], order)
    exists = _exists(spark, path)
    made = spark.read.json(f"{path}/_layout").first()["buckets"] if exists else None
    if exists and buckets not in (None, made):
        raise ValueError(f"{path} has {made} buckets, not {buckets}")
    if not exists:
        made = buckets or min(max(-(-df.count() // BUCKET_ROWS), LEAST_BUCKETS), MOST_BUCKETS)
        spark.createDataFrame([(made,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/_layout")
    new = kept.withColumn("bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(made)).cast("int"))
    if exists:
        new = stable(new)
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `made` numbers
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).select(*new.columns).withColumn("_late", F.lit(1))
        both = old.unionByName(new.withColumn("_late", F.lit(0)))
        # Read in full before its own folders are replaced.
        new = stable(windows.keep_one(both, [key], [*order, F.asc("_late")]).drop("_late"))
    with _file_size(spark, file_bytes):
        new.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and any(s.getPath().getName().startswith("bucket=") for s in fs.listStatus(p))


def write_splits(parts: Mapping[str, DataFrame], root: str) -> None:
    """One dataset with a folder per named split."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("split", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    out.write.mode("overwrite").partitionBy("split").parquet(root)


def checkpoint_table(df: DataFrame, path: str) -> DataFrame:
    """Write and read back: lineage ends at the table, and later reads are column-pruned."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
