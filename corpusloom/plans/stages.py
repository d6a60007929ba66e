"""Jobs made of named stages that each leave a table, and go on where an earlier run stopped."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# Of the tables so far, by name, to the stage's table.
Stage = tuple[str, Callable[[Mapping[str, DataFrame]], DataFrame]]


def _finished(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _same_job(spark: SparkSession, out: str, params: Mapping[str, object]) -> None:
    """Write the job's parameters beside its tables, or refuse others than those written there."""
    said = json.dumps(params, sort_keys=True, default=str)
    try:
        kept = spark.read.text(f"{out}/_params").first()  # one line
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = None
    if kept is None:
        spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/_params")
    elif kept["value"] != said:
        raise ValueError(f"{out} was begun with {kept['value']}, not {said}")


def run_stages(spark: SparkSession, out: str, stages: Sequence[Stage], params: Mapping[str, object] | None = None) -> dict[str, DataFrame]:
    """Run `stages` in turn and return their tables, read back from `out`/name.

    A stage whose table is complete is not run again; the table of one that broke off is written anew, and so are those after a stage
    that ran. A folder begun with other `params` is refused.
    """
    _same_job(spark, out, params or {})
    tables: dict[str, DataFrame] = {}
    ran = False
    for name, fn in stages:
        path = f"{out}/{name}"
        if ran or not _finished(spark, path):
            fn(tables).write.mode("overwrite").parquet(path)
            ran = True
        tables[name] = spark.read.parquet(path)
    return tables
