"""A Python function over one column, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Bytes of text, or eighths of the bytes of numbers, whose results a Python worker holds at once.
PIECE = 1 << 20


def _pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(begin, length) of consecutive rows whose sizes add up to about `most`; a larger row is a piece of its own."""
    ends = np.cumsum(sizes + 1)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        end = max(int(np.searchsorted(ends, before + most, "right")), at + 1)
        yield at, end - at
        at = end


def with_result(df: DataFrame, col: str, out: str, kind: str, fn: Callable, keep: bool = True) -> DataFrame:
    """`df` with `out` = fn(`col`), of Spark type `kind`, and without `col` unless `keep`. `col` holds texts, given as str or None, or arrays of
    numbers, given as numpy arrays.

    An Arrow batch has thousands of rows whatever their size; its results are made and sent on by pieces, so that what a worker holds
    beside the batch does not grow with the table. The function runs once for each row, whoever uses the result.
    """
    made = T._parse_datatype_string(kind)
    arrow = to_arrow_type(made)
    fields = [f for f in df.schema.fields if keep or f.name != col]
    place, kept = df.columns.index(col), [df.columns.index(f.name) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(place)
            lists = pa.types.is_list(given.type)
            sizes = pc.list_value_length(given) if lists else pc.binary_length(given)
            for at, n in _pieces(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64), PIECE):
                rows = b.slice(at, n)
                got = [fn(v.values.to_numpy(zero_copy_only=False) if lists and v.is_valid else v.as_py()) for v in rows.column(place)]
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in kept), pa.array(got, arrow)], names=[*(f.name for f in fields), out])

    return df.mapInArrow(run, T.StructType([*fields, T.StructField(out, made)]))
