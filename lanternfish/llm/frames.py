"""Frames and batches as tasks want them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def text_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's own for whole texts, which both the JVM and the worker hold; a session that sets
    their size keeps it."""
    if spark.conf.get(BATCH_KEY) == "10000":
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


@contextmanager
def few_rows(spark: SparkSession, rows: int = 2) -> Iterator[None]:
    """Arrow batches and batches of Parquet's reader of so few rows, for tables whose rows are megabytes of arrays, of which both
    otherwise hold thousands.  It holds for what is run inside; then the session's own sizes are back."""
    keys = (BATCH_KEY, "spark.sql.parquet.columnarReaderBatchSize")
    own = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, rows)
    try:
        yield
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)


def object_frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Columns of plain Python objects: strings never become chunked Arrow arrays, and an empty list keeps its columns."""
    values = list(zip(*rows)) if rows else [()] * len(columns)
    return pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(columns, values)})


def text_blocks(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``size`` bytes of text each; a longer text is a slice of its own."""
    upto = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.unique(np.searchsorted(upto, np.arange(size, upto[-1], size)) if len(upto) else [])
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)
