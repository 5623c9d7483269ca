"""Small DataFrame helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from hushframe.session import materialize

__all__ = ["fold", "materialize", "per_batch", "sampled"]


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


#: Arrow batches to and from Python: Spark's defaults of 10000 rows and 64 MB hold, for two
#: tasks on an executor, several hundred MB of texts outside its heap.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches made small from here on."""
    for setting, value in BATCH.items():
        df.sparkSession.conf.set(setting, value)
    return df


#: Bytes of input a worker handles at once, about; a longer row is handled alone.
SLICE = 4 << 20


def per_batch(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """Slices of the Arrow batches of ``df`` through ``work``, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * SLICE // max(batch.nbytes, 1))
            for first in range(0, batch.num_rows, rows):
                yield work(batch.slice(first, rows))
                pa.default_memory_pool().release_unused()

    return small_batches(df).mapInArrow(run, schema)


def sampled(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by a hash of the key: the same
    ones in every run and under every partitioning."""
    if total <= rows:
        return df
    share = int(rows / total * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < share)
