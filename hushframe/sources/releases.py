"""Comparing a release that lies in files with the table it was made from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, types as T

from hushframe.operators.compare import compare_columns
from hushframe.operators.pairs import pair_by_key
from hushframe.operators.profile import date_columns, numeric_columns
from hushframe.sources.readers import CSV, format_of, load
from hushframe.sources.writers import read_metadata


def compare_release(spark: SparkSession, original: DataFrame, path: str, key: Sequence[str]) -> DataFrame:
    """One row per column that the release at ``path`` protected.

    What was protected, passed on and left out is read from the release's own
    metadata (Parquet footer or CSV sidecar); kinds follow the original's types. Rows are
    matched by ``key``, which must have been passed on. A column without values on either
    side is compared as empty: no pairs, no error.
    """
    found = read_metadata(spark, path)
    if found is None:
        raise ValueError(f"{path} holds no release metadata")
    facts = found.select("protected_columns", "passthrough_columns").first()
    if unmatched := set(key) - set(facts["passthrough_columns"]):
        raise ValueError(f"the release did not pass on {sorted(unmatched)}")
    protected = [c for c in original.columns if c in set(facts["protected_columns"])]
    if not protected:
        raise ValueError("the release protected no column of this table")
    if format_of(path) == "csv":
        # a schema goes by position: the order of the file's header, the types of the original
        header = spark.read.options(**CSV).csv(path).columns
        released = load(spark, path, schema=T.StructType([T.StructField(c, original.schema[c].dataType) for c in header])).data
    else:
        released = load(spark, path).data
    paired = pair_by_key(original.select(*key, *protected), released.select(*key, *protected), key)
    numbers, dates = set(numeric_columns(original)), set(date_columns(original))
    return compare_columns(
        paired, [c for c in protected if c in numbers],
        [c for c in protected if c not in numbers and c not in dates], [c for c in protected if c in dates],
    )
