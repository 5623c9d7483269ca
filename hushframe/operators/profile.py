"""Column and table profiles as DataFrames: one row per column, or per
(column, value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from hushframe.operators.correlate import correlation_pairs
from hushframe.operators.ordered import no_nan, unpivot, value_counts
from hushframe.operators.protect import missing, present
from hushframe.operators.selection import quantile_table

PERCENTILES = {
    "p5": 0.05, "p10": 0.10, "q1": 0.25, "median": 0.50,
    "q3": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99,
}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def date_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def numeric_cells(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(column, value double); NaN becomes null."""
    cells = unpivot(df, columns, "double", keep)
    return cells.withColumn("value", no_nan(F.col("value")))


def outlier_bounds(quartiles: DataFrame, multiplier: float) -> DataFrame:
    spread = F.lit(multiplier) * (F.col("q3") - F.col("q1"))
    return quartiles.withColumns({
        "lower_bound": F.col("q1") - spread,
        "upper_bound": F.col("q3") + spread,
    })


def column_quantiles(df: DataFrame, columns: Sequence[str], shares: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of numeric columns, one row per column with a value."""
    return quantile_table(df, {c: present(df, c) for c in columns}, shares)


def is_outside() -> Column:
    return (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))


def outlier_counts(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Outlier rows per column."""
    limits = F.broadcast(bounds.select("column", "lower_bound", "upper_bound"))
    return cells.join(limits, "column").groupBy("column").agg(F.count_if(is_outside()).alias("outlier_count"))


def profile_numeric(
    df: DataFrame, columns: Sequence[str] | None = None, iqr_multiplier: float = 1.5
) -> DataFrame:
    """Counts, moments, percentiles and IQR outliers, one row per column.

    Percentiles are selected first (``selection``); moments and outliers then
    come from one pass that shuffles one row per task and column.
    """
    columns = list(columns or numeric_columns(df))
    bounds = outlier_bounds(column_quantiles(df, columns, PERCENTILES).drop("count"), iqr_multiplier)
    # one row per column
    cells = numeric_cells(df, columns).join(F.broadcast(bounds.select("column", "lower_bound", "upper_bound")), "column", "left")
    value = F.col("value")
    # merged variances of a constant are not exactly zero
    constant = F.min(value) == F.max(value)
    shaped = (F.count(value) >= 3) & ~constant
    moments = cells.groupBy("column").agg(
        F.count(value).alias("count"),
        F.count_if(value.isNull()).alias("null_count"),
        F.avg(value).alias("mean"),
        F.when(constant, 0.0).otherwise(F.stddev_samp(value)).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.when(shaped, F.skewness(value)).alias("skewness"),
        F.when(shaped, F.kurtosis(value)).alias("kurtosis"),
        F.count_if(is_outside()).alias("outlier_count"),
    )
    return moments.join(F.broadcast(bounds), "column", "left").select(
        "column", "count", "null_count", "mean", "std", "min", "max",
        *PERCENTILES, (F.col("q3") - F.col("q1")).alias("iqr"), "skewness", "kurtosis",
        "outlier_count", "lower_bound", "upper_bound",
    )


def outlier_rows(
    df: DataFrame, column: str, key: Sequence[str], iqr_multiplier: float = 1.5
) -> DataFrame:
    """Key and value of the rows outside the IQR bounds."""
    bounds = outlier_bounds(column_quantiles(df, [column], {"q1": 0.25, "q3": 0.75}), iqr_multiplier)
    value = present(df, column).cast("double")
    return (
        df.select(*key, value.alias("value"))
        .withColumn("column", F.lit(column))
        .join(F.broadcast(bounds.select("column", "lower_bound", "upper_bound")), "column")
        .where(is_outside())
        .select(*key, "value")
    )


def text_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return unpivot(df, columns, "string")


def top_per_column(counts: DataFrame, top_n: int, by: Sequence[str] = ("column",), value: str = "value") -> DataFrame:
    """The most frequent values with their rank; ties by value. The rank limit
    is applied inside every task before the shuffle."""
    order = W.partitionBy(*by).orderBy(F.desc("n"), value)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def profile_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cardinality, mode, entropy in bits and uniqueness, one row per column."""
    columns = list(columns or text_columns(df))
    nulls = _null_counts(df, columns)
    counts = value_counts(text_cells(df, columns), ["column"])
    n, value = F.col("n"), F.col("value")
    # entropy = log2 N - sum(n log2 n) / N needs no second pass for N
    stats = counts.groupBy("column").agg(
        F.sum(n).alias("count"),
        F.count(F.lit(1)).alias("cardinality"),
        F.min_by(value, F.struct(-n, value)).alias("mode"),
        F.max(n).alias("mode_count"),
        F.sum(n * F.log2(n)).alias("_n_log_n"),
    )
    total = F.col("count")
    return (
        nulls.join(F.broadcast(stats), "column", "left")
        .select(
            "column",
            F.coalesce(total, F.lit(0)).alias("count"),
            "null_count",
            F.coalesce("cardinality", F.lit(0)).alias("cardinality"),
            "mode",
            F.coalesce("mode_count", F.lit(0)).alias("mode_count"),
            (F.col("mode_count") / total).alias("mode_frequency"),
            F.greatest(F.log2(total) - F.col("_n_log_n") / total, F.lit(0.0)).alias("entropy"),
            F.coalesce(F.col("cardinality") == total, F.lit(False)).alias("is_unique"),
        )
    )


def _null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(F.array(*[
        F.struct(F.lit(c).alias("column"), F.count_if(missing(df, c)).alias("null_count"))
        for c in columns
    ]).alias("cells")).select(F.inline("cells"))


def top_values(df: DataFrame, columns: Sequence[str], top_n: int = 10) -> DataFrame:
    counts = value_counts(text_cells(df, columns), ["column"])
    return top_per_column(counts, top_n).select("column", "rank", "value", "n")


def value_frequencies(df: DataFrame, columns: Sequence[str], normalize: bool = False) -> DataFrame:
    counts = value_counts(text_cells(df, columns), ["column"])
    if not normalize:
        return counts
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "column").select(
        "column", "value", (F.col("n") / F.col("total")).alias("frequency")
    )


def as_stamp(df: DataFrame, name: str) -> Column:
    """Dates as they are, text parsed where it can be."""
    value = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        return parse_date(value)
    return value.cast("timestamp_ntz")


# Text forms read as dates besides ISO.
DATE_FORMATS = ("yyyy/MM/dd", "MM/dd/yyyy", "MM-dd-yyyy", "yyyyMMdd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy")


def parse_date(value: Column) -> Column:
    text = F.trim(value)
    attempts = [F.try_to_timestamp(text)]
    attempts += [F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*attempts).cast("timestamp_ntz")


def date_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), as_stamp(df, c).alias("value")) for c in columns
    ])
    return df.select(F.inline(cells))


def profile_dates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Range, cardinality and mode, one row per column."""
    columns = list(columns or date_columns(df))
    counts = (
        date_cells(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    n, value = F.col("n"), F.col("value")
    known = value.isNotNull()
    stats = counts.groupBy("column").agg(
        F.sum(F.when(known, n).otherwise(0)).alias("count"),
        F.sum(F.when(~known, n).otherwise(0)).alias("null_count"),
        F.min(value).alias("min_date"),
        F.max(value).alias("max_date"),
        F.count_if(known).alias("cardinality"),
        F.min_by(value, F.when(known, F.struct(-n, value))).alias("mode"),
        F.coalesce(F.max(F.when(known, n)), F.lit(0)).alias("mode_count"),
    )
    return stats.withColumn("range_days", whole_days(F.col("min_date"), F.col("max_date")))


def whole_days(start: Column, end: Column) -> Column:
    """Days from start to end, rounded towards minus infinity."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("bigint")


def date_distributions(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per weekday (Monday 0), month and year: (column, part, value, n)."""
    columns = list(columns or date_columns(df))
    days = (
        date_cells(df, columns).where(F.col("value").isNotNull())
        .select("column", F.col("value").cast("date").alias("day"))
        .groupBy("column", "day").agg(F.count(F.lit(1)).alias("n"))
    )
    parts = F.array(*[
        F.struct(F.lit(name).alias("part"), part.alias("value"))
        for name, part in (
            ("weekday", F.weekday("day")), ("month", F.month("day")), ("year", F.year("day")),
        )
    ])
    return (
        days.select("column", "n", F.inline(parts))
        .groupBy("column", "part", "value").agg(F.sum("n").alias("n"))
    )


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cells, missing cells and complete rows of the table: one row."""
    columns = list(columns or df.columns)
    flags = [missing(df, c) for c in columns]
    any_missing = flags[0]
    for flag in flags[1:]:
        any_missing = any_missing | flag
    sums = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(any_missing).alias("rows_with_missing"),
        F.array(*[F.count_if(f) for f in flags]).alias("_nulls"),
    )
    total = F.aggregate("_nulls", F.lit(0).cast("bigint"), lambda a, x: a + x)
    cells = F.col("rows") * len(columns)
    return sums.select(
        cells.alias("total_cells"),
        total.alias("total_missing"),
        F.coalesce(F.try_divide(total * 100.0, cells), F.lit(0.0)).alias("missing_percentage"),
        F.size(F.filter("_nulls", lambda x: x > 0)).cast("bigint").alias("columns_with_missing"),
        "rows_with_missing",
        (F.col("rows") - F.col("rows_with_missing")).alias("complete_rows"),
    )


def missing_by_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or df.columns)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(*[
            F.struct(F.lit(c).alias("column"), F.count_if(missing(df, c)).alias("missing"))
            for c in columns
        ]).alias("cells"),
    ).select("rows", F.inline("cells")).select(
        "column", "missing",
        F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("rows")), F.lit(0.0)).alias("percentage"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows (nulls equal): one row."""
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def profile_columns(
    df: DataFrame, columns: Sequence[str] | None = None, iqr_multiplier: float = 1.5
) -> DataFrame:
    """All column profiles as (column, kind, statistic, value text)."""
    columns = list(columns or df.columns)
    parts = []
    for kind, names, profiler in (
        ("numeric", numeric_columns(df), lambda n: profile_numeric(df, n, iqr_multiplier)),
        ("categorical", text_columns(df), lambda n: profile_categorical(df, n)),
        ("date", date_columns(df), lambda n: profile_dates(df, n)),
    ):
        chosen = [c for c in columns if c in names]
        if chosen:
            table = profiler(chosen)
            stats = F.array(*[
                F.struct(F.lit(c).alias("statistic"), F.col(c).cast("string").alias("value"))
                for c in table.columns if c != "column"
            ])
            parts.append(table.select("column", F.lit(kind).alias("kind"), F.inline(stats)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def profile_dataset(df: DataFrame, columns: Sequence[str] | None = None, correlations: str | None = None) -> DataFrame:
    """Shape, column kinds, completeness and duplicates: one row. Duplicates
    look at every column of the table, the rest at ``columns``. With the name of a
    method (pearson, spearman, kendall) in ``correlations`` the row also holds the
    correlations of the numeric columns, as an array of (column1, column2, n, correlation)."""
    columns = list(columns or df.columns)
    gaps, copies = missing_summary(df, columns), duplicate_rows(df)
    kinds = {
        "numeric_columns": numeric_columns(df),
        "categorical_columns": text_columns(df),
        "date_columns": date_columns(df),
    }
    named = {
        name: F.lit(len([c for c in columns if c in found])).cast("bigint")
        for name, found in kinds.items()
    }
    found = []
    if correlations:
        pairs = correlation_pairs(df, [c for c in columns if c in kinds["numeric_columns"]], correlations)
        cells = F.array_sort(F.collect_list(F.struct("column1", "column2", "n", "correlation")))
        # one entry per pair of columns
        found = [pairs.agg(cells.alias("cells")).scalar().alias("correlations")]
    return gaps.select(
        (F.col("rows_with_missing") + F.col("complete_rows")).alias("row_count"),
        F.lit(len(columns)).cast("bigint").alias("column_count"),
        *[count.alias(name) for name, count in named.items()],
        "total_missing",
        (F.lit(1.0) - F.col("missing_percentage") / 100).alias("completeness"),
        (F.col("total_missing") > 0).alias("has_missing"),
        copies.select("duplicate_rows").scalar().alias("duplicate_rows"), *found,
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Content key under which a saved profile may be reused: row order does
    not matter, any changed cell does."""
    # the hash skips nulls, so that a flag beside each cell tells where they stand
    row = F.xxhash64(*[x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])
    shape = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor(row), F.lit(0)).alias("xor"),
        F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).alias("sum"),
    ).select(F.sha2(F.concat_ws("|", F.lit(shape), "rows", "xor", "sum"), 256).alias("fingerprint"))
