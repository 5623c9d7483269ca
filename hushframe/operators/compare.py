"""What the noise did: original against protected, column by column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hushframe.operators.correlate import correlation_pairs
from hushframe.operators.pairs import (
    number, pair_cells, side_columns, side_counts, stamp, text,
)
from hushframe.operators.profile import top_per_column, whole_days
from hushframe.operators.selection import quantile_table
from hushframe.session import materialize


def _side_quantiles(paired: DataFrame, columns: Sequence[str], shares: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """Exact quantiles of either side over the rows where both are known."""
    sides: dict[str, dict[str, Column]] = {"o": {}, "p": {}}
    for c in columns:
        o, p = number(F.col("orig")[c]), number(F.col("prot")[c])
        both = o.isNotNull() & p.isNotNull()
        sides["o"][c], sides["p"][c] = F.when(both, o), F.when(both, p)
    # both sides in the same passes
    found = quantile_table(paired, {f"{side}{c}": v for side, values in sides.items() for c, v in values.items()}, shares)
    left, right = (
        found.where(F.startswith("column", F.lit(side))).withColumn("column", F.substring("column", 2, 1 << 20)).drop("count")
        for side in sides
    )
    return left, right


def compare_numeric(paired: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Errors and summary statistics over the rows where both sides are known."""
    columns = list(columns or side_columns(paired, "numeric"))
    cells = pair_cells(paired, columns, number)
    both = F.col("o").isNotNull() & F.col("p").isNotNull()
    o, p = F.when(both, F.col("o")), F.when(both, F.col("p"))
    gap = p - o
    zero = F.lit(0.0)
    known = F.count_if(both)

    def or_zero(value: Column) -> Column:
        return F.coalesce(value, zero)

    def spread(value: Column) -> Column:
        return F.when(known > 1, F.stddev_samp(value)).otherwise(zero)

    stats = cells.groupBy("column").agg(
        known.alias("count"),
        (F.count(F.lit(1)) - known).alias("null_count"),
        or_zero(F.avg(F.abs(gap))).alias("mae"),
        or_zero(F.sqrt(F.avg(gap * gap))).alias("rmse"),
        F.when(
            F.count_if(both & (F.col("o") == 0)) == 0, F.avg(F.abs(F.try_divide(gap, o))) * 100
        ).alias("mape"),
        or_zero(F.max(F.abs(gap))).alias("max_absolute_error"),
        or_zero(F.avg(o)).alias("mean_original"),
        or_zero(F.avg(p)).alias("mean_protected"),
        spread(o).alias("std_original"),
        spread(p).alias("std_protected"),
        or_zero(F.min(o)).alias("min_original"),
        or_zero(F.min(p)).alias("min_protected"),
        or_zero(F.max(o)).alias("max_original"),
        or_zero(F.max(p)).alias("max_protected"),
    )
    left, right = _side_quantiles(paired, columns, {"median": 0.5})
    for which in ("mean", "std"):
        before, after = F.col(f"{which}_original"), F.col(f"{which}_protected")
        stats = stats.withColumns({
            f"{which}_difference": after - before,
            f"{which}_relative_error": F.when(before != 0, F.abs((after - before) / before) * 100),
        })
    return (
        stats.join(F.broadcast(left.withColumnRenamed("median", "median_original")), "column", "left")
        .join(F.broadcast(right.withColumnRenamed("median", "median_protected")), "column", "left")
        .fillna(0.0, ["median_original", "median_protected"])
    )


def compare_percentiles(
    paired: DataFrame,
    columns: Sequence[str] | None = None,
    percentiles: Sequence[int] = (5, 25, 50, 75, 95),
) -> DataFrame:
    """(column, percentile, original, protected, difference)."""
    columns = list(columns or side_columns(paired, "numeric"))
    shares = {f"p{p}": p / 100 for p in percentiles}
    left, right = _side_quantiles(paired, columns, shares)
    wide = left.select("column", *[F.col(s).alias(f"o_{s}") for s in shares]).join(
        F.broadcast(right.select("column", *[F.col(s).alias(f"p_{s}") for s in shares])), "column"
    )
    lines = F.array(*[
        F.struct(
            F.lit(s).alias("percentile"),
            F.col(f"o_{s}").alias("original"),
            F.col(f"p_{s}").alias("protected"),
        ) for s in shares
    ])
    return wide.select("column", F.inline(lines)).withColumn(
        "difference", F.col("protected") - F.col("original")
    )


def shares_of(counts: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """Adds the relative frequencies ``p_o`` and ``p_p``."""
    totals = counts.groupBy(*by).agg(F.sum("n_o").alias("_o"), F.sum("n_p").alias("_p"))
    return (
        counts.join(F.broadcast(totals), list(by))
        .withColumns({
            "p_o": F.coalesce(F.try_divide("n_o", "_o"), F.lit(0.0)),
            "p_p": F.coalesce(F.try_divide("n_p", "_p"), F.lit(0.0)),
        })
        .drop("_o", "_p")
    )


def compare_categorical(paired: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drift, cardinalities, modes and mean frequency change per column."""
    columns = list(columns or side_columns(paired, "categorical"))
    cells = pair_cells(paired, columns, text)
    both = F.col("o").isNotNull() & F.col("p").isNotNull()
    known = F.count_if(both)
    rows = cells.groupBy("column").agg(
        known.alias("count"),
        (F.count(F.lit(1)) - known).alias("null_count"),
        F.coalesce(
            F.avg(F.when(both, (F.col("o") != F.col("p")).cast("int"))), F.lit(0.0)
        ).alias("category_drift"),
    )
    n_o, n_p, value = F.col("n_o"), F.col("n_p"), F.col("value")
    values = shares_of(side_counts(cells)).groupBy("column").agg(
        F.count_if(n_o > 0).alias("cardinality_original"),
        F.count_if(n_p > 0).alias("cardinality_protected"),
        F.min_by(value, F.struct(-n_o, value)).alias("mode_original"),
        F.min_by(value, F.struct(-n_p, value)).alias("mode_protected"),
        F.avg(F.abs(F.col("p_p") - F.col("p_o"))).alias("frequency_mae"),
        F.count_if(n_o == 0).alias("new_categories"),
        F.count_if(n_p == 0).alias("missing_categories"),
    )
    filled = rows.join(F.broadcast(values), "column", "left").fillna(
        0, ["cardinality_original", "cardinality_protected", "frequency_mae",
            "new_categories", "missing_categories"],
    )
    return filled.withColumns({
        "cardinality_difference": F.col("cardinality_protected") - F.col("cardinality_original"),
        "mode_preserved": F.col("mode_original").eqNullSafe(F.col("mode_protected")),
    })


def category_changes(paired: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Categories only one side has: (column, value, change)."""
    columns = list(columns or side_columns(paired, "categorical"))
    counts = side_counts(pair_cells(paired, columns, text))
    return counts.where("n_o = 0 or n_p = 0").select(
        "column", "value", F.when(F.col("n_o") == 0, "new").otherwise("missing").alias("change")
    )


def compare_frequencies(
    paired: DataFrame, columns: Sequence[str] | None = None, top_n: int = 20
) -> DataFrame:
    """Both frequencies of every category among the top of either side."""
    columns = list(columns or side_columns(paired, "categorical"))
    counts = shares_of(side_counts(pair_cells(paired, columns, text)))
    tops = [
        top_per_column(counts.select("column", "value", F.col(n).alias("n")).where("n > 0"), top_n)
        .select("column", "value")
        for n in ("n_o", "n_p")
    ]
    # at most 2 * top_n rows a column
    chosen = tops[0].union(tops[1]).distinct()
    return counts.join(F.broadcast(chosen), ["column", "value"], "left_semi").select(
        "column", "value", F.col("p_o").alias("original"), F.col("p_p").alias("protected")
    )


def compare_dates(paired: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Errors in days and how the range moved."""
    columns = list(columns or side_columns(paired, "date"))
    cells = pair_cells(paired, columns, stamp)
    both = F.col("o").isNotNull() & F.col("p").isNotNull()
    o, p = F.when(both, F.col("o")), F.when(both, F.col("p"))
    days = (F.unix_date(p.cast("date")) - F.unix_date(o.cast("date"))).cast("double")
    known = F.count_if(both)
    return (
        cells.groupBy("column").agg(
            known.alias("count"),
            (F.count(F.lit(1)) - known).alias("null_count"),
            F.avg(F.abs(days)).alias("mae_days"),
            F.sqrt(F.avg(days * days)).alias("rmse_days"),
            F.max(F.abs(days)).alias("max_absolute_error_days"),
            F.min(o).alias("_min_o"), F.max(o).alias("_max_o"),
            F.min(p).alias("_min_p"), F.max(p).alias("_max_p"),
        )
        .select(
            "column", "count", "null_count",
            *[
                F.coalesce(c, F.lit(0.0)).alias(c)
                for c in ("mae_days", "rmse_days", "max_absolute_error_days")
            ],
            *[
                F.coalesce(whole_days(F.col(a), F.col(b)), F.lit(0)).alias(name)
                for name, a, b in (
                    ("range_original_days", "_min_o", "_max_o"),
                    ("range_protected_days", "_min_p", "_max_p"),
                    ("min_date_diff_days", "_min_o", "_min_p"),
                    ("max_date_diff_days", "_max_o", "_max_p"),
                )
            ],
        )
        .withColumn(
            "range_difference_days", F.col("range_protected_days") - F.col("range_original_days")
        )
    )


def correlation_shift(
    paired: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson",
    threshold: float = 0.1,
) -> DataFrame:
    """Both correlations of every pair that has them, and whether they agree."""
    columns = list(columns or side_columns(paired, "numeric"))
    sides = [
        correlation_pairs(paired.select(f"{side}.*"), columns, method)
        .select("column1", "column2", F.col("correlation").alias(name))
        for side, name in (("orig", "original"), ("prot", "protected"))
    ]
    shift = F.col("protected") - F.col("original")
    return (
        sides[0].join(F.broadcast(sides[1]), ["column1", "column2"])
        .where("original is not null and protected is not null")
        .withColumns({"difference": shift, "preserved": F.abs(shift) <= threshold})
    )


def correlation_preservation(
    paired: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson",
    threshold: float = 0.1,
) -> DataFrame:
    gap = F.abs("difference")
    total = F.count(F.lit(1))
    return correlation_shift(paired, columns, method, threshold).agg(
        F.coalesce(F.avg(gap), F.lit(0.0)).alias("mae"),
        F.coalesce(F.sqrt(F.avg(gap * gap)), F.lit(0.0)).alias("rmse"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("max_absolute_error"),
        F.count_if("preserved").alias("preserved_count"),
        total.alias("total_count"),
        F.coalesce(F.try_divide(F.count_if("preserved"), total), F.lit(1.0)).alias("preservation_rate"),
    )


def compare_columns(
    paired: DataFrame,
    numeric: Sequence[str] | None = None,
    categorical: Sequence[str] | None = None,
    dates: Sequence[str] | None = None,
) -> DataFrame:
    """One row per compared column, whatever its kind."""
    chosen = {
        "numeric": side_columns(paired, "numeric") if numeric is None else list(numeric),
        "categorical": side_columns(paired, "categorical") if categorical is None else list(categorical),
        "date": side_columns(paired, "date") if dates is None else list(dates),
    }
    none = F.lit(None).cast("double")
    makers = {
        "numeric": lambda c: compare_numeric(paired, c).select(
            "column", F.lit("numeric").alias("kind"), "count", "null_count", "mae", "rmse",
            F.col("max_absolute_error").alias("max_error"), none.alias("drift"),
        ),
        "categorical": lambda c: compare_categorical(paired, c).select(
            "column", F.lit("categorical").alias("kind"), "count", "null_count",
            none.alias("mae"), none.alias("rmse"), none.alias("max_error"),
            F.col("category_drift").alias("drift"),
        ),
        "date": lambda c: compare_dates(paired, c).select(
            "column", F.lit("date").alias("kind"), "count", "null_count",
            F.col("mae_days").alias("mae"), F.col("rmse_days").alias("rmse"),
            F.col("max_absolute_error_days").alias("max_error"), none.alias("drift"),
        ),
    }
    parts = [makers[kind](names) for kind, names in chosen.items() if names]
    if not parts:
        raise ValueError("nothing to compare")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def compare_dataset(
    paired: DataFrame,
    numeric: Sequence[str] | None = None,
    categorical: Sequence[str] | None = None,
    dates: Sequence[str] | None = None,
    correlations: bool = True,
) -> DataFrame:
    """The table-level summary: one row.

    Errors, quantiles and correlations of either side all pass over the pairs, so the
    compared columns are written once: noise is drawn and rows are matched a single time.
    """
    numeric = side_columns(paired, "numeric") if numeric is None else list(numeric)
    categorical = side_columns(paired, "categorical") if categorical is None else list(categorical)
    dates = side_columns(paired, "date") if dates is None else list(dates)
    kept = list(dict.fromkeys([*numeric, *categorical, *dates]))
    if kept:
        paired = materialize(paired.select(*[F.struct(*[F.col(side)[c].alias(c) for c in kept]).alias(side) for side in ("orig", "prot")]))
    columns = compare_columns(paired, numeric, categorical, dates)
    is_number = (F.col("kind") == "numeric") & (F.col("count") > 0)
    summary = columns.agg(
        F.max(F.col("count") + F.col("null_count")).alias("row_count"),
        F.count_if(F.col("kind") == "numeric").alias("numeric_columns"),
        F.count_if(F.col("kind") == "categorical").alias("categorical_columns"),
        F.count_if(F.col("kind") == "date").alias("date_columns"),
        F.avg(F.when(is_number, F.col("mae"))).alias("overall_numeric_mae"),
        F.avg(F.when(is_number, F.col("rmse"))).alias("overall_numeric_rmse"),
        F.avg("drift").alias("mean_category_drift"),
    )
    rate = F.lit(None).cast("double")
    if correlations and len(numeric) >= 2:
        rate = correlation_preservation(paired, numeric).select("preservation_rate").scalar()
    return summary.withColumn("correlation_preservation_rate", rate)
