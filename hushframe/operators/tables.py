"""The small tables behind charts and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from hushframe.operators import compare, divergence
from hushframe.operators.ordered import even_quantiles, quantiles, value_counts
from hushframe.operators.pairs import number, pair_cells, side_columns, side_counts, text
from hushframe.operators.profile import top_per_column
from hushframe.operators.protect import EXCLUDE, PASSTHROUGH, PROTECT, Release
from hushframe.operators.selection import quantile_table


def side_rows(paired: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, side, value): each side on its own, nulls dropped."""
    cells = pair_cells(paired, columns, number)
    return cells.select("column", F.inline(F.array(
        F.struct(F.lit("original").alias("side"), F.col("o").alias("value")),
        F.struct(F.lit("protected").alias("side"), F.col("p").alias("value")),
    ))).where(F.col("value").isNotNull())


def histogram_overlay(
    paired: DataFrame, columns: Sequence[str], bins: int | DataFrame = 50
) -> DataFrame:
    """Counts and densities of both sides over common bins."""
    cells = pair_cells(paired, columns, number)
    counted = divergence.histogram(cells, bins, masked=False)
    totals = counted.groupBy("column").agg(F.sum("n_o").alias("_o"), F.sum("n_p").alias("_p"))
    width = F.col("bin_high") - F.col("bin_low")
    return counted.join(F.broadcast(totals), "column").select(
        "column", "bin", "bin_low", "bin_high", "n_o", "n_p",
        F.coalesce(F.try_divide(F.col("n_o"), F.col("_o") * width), F.lit(0.0)).alias("density_o"),
        F.coalesce(F.try_divide(F.col("n_p"), F.col("_p") * width), F.lit(0.0)).alias("density_p"),
    )


def auto_bins(paired: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, low, high, bins): the finer of the Sturges and the
    Freedman-Diaconis width over both sides together."""
    counts = value_counts(side_rows(paired, columns), ["column"])
    quart = quantiles(counts, ["column"], {"low": 0.0, "q1": 0.25, "q3": 0.75, "high": 1.0})
    n = F.col("count")
    span = F.col("high") - F.col("low")
    sturges = span / (F.log2(n) + 1)
    fd = 2 * (F.col("q3") - F.col("q1")) / F.pow(n, F.lit(1 / 3))
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    flat = span == 0
    half = F.when(flat, 0.5).otherwise(0.0)
    return quart.select(
        "column",
        (F.col("low") - half).alias("low"), (F.col("high") + half).alias("high"),
        F.when(flat, 1).otherwise(F.ceil(F.try_divide(span, width))).cast("bigint").alias("bins"),
    )


def histogram_auto(paired: DataFrame, columns: Sequence[str]) -> DataFrame:
    return histogram_overlay(paired, columns, auto_bins(paired, columns))


def correlation_table(
    paired: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson", threshold: float = 0.1
) -> DataFrame:
    """Both matrices, the signed difference and whether it is small."""
    return compare.correlation_shift(paired, columns, method, threshold)


def category_bars(paired: DataFrame, columns: Sequence[str] | None = None, top_n: int = 15) -> DataFrame:
    """The original top, filled up with unseen protected categories, cut to
    ``top_n``: (column, place, value, original, protected)."""
    columns = list(columns or side_columns(paired, "categorical"))
    counts = compare.shares_of(side_counts(pair_cells(paired, columns, text), masked=False))
    sides = {}
    for side, n in (("o", "n_o"), ("p", "n_p")):
        ranked = counts.withColumn("n", F.col(n)).where(F.col(n) > 0)
        sides[side] = top_per_column(ranked, top_n).select("column", "value", "rank")
    first = sides["o"].select("column", "value", F.struct(F.lit(0).alias("g"), "rank").alias("place"))
    later = sides["p"].join(F.broadcast(sides["o"]), ["column", "value"], "left_anti").select(
        "column", "value", F.struct(F.lit(1).alias("g"), "rank").alias("place")
    )
    # at most 2 * top_n rows a column from here on
    order = W.partitionBy("column").orderBy("place")
    chosen = first.union(later).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_n)
    return counts.join(F.broadcast(chosen), ["column", "value"]).select(
        "column", "place", "value", F.col("p_o").alias("original"), F.col("p_p").alias("protected")
    )


def category_shift(paired: DataFrame, columns: Sequence[str] | None = None, top_n: int = 15) -> DataFrame:
    return divergence.top_changes(paired, columns, top_n, masked=False).select(
        "column", "rank", "value", "difference"
    )


def box_table(paired: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Box statistics per column and side; whiskers end at the outermost
    values within 1.5 IQR."""
    columns = list(columns or side_columns(paired, "numeric"))
    sides = {"original": "orig", "protected": "prot"}
    # "|" parts the side from the column's name
    shares = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    found = quantile_table(paired, {f"{side}|{c}": number(F.col(field)[c]) for side, field in sides.items() for c in columns}, shares)
    box = found.withColumns({"side": F.substring_index("column", "|", 1), "column": F.expr("substring(column, instr(column, '|') + 1)")})
    box = box.select("column", "side", "count", *shares)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    # one row per column and side is broadcast
    spread = side_rows(paired, columns).join(F.broadcast(box.select("column", "side", "q1", "q3")), ["column", "side"]).groupBy("column", "side").agg(
        F.avg("value").alias("mean"), F.min(F.when(inside, F.col("value"))).alias("whisker_low"), F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
    )
    return box.join(F.broadcast(spread), ["column", "side"])


def qq_table(paired: DataFrame, column: str, points: int = 1000) -> DataFrame:
    """Evenly spaced quantiles of both sides: (point, original, protected)."""
    counts = value_counts(side_rows(paired, [column]), ["column", "side"])
    smaller = counts.groupBy("side").agg(F.sum("n").alias("n")).agg(F.min("n")).scalar()
    even = even_quantiles(counts, ["column", "side"], F.least(smaller, F.lit(points)))
    return even.groupBy("point").agg(
        F.max(F.when(F.col("side") == "original", F.col("value"))).alias("original"),
        F.max(F.when(F.col("side") == "protected", F.col("value"))).alias("protected"),
    )


def metric_table(paired: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """(column, metric, value) of the divergences and of MAE and RMSE."""
    lines = divergence.all_divergences(paired, numeric, categorical).select("column", "metric", "value")
    if not numeric:
        return lines
    errors = compare.compare_numeric(paired, numeric).select("column", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mae", "rmse")
    ])))
    return lines.unionByName(errors)


def scatter_bins(paired: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """A scatter plot as counts in a grid: (side, x_bin, y_bin, n)."""
    both = paired.select(F.inline(F.array(*[
        F.struct(
            F.lit(name).alias("side"), number(F.col(side)[x]).alias("x"), number(F.col(side)[y]).alias("y")
        )
        for side, name in (("orig", "original"), ("prot", "protected"))
    ]))).where("x is not null and y is not null")
    ranges = both.agg(
        *[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))]
    ).withColumn("_one", F.lit(1))
    count = F.lit(bins).cast("bigint")
    binned = both.withColumn("_one", F.lit(1)).join(F.broadcast(ranges), "_one")
    def place(c: str):
        flat = F.col(f"low_{c}") == F.col(f"high_{c}")
        half = F.when(flat, 0.5).otherwise(0.0)
        return divergence.bin_of(F.col(c), F.col(f"low_{c}") - half, F.col(f"high_{c}") + half, count)

    return binned.groupBy("side", place("x").alias("x_bin"), place("y").alias("y_bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def numeric_dashboard(paired: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, statistic, original, protected, difference)."""
    wide = compare.compare_numeric(paired, columns)
    lines = F.array(*[
        F.struct(
            F.lit(s).alias("statistic"), F.col(f"{s}_original").alias("original"),
            F.col(f"{s}_protected").alias("protected"),
        ) for s in ("mean", "std", "median", "min", "max")
    ])
    return wide.select("column", F.inline(lines)).withColumn(
        "difference", F.col("protected") - F.col("original")
    )


def category_dashboard(paired: DataFrame, columns: Sequence[str] | None = None, top_n: int = 10) -> DataFrame:
    return category_bars(paired, columns, top_n).withColumn(
        "difference", F.col("protected") - F.col("original")
    )


# Labels of a total epsilon up to each limit, and beyond.
PRIVACY_LABELS = ((1.0, "Strong privacy protection"), (5.0, "Moderate privacy protection"), (None, "Utility-focused protection"))


def privacy_level(epsilon):
    """Label of a total epsilon."""
    *limited, (_, last) = PRIVACY_LABELS
    return F.coalesce(*[F.when(epsilon <= limit, label) for limit, label in limited], F.lit(last))


def report_summary(release: Release, compared: DataFrame) -> DataFrame:
    """Executive summary: one row from the release and its column comparison."""
    means = compared.agg(
        F.avg(F.when(F.col("kind") == "numeric", F.col("mae"))).alias("mean_mae"),
        F.avg("drift").alias("mean_drift"),
    )
    modes = [o.mode for o in release.outcomes]
    rows = release.source.agg(F.count(F.lit(1)).alias("n")).scalar()
    total = F.lit(release.total_epsilon)
    return means.select(
        rows.alias("row_count"),
        F.lit(len(modes)).cast("bigint").alias("column_count"),
        *[
            F.lit(modes.count(m)).cast("bigint").alias(f"{m}_columns")
            for m in (PROTECT, PASSTHROUGH, EXCLUDE)
        ],
        total.alias("total_epsilon"),
        privacy_level(total).alias("privacy_level"),
        "mean_mae", "mean_drift",
    )


def report_configuration(release: Release) -> DataFrame:
    """Display rows of the configuration: (column, mode, epsilon, mechanism)."""
    mode = F.create_map(*[
        F.lit(x) for x in (PROTECT, "Protected", PASSTHROUGH, "Passthrough", EXCLUDE, "Excluded")
    ])[F.col("mode")]
    dash = F.lit("—")
    return release.summary().select(
        "column", mode.alias("mode"),
        F.when(F.col("epsilon").isNotNull(), F.format_string("%.2f", F.col("epsilon")))
        .otherwise(dash).alias("epsilon"),
        F.coalesce("mechanism", dash).alias("mechanism"),
    )


def budget_by_column(release: Release) -> DataFrame:
    """Epsilon per protected column, largest first."""
    return (
        release.summary().where("mode = 'protect' and epsilon is not null")
        .orderBy(F.desc("epsilon"), "column").select("column", "epsilon")
    )
