"""Order statistics without a global sort.

A window over a whole column puts that column into one task. Here values are
counted first (equal values merge before the shuffle, so a hot value is one
row), cut points split the values into ranges of bounded size, a window runs
inside each range, and the totals of the earlier ranges are added back. Cut
points come from a sketch; they move the range borders, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hushframe.functions.search import count_where_prefix
from hushframe.session import materialize

VALUES_PER_RANGE = 50_000
SKETCH_SHARE = 64


def unpivot(df: DataFrame, columns: Sequence[str], value_type: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value) with one row per cell."""
    if not columns:
        raise ValueError("no columns to unpivot")
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(value_type).alias("value"))
        for c in columns
    ])
    return df.select(*keep, F.inline(cells))


def no_nan(value: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(value), value)


def value_counts(cells: DataFrame, by: Sequence[str], value: str = "value", **weights: Column) -> DataFrame:
    """One row per distinct value; ``n`` rows unless other sums are asked for."""
    sums = weights or {"n": F.lit(1)}
    return (
        cells.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(*[F.sum(w).cast("bigint").alias(name) for name, w in sums.items()])
    )


def most_ranges(df: DataFrame) -> int:
    """More ranges than the cluster has shuffle partitions would not help."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(64, min(4 * partitions, 16_384))


def range_borders(
    counts: DataFrame, by: Sequence[str], value: str, weights: Sequence[str], per_range: int
) -> DataFrame:
    """by -> borders (as many as the number of values asks for) and the total
    of each weight.

    Summing the weights here is no extra work, and it lets this branch read
    the same shuffled value counts as the branch that is cut into ranges.
    """
    most = most_ranges(counts)
    shares = [i / most for i in range(1, most)]
    # the sketch sees one value in SKETCH_SHARE: enough to balance the ranges,
    # and the borders have no say in the result
    sketched = F.when(F.pmod(F.xxhash64(value), F.lit(SKETCH_SHARE)) == 0, F.col(value).cast("double"))
    ranges = F.least(F.ceil(F.col("_values") / per_range), F.lit(most))
    stride = F.greatest(F.floor(F.lit(most) / ranges), F.lit(1))
    return (
        counts.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("_values"),
            F.approx_percentile(sketched, shares, 2 * most).alias("_all"),
            *[F.sum(w).alias(f"{w}_total") for w in weights],
        )
        .select(
            *by,
            F.when(F.col("_values") <= per_range, F.array().cast("array<double>"))
            .otherwise(
                F.array_distinct(F.filter("_all", lambda x, i: (i + 1) % stride == 0))
            )
            .alias("_borders"),
            *[f"{w}_total" for w in weights],
        )
    )


def into_ranges(
    counts: DataFrame,
    by: Sequence[str],
    value: str,
    weights: Sequence[str],
    per_range: int = VALUES_PER_RANGE,
) -> DataFrame:
    """Adds ``_range`` and the totals of the weights. ``by`` must name few
    groups (columns of a table): their borders, at most ``most_ranges`` numbers
    each, are one constant map that rows refer to."""
    by = list(by)
    totals = [f"{w}_total" for w in weights]
    group = F.struct(*by) if by else F.lit(0)
    borders = range_borders(counts, by, value, weights, per_range)
    pairs = F.collect_list(F.struct(group.alias("group"), F.struct("_borders", *totals).alias("found")))
    found = borders.agg(F.map_from_entries(pairs).alias("m")).scalar()
    target = F.col(value).cast("double")
    # looked up once a row, whatever the steps of the search
    search = F.transform(F.array("_mine._borders"), lambda held: count_where_prefix(held, lambda b: b < target, most_ranges(counts)))
    return counts.withColumn("_mine", F.element_at(found, group)).withColumns({
        "_range": F.coalesce(F.get(search, F.lit(0)), F.lit(0)), **{t: F.col(f"_mine.{t}") for t in totals},
    }).drop("_mine")


def cumulate(
    counts: DataFrame,
    by: Sequence[str],
    value: str,
    weights: Sequence[str],
    per_range: int = VALUES_PER_RANGE,
) -> DataFrame:
    """For distinct values: ``<w>_before`` (sum over smaller values),
    ``<w>_total`` and ``next_value`` in each ``by`` group."""
    by = list(by)
    ranged = into_ranges(counts, by, value, weights, per_range)
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    following = W.partitionBy(*by).orderBy("_range")
    # at most most_ranges() rows a group
    offsets = (
        ranged.groupBy(*by, "_range")
        .agg(
            F.min(value).alias("_first"),
            *[F.sum(w).alias(f"_{w}") for w in weights],
        )
        .select(
            *by,
            "_range",
            F.lead("_first").over(following).alias("_next_first"),
            *[F.coalesce(F.sum(f"_{w}").over(earlier), F.lit(0)).alias(f"_{w}_offset") for w in weights],
        )
    )
    inside = W.partitionBy(*by, "_range").orderBy(value)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged.withColumns({
            "_lead": F.lead(value).over(inside),
            **{f"_{w}_near": F.coalesce(F.sum(w).over(before), F.lit(0)) for w in weights},
        })
        .join(F.broadcast(offsets), [*by, "_range"])
        .withColumns({
            "next_value": F.coalesce("_lead", "_next_first"),
            **{f"{w}_before": F.col(f"_{w}_offset") + F.col(f"_{w}_near") for w in weights},
        })
        .drop("_range", "_lead", "_next_first", *[f"_{w}_{x}" for w in weights for x in ("offset", "near")])
    )


def ranked_where(
    counts: DataFrame, by: Sequence[str], value: str, wanted: Callable[[Column, Column, Column], Column], per_range: int = VALUES_PER_RANGE,
) -> DataFrame:
    """Distinct values with ``n_before`` and ``n_total``, only of the ranges that are ``wanted``:
    a condition on the rows before a range, the rows in it and all rows. Every range is
    added up, but only the wanted ones are ordered."""
    by = list(by)
    ranged = into_ranges(counts, by, value, ["n"], per_range)
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    # at most most_ranges() rows a group
    sizes = ranged.groupBy(*by, "_range").agg(F.sum("n").alias("_held"), F.first("n_total").alias("_all"))
    chosen = sizes.withColumn("_base", F.coalesce(F.sum("_held").over(earlier), F.lit(0))).where(
        wanted(F.col("_base"), F.col("_held"), F.col("_all"))
    )
    inside = W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    met = ranged.join(F.broadcast(chosen.select(*by, "_range", "_base")), [*by, "_range"])
    before = F.col("_base") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return met.withColumn("n_before", before).drop("_range", "_base")


def quantiles(counts: DataFrame, by: Sequence[str], shares: dict[str, float], value: str = "value") -> DataFrame:
    """Exact linearly interpolated quantiles: one row per group, one column
    per entry of ``shares``, plus ``count``."""
    def held(before: Column, rows: Column, total: Column) -> Column:
        places = [p for share in shares.values() for p in (F.floor(F.lit(share) * (total - 1)), F.ceil(F.lit(share) * (total - 1)))]
        return reduce(or_, [(before <= p) & (p < before + rows) for p in places])

    ranked = ranked_where(counts, by, value, held)

    def value_at(index: Column) -> Column:
        here = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))
        return F.max(F.when(here, F.col(value)))

    picks, results = [], []
    for name, share in shares.items():
        position = F.lit(share) * (F.col("n_total") - 1)
        picks += [
            value_at(F.floor(position)).alias(f"_{name}_low"),
            value_at(F.ceil(position)).alias(f"_{name}_high"),
        ]
        exact = F.lit(share) * (F.col("count") - 1)
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        results.append((low + (high - low) * (exact - F.floor(exact))).alias(name))
    return (
        ranked.groupBy(*by)
        .agg(F.max("n_total").alias("count"), *picks)
        .select(*by, "count", *results)
    )


def even_quantiles(
    counts: DataFrame, by: Sequence[str], points: Column, value: str = "value", per_range: int = VALUES_PER_RANGE,
) -> DataFrame:
    """``points`` evenly spaced quantiles per group as (by..., point, value).

    Ranges between two points are added up and not ordered; every distinct value
    emits only the points it answers, so the work grows with the values and the
    output, not with their product.
    """
    def spacing(total: Column) -> Column:
        return F.when(points > 1, (total - 1) / (points - 1)).otherwise(0.0)

    def held(before: Column, rows: Column, total: Column) -> Column:
        step = spacing(total)
        first, final = F.ceil((before - 1) / step), F.floor((before + rows) / step)
        return F.when(step > 0, first <= final).otherwise(before == 0)

    ranked = ranked_where(counts, by, value, held, per_range).withColumn("_points", points)
    step = spacing(F.col("n_total"))
    last = F.col("_points") - 1
    first = F.when(step > 0, F.floor((F.col("n_before") - 1) / step)).otherwise(0)
    final = F.when(step > 0, F.ceil((F.col("n_before") + F.col("n")) / step)).otherwise(last)
    candidate = F.explode(F.sequence(
        F.greatest(first, F.lit(0)).cast("bigint"),
        F.greatest(F.least(final, last), F.greatest(first, F.lit(0))).cast("bigint"),
    ))
    position = F.col("point") * F.col("_step")
    inside = lambda i: (F.col("n_before") <= i) & (i < F.col("n_before") + F.col("n"))
    hits = (
        ranked.withColumn("_step", step)
        .withColumn("point", candidate)
        .where((F.col("point") <= last))
        .withColumn("_low", F.floor(F.least(position, F.col("n_total") - 1.0)))
        .withColumn("_high", F.least(F.ceil(position), F.col("n_total") - 1))
        .where(inside(F.col("_low")) | inside(F.col("_high")))
        .withColumn("_part", position - F.col("_low"))
    )
    low = F.max(F.when(inside(F.col("_low")), F.col(value)))
    high = F.max(F.when(inside(F.col("_high")), F.col(value)))
    return (
        hits.groupBy(*by, "point")
        .agg(low.alias("_lo"), high.alias("_hi"), F.max("_part").alias("_part"))
        .select(*by, "point", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias("value"))
    )


def number_rows(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``, the 0-based place of each row within its group in the order of ``order``.

    One range partitioning orders all groups; a row's number is its place in its part
    plus the rows of its group in earlier parts, so no group is one task's work.
    """
    by = list(by)
    columns = rows.columns
    at = F.monotonically_increasing_id()
    parted = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    parted = materialize(parted.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    stretches = parted.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_held"), F.min("_at").alias("_first"))
    # one row per group and part
    bases = stretches.select(*[F.col(b).alias(f"_b{b}") for b in by], F.col("_part").alias("_b_part"), (F.coalesce(F.sum("_held").over(earlier), F.lit(0)) - F.col("_first")).alias("_base"))
    met = F.col("_part") == F.col("_b_part")
    for b in by:
        met = met & F.col(b).eqNullSafe(F.col(f"_b{b}"))
    return parted.join(bases, met).select(*columns, (F.col("_at") + F.col("_base")).alias(name))
