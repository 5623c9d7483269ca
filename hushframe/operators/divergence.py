"""Distances between distributions, all groups of a table at once.

A distribution pair is a DataFrame (by..., p, q) with one row per category;
``p`` and ``q`` may be counts, they are normalised here.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hushframe.operators.compare import shares_of
from hushframe.operators.ordered import cumulate, no_nan, number_rows
from hushframe.operators.pairs import (
    complete, number, pair_cells, side_columns, side_counts, text,
)
from hushframe.operators.profile import top_per_column
from hushframe.session import materialize

# Probabilities below the first count as zero; the second is
# added against log(0), to probabilities and to histogram counts alike.
MIN_PROBABILITY = 1e-15
SMOOTHING = 1e-10


def distribution(
    cells: DataFrame, by: Sequence[str] = ("column",), categories: DataFrame | None = None
) -> DataFrame:
    """(by..., value, n_o, n_p, p, q) of the pairs (o, p). With ``categories``
    (by..., value) those are listed too where neither side has them, with zeros."""
    counts = side_counts(cells, by)
    if categories is not None:
        none = F.lit(0).cast("bigint")
        listed = categories.select(*by, "value").where("value is not null").distinct()
        counts = counts.unionByName(listed.select(*by, "value", none.alias("n_o"), none.alias("n_p"))).groupBy(*by, "value").agg(
            F.sum("n_o").alias("n_o"), F.sum("n_p").alias("n_p"),
        )
    return counts.withColumns({
        "p": F.col("n_o").cast("double"), "q": F.col("n_p").cast("double"),
    })


def _log_base(base: str) -> float:
    if base not in ("e", "2"):
        raise ValueError("base is 'e' or '2'")
    return math.log(2) if base == "2" else 1.0


def divergences(
    pairs: DataFrame,
    by: Sequence[str] = ("column",),
    kl_base: str = "e",
    js_base: str = "2",
    entropy_base: str = "2",
    smoothing: float = SMOOTHING,
) -> DataFrame:
    """KL, JS, total variation, Hellinger, both entropies, cross entropy."""
    by = list(by)
    totals = pairs.groupBy(*by).agg(
        F.sum("p").alias("_sp"), F.sum("q").alias("_sq"),
        F.min("q").alias("_least_q"), F.count(F.lit(1)).alias("_k"),
    )
    p, q = F.col("_p"), F.col("_q")
    smooth = F.col("_least_q") / F.col("_sq") < MIN_PROBABILITY
    shares = (
        pairs.join(F.broadcast(totals), by)
        .withColumns({"_p": F.col("p") / F.col("_sp"), "_q": F.col("q") / F.col("_sq")})
        .withColumn(
            "_qs", F.when(smooth, (q + smoothing) / (1 + F.col("_k") * smoothing)).otherwise(q)
        )
    )
    middle = (p + q) / 2

    def term(share: Column, value: Column) -> Column:
        return F.sum(F.when(share > MIN_PROBABILITY, value).otherwise(0.0))

    def toward_middle(share: Column) -> Column:
        return F.sum(F.when(share > 0, share * F.ln(share / middle)).otherwise(0.0))

    kl_unit, js_unit, h_unit = _log_base(kl_base), _log_base(js_base), _log_base(entropy_base)
    sums = shares.groupBy(*by).agg(
        term(p, p * F.ln(p / F.col("_qs"))).alias("_kl"),
        (0.5 * toward_middle(p) + 0.5 * toward_middle(q)).alias("_js"),
        (0.5 * F.sum(F.abs(p - q))).alias("tvd"),
        F.sqrt(0.5 * F.sum(F.pow(F.sqrt(p) - F.sqrt(q), 2))).alias("hellinger_distance"),
        (-term(p, p * F.ln(p))).alias("_hp"),
        (-term(q, q * F.ln(q))).alias("_hq"),
    )
    js = F.greatest(F.col("_js") / js_unit, F.lit(0.0))
    return sums.select(
        *by,
        (F.col("_kl") / kl_unit).alias("kl_divergence"),
        F.sqrt(js).alias("js_distance"),
        js.alias("js_divergence"),
        "tvd",
        "hellinger_distance",
        (F.col("_hp") / h_unit).alias("entropy_original"),
        (F.col("_hq") / h_unit).alias("entropy_protected"),
        ((F.col("_hp") + F.col("_kl")) / h_unit).alias("cross_entropy"),
    )


def _widened(ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    """A single value gets half a unit each way."""
    half = F.when(F.col("_lo") == F.col("_hi"), 0.5).otherwise(0.0)
    return ranges.where(F.col("_lo").isNotNull()).select(
        *by, (F.col("_lo") - half).alias("low"), (F.col("_hi") + half).alias("high")
    )


def histogram_bounds(cells: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """Common range of both sides."""
    low, high = F.min(F.least("o", "p")), F.max(F.greatest("o", "p"))
    return _widened(cells.groupBy(*by).agg(low.alias("_lo"), high.alias("_hi")), by)


def bin_of(value: Column, low: Column, high: Column, bins: Column) -> Column:
    """1-based bin; the last bin is closed on the right."""
    # least alone would put a null into the last bin
    return F.when(value.isNotNull(), F.least(F.width_bucket(value, low, high, bins), bins))


def histogram(
    cells: DataFrame, bins: int | DataFrame = 50, by: Sequence[str] = ("column",), masked: bool = True
) -> DataFrame:
    """Equal-width bins over the common range: (by..., bin, bin_low, bin_high,
    n_o, n_p). ``bins`` is a number, and empty bins are listed too; or a table
    (by..., low, high, bins), whose numbers come from the data and have no
    bound, so that only bins with a row on some side are listed."""
    by = list(by)
    cells = complete(cells) if masked else cells
    if isinstance(bins, DataFrame):
        ranges = bins
    else:
        ranges = histogram_bounds(cells, by).withColumn("bins", F.lit(bins).cast("bigint"))
    low, high, count = F.col("low"), F.col("high"), F.col("bins")
    found = (
        cells.join(F.broadcast(ranges), by)
        .select(*by, F.inline(F.array(
            F.struct(bin_of(F.col("o"), low, high, count).alias("bin"), F.lit(1).alias("_o"), F.lit(0).alias("_p")),
            F.struct(bin_of(F.col("p"), low, high, count).alias("bin"), F.lit(0).alias("_o"), F.lit(1).alias("_p")),
        )))
        .where(F.col("bin").isNotNull())
        .groupBy(*by, "bin").agg(F.sum("_o").alias("n_o"), F.sum("_p").alias("n_p"))
    )
    if isinstance(bins, DataFrame):
        return _with_edges(found.join(F.broadcast(ranges), by), by, "n_o", "n_p")
    return _with_empty_bins(found, ranges, by)


def histogram_of_counts(counts: DataFrame, bins: int = 50, by: Sequence[str] = ("column",)) -> DataFrame:
    """The same histogram from (by..., value, n_o, n_p), where those counts
    are needed anyway."""
    by = list(by)
    # the sums keep this branch on the same shuffled counts as the next one
    ends = counts.groupBy(*by).agg(
        F.min(F.when(F.col("n_o") + F.col("n_p") > 0, F.col("value"))).alias("_lo"),
        F.max(F.when(F.col("n_o") + F.col("n_p") > 0, F.col("value"))).alias("_hi"),
    )
    ranges = _widened(ends, by).withColumn("bins", F.lit(bins).cast("bigint"))
    found = (
        counts.join(F.broadcast(ranges), by)
        .groupBy(*by, bin_of(F.col("value"), F.col("low"), F.col("high"), F.col("bins")).alias("bin"))
        .agg(F.sum("n_o").alias("n_o"), F.sum("n_p").alias("n_p"))
    )
    return _with_empty_bins(found, ranges, by)


def _with_empty_bins(found: DataFrame, ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    frame = _with_edges(ranges.withColumn("bin", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("bins")))), by)
    return frame.join(found, [*by, "bin"], "left").fillna(0, ["n_o", "n_p"])


def _with_edges(numbered: DataFrame, by: Sequence[str], *rest: str) -> DataFrame:
    low, width = F.col("low"), (F.col("high") - F.col("low")) / F.col("bins")
    return numbered.select(
        *by, "bin",
        (low + (F.col("bin") - 1) * width).alias("bin_low"),
        (low + F.col("bin") * width).alias("bin_high"), *rest,
    )


def side_cdfs(counts: DataFrame, by: Sequence[str] = ("column",), w_o: str = "n_o", w_p: str = "n_p") -> DataFrame:
    """Both cumulative shares at every value, and the gap to the next value."""
    summed = cumulate(counts, by, "value", [w_o, w_p])
    return summed.select(
        *by, "value",
        ((F.col(f"{w_o}_before") + F.col(w_o)) / F.col(f"{w_o}_total")).alias("cdf_o"),
        ((F.col(f"{w_p}_before") + F.col(w_p)) / F.col(f"{w_p}_total")).alias("cdf_p"),
        (F.col("next_value") - F.col("value")).alias("gap"),
        F.col(f"{w_o}_total").alias("total_o"),
        F.col(f"{w_p}_total").alias("total_p"),
    )


def transport(counts: DataFrame, by: Sequence[str] = ("column",), w_o: str = "n_o", w_p: str = "n_p") -> DataFrame:
    """1-Wasserstein distance and the two-sample Kolmogorov-Smirnov test with
    its asymptotic p-value, from one pass over (by..., value, w_o, w_p)."""
    apart = F.abs(F.col("cdf_o") - F.col("cdf_p"))
    n, m = F.max("total_o"), F.max("total_p")
    found = side_cdfs(counts, by, w_o, w_p).groupBy(*by).agg(
        F.coalesce(F.sum(apart * F.col("gap")), F.lit(0.0)).alias("wasserstein"),
        F.max(apart).alias("ks_statistic"),
        F.sqrt(n / (n + m) * m).alias("_root"),
    )
    return found.select(
        *by, "wasserstein", "ks_statistic",
        kolmogorov_tail(F.col("ks_statistic") * F.col("_root")).alias("ks_pvalue"),
    )


def weighted_transport(
    original: DataFrame, protected: DataFrame, by: Sequence[str] = ("column",), value: str = "value", weight: str = "weight",
) -> DataFrame:
    """(by..., wasserstein, ks_statistic) between two weighted samples (by..., value, weight).

    Weights are real numbers of any scale and are normalised per group and side; equal
    values merge before anything is ordered. Rows without a value or a weight are left
    out, a negative, NaN or infinite weight is an error. A group in which a side has no weight has
    distance zero, as it has without samples.
    """
    by = list(by)
    mass = F.col(f"`{weight}`").cast("double")
    sound = F.when((mass >= 0) & (mass < float("inf")), mass).otherwise(
        F.when(mass.isNotNull(), F.raise_error(F.lit("a weight is negative or not finite")).cast("double")))
    zero = F.lit(0.0)
    sides = [
        side.select(*by, no_nan(F.col(f"`{value}`").cast("double")).alias("value"), *[(sound if w == k else zero).alias(f"w_{w}") for w in "op"])
        for side, k in ((original, "o"), (protected, "p"))
    ]
    known = sides[0].unionByName(sides[1]).where("value is not null and w_o is not null and w_p is not null")
    # sums of doubles: value_counts would round them to whole rows
    counts = known.groupBy(*by, "value").agg(F.sum("w_o").alias("w_o"), F.sum("w_p").alias("w_p"))
    held = counts.groupBy(*by).agg(F.sum("w_o").alias("_o"), F.sum("w_p").alias("_p"))
    weighed = counts.join(held.where("_o > 0 and _p > 0").select(*by), by, "left_semi")
    moved = transport(weighed, by, "w_o", "w_p").select(*by, "wasserstein", "ks_statistic")
    return held.select(*by).join(moved, by, "left").fillna(0.0, ["wasserstein", "ks_statistic"])


def kolmogorov_tail(x: Column) -> Column:
    """Pr(K > x). The alternating series converges fast from 1 on; below, the
    theta-function form of the same law does."""
    safe = F.greatest(x, F.lit(1e-3))
    upper, lower = F.lit(0.0), F.lit(0.0)
    for j in range(1, 6):
        upper = upper + F.lit(2.0 * (-1) ** (j - 1)) * F.exp(-2.0 * j * j * x * x)
        lower = lower + F.exp(-((2 * j - 1) ** 2) * math.pi**2 / (8 * safe * safe))
    below = 1 - F.lit(math.sqrt(2 * math.pi)) / safe * lower
    tail = F.when(x < 0.04, 1.0).when(x < 1, below).otherwise(upper)
    return F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0))


def numeric_drift(paired: DataFrame, columns: Sequence[str] | None = None, bins: int = 50) -> DataFrame:
    """Wasserstein, KS, KL and JS in bits and TVD over common bins, mean shift
    in original deviations, deviation ratio."""
    columns = list(columns or side_columns(paired, "numeric"))
    cells = pair_cells(paired, columns, number)
    known, counts = complete(cells), side_counts(cells)
    binned = histogram_of_counts(counts, bins)
    smoothed = binned.withColumns({"p": F.col("n_o") + SMOOTHING, "q": F.col("n_p") + SMOOTHING})
    shapes = divergences(smoothed, kl_base="2").select("column", "kl_divergence", "js_distance")
    plain = binned.withColumns({"p": F.col("n_o").cast("double"), "q": F.col("n_p").cast("double")})
    moved = divergences(plain).select("column", "tvd")
    moments = known.groupBy("column").agg(
        F.avg("o").alias("_mo"), F.avg("p").alias("_mp"),
        *[F.when(F.min(c) == F.max(c), 0.0).otherwise(F.stddev_pop(c)).alias(f"_s{c}") for c in ("o", "p")],
        (F.min("o") == F.max("p")).alias("_same"),  # two constants: the merged means may differ in the last bit
    )
    endless = F.lit(float("inf"))
    shift = F.when(F.col("_so") > 0, F.try_divide(F.col("_mp") - F.col("_mo"), F.col("_so"))).otherwise(
        F.when((F.col("_mo") == F.col("_mp")) | ((F.col("_sp") == 0) & F.col("_same")), 0.0).otherwise(endless)
    )
    ratio = F.when(F.col("_so") > 0, F.try_divide(F.col("_sp"), F.col("_so"))).otherwise(
        F.when(F.col("_sp") == 0, 1.0).otherwise(endless)
    )
    listed = paired.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    # a column without a complete pair is no distance away from itself
    return (
        listed.join(transport(counts), "column", "left")
        .join(F.broadcast(shapes), "column", "left")
        .join(F.broadcast(moved), "column", "left")
        .join(F.broadcast(moments), "column", "left")
        .select(
            "column",
            F.coalesce("wasserstein", F.lit(0.0)).alias("wasserstein"),
            F.coalesce("ks_statistic", F.lit(0.0)).alias("ks_statistic"),
            F.coalesce("ks_pvalue", F.lit(1.0)).alias("ks_pvalue"),
            "kl_divergence", "js_distance", "tvd",
            F.when(F.col("_mo").isNull(), 0.0).otherwise(shift).alias("mean_shift"),
            F.when(F.col("_mo").isNull(), 1.0).otherwise(ratio).alias("std_ratio"),
        )
    )


#: Code points of a category by which categories are dealt out, and categories that may share them.
PREFIX = 64
SHARED = 50_000


def category_index(counts: DataFrame, by: Sequence[str] = ("column",), shared: int = SHARED) -> DataFrame:
    """Adds ``index``, the 0-based place of a category in sorted order.

    Categories are range-partitioned by their first PREFIX code points; beginnings that
    more than ``shared`` categories have in common go on by the next PREFIX, until no
    beginning does. Only such beginnings are sampled for the borders, never whole
    categories, and no task orders more than its range.
    """
    by = list(by)
    # read by each step below
    rows = materialize(counts)
    prefixes: list[str] = []
    crowded = None
    while True:
        name, start = f"_p{len(prefixes)}", 1 + PREFIX * len(prefixes)
        piece = F.substring("value", start, PREFIX)
        if crowded is None:
            rows = rows.withColumn(name, piece)
        else:
            # beginnings shared by many: at most one for every ``shared`` categories
            rows = rows.join(crowded, [*by, *prefixes], "left").withColumn(name, F.when(F.col("_crowded"), piece).otherwise("")).drop("_crowded")
        prefixes.append(name)
        crowded = materialize(
            rows.where(F.length(name) == PREFIX).groupBy(*by, *prefixes).agg(F.count(F.lit(1)).alias("_k"))
            .where(F.col("_k") > shared).select(*by, *prefixes, F.lit(True).alias("_crowded"))
        )
        if crowded.isEmpty():
            break
    return number_rows(rows, by, [*prefixes, "value"], "index").drop(*prefixes)


def category_drift(
    paired: DataFrame, columns: Sequence[str] | None = None, include_wasserstein: bool = False
) -> DataFrame:
    """Drift rate, KL, JS and TVD in bits, entropies per column."""
    columns = list(columns or side_columns(paired, "categorical"))
    cells = pair_cells(paired, columns, text)
    both = F.col("o").isNotNull() & F.col("p").isNotNull()
    rates = cells.groupBy("column").agg(
        F.coalesce(F.avg(F.when(both, (F.col("o") != F.col("p")).cast("int"))), F.lit(0.0)).alias("drift_rate")
    )
    counts = distribution(cells)
    shapes = divergences(counts, kl_base="2").select(
        "column", "kl_divergence", "js_distance", "tvd", "entropy_original", "entropy_protected"
    )
    filled = ["kl_divergence", "js_distance", "tvd", "entropy_original", "entropy_protected"]
    result = rates.join(F.broadcast(shapes), "column", "left").fillna(0.0, filled).withColumn(
        "entropy_difference", F.col("entropy_protected") - F.col("entropy_original")
    )
    if include_wasserstein:
        places = category_index(counts).select(
            "column", F.col("index").cast("double").alias("value"), "n_o", "n_p"
        )
        result = result.join(
            F.broadcast(transport(places).select("column", "wasserstein")), "column", "left"
        )
    return result


def top_changes(paired: DataFrame, columns: Sequence[str] | None = None, top_n: int = 10, masked: bool = True) -> DataFrame:
    """The categories whose share moved most: (column, rank, value, original,
    protected, difference)."""
    columns = list(columns or side_columns(paired, "categorical"))
    counts = shares_of(side_counts(pair_cells(paired, columns, text), masked=masked))
    moved = counts.withColumns({
        "difference": F.col("p_p") - F.col("p_o"),
        "n": F.round(F.abs(F.col("p_p") - F.col("p_o")), 12),
    })
    return top_per_column(moved, top_n).select(
        "column", "rank", "value", F.col("p_o").alias("original"),
        F.col("p_p").alias("protected"), "difference",
    )


def all_divergences(
    paired: DataFrame,
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    bins: int = 50,
) -> DataFrame:
    """KL, JS, Wasserstein and TVD per column as (column, metric, value,
    is_symmetric, unit). KL is in nats for categories and in bits for numbers."""
    parts = []
    if numeric:
        drift = numeric_drift(paired, numeric, bins)
        parts.append(
            drift.select("column", "kl_divergence", "js_distance", "wasserstein", "tvd")
            .withColumn("_unit", F.lit("bits"))
        )
    if categorical:
        shapes = divergences(distribution(pair_cells(paired, list(categorical), text)))
        parts.append(shapes.select(
            "column", "kl_divergence", "js_distance",
            F.lit(None).cast("double").alias("wasserstein"), "tvd", F.lit("nats").alias("_unit"),
        ))
    table = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    lines = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(s).alias("is_symmetric"), u.alias("unit"))
        for m, s, u in (
            ("kl_divergence", False, F.col("_unit")),
            ("js_distance", True, F.lit("bits")),
            ("wasserstein", True, F.lit("value")),
            ("tvd", True, F.lit("probability")),
        )
    ])
    return table.select("column", F.inline(lines)).where(
        ~((F.col("metric") == "wasserstein") & F.col("value").isNull())
    )
