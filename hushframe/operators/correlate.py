"""Correlation matrices as (column1, column2, n, correlation)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from hushframe.functions.search import count_where_prefix
from hushframe.operators.ordered import cumulate
from hushframe.operators.protect import present
from hushframe.session import materialize

# a value held by more than one row in HOT_SHARE is looked up from the plan
HOT_SHARE = 500
#: Distinct values of a column whose ranks are looked up from a broadcast table.
FEW_VALUES = 50_000


#: Up to so many columns each row emits its pairs; beyond, matrix products are cheaper.
NARROW = 24


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper triangle, pairwise complete; null where a side is constant.

    Sums per pair leave each task, so what is shuffled does not depend on the number of rows.
    """
    names = list(columns)
    return _pearson_by_pair(df, names) if len(names) <= NARROW else _pearson_by_matrix(df, names)


def _pearson_by_pair(df: DataFrame, names: list[str]) -> DataFrame:
    values = {c: present(df, c).cast("double") for c in names}
    pairs = list(combinations(names, 2))
    cells = F.array(*[F.struct(F.lit(k).alias("pair"), values[a].alias("x"), values[b].alias("y")) for k, (a, b) in enumerate(pairs)])
    both = df.select(F.inline(cells)).where("x is not null and y is not null")
    sums = both.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("cov"), F.var_pop("x").alias("var_x"), F.var_pop("y").alias("var_y"),
        *[f(c).alias(f"{name}{c}") for c in ("x", "y") for f, name in ((F.min, "l"), (F.max, "h"))],
    )
    listed = df.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "pair int, column1 string, column2 string")
    # merged variances of a constant are not exactly zero
    defined = (F.col("lx") < F.col("hx")) & (F.col("ly") < F.col("hy")) & (F.col("var_x") > 0) & (F.col("var_y") > 0)
    return listed.join(sums, "pair", "left").select(
        "column1", "column2", F.coalesce("n", F.lit(0)).alias("n"),
        F.when(defined, F.col("cov") / F.sqrt(F.col("var_x") * F.col("var_y"))).alias("correlation"),
    )


def _pearson_by_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """One matrix product per Arrow batch; a task emits one row per pair."""
    rows = df.select(*[present(df, c).cast("double").alias(c) for c in names])
    # values are shifted near their mean so that the sums do not cancel
    means = rows.agg(*[F.avg(f"`{c}`").alias(c) for c in names]).first()
    shift = np.array([means[c] if means[c] is not None else 0.0 for c in names])
    schema = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double, lx double, hx double, ly double, hy double"
    left, right = np.triu_indices(len(names), 1)

    def extremes(data: np.ndarray, seen: np.ndarray) -> list[np.ndarray]:
        """Smallest and largest value of each column over the rows where another is known."""
        low, high = np.where(seen, data, np.inf), np.where(seen, data, -np.inf)
        out = [np.empty((len(names), len(names))), np.empty((len(names), len(names)))]
        for j in range(len(names)):
            rows = seen[:, j]
            whole = rows.all()
            out[0][:, j] = (low if whole else low[rows]).min(axis=0, initial=np.inf)
            out[1][:, j] = (high if whole else high[rows]).max(axis=0, initial=-np.inf)
        return out

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = None
        for batch in batches:
            data = batch.to_numpy(dtype=float, na_value=np.nan) - shift
            seen = ~np.isnan(data)
            low, high = extremes(data, seen)
            data = np.where(seen, data, 0.0)
            mask, square = seen.astype(float), data * data
            found = [mask.T @ mask, data.T @ mask, square.T @ mask, data.T @ data]
            if totals is None:
                totals = [*found, low, high]
            else:
                totals = [a + b for a, b in zip(totals, found)] + [np.minimum(totals[4], low), np.maximum(totals[5], high)]
        if totals is not None:
            n, s, ss, sxy, low, high = totals
            yield pd.DataFrame({
                "i": left, "j": right, "n": n[left, right],
                "sx": s[left, right], "sy": s[right, left],
                "sxx": ss[left, right], "syy": ss[right, left], "sxy": sxy[left, right],
                "lx": low[left, right], "hx": high[left, right], "ly": low[right, left], "hy": high[right, left],
            })

    sums = (
        rows.mapInPandas(moments, schema)
        .groupBy("i", "j")
        .agg(
            *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")],
            *[f(c).alias(c) for f, c in ((F.min, "lx"), (F.max, "hx"), (F.min, "ly"), (F.max, "hy"))],
        )
    )
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    var_x = F.col("sxx") - F.col("sx") * F.col("sx") / n
    var_y = F.col("syy") - F.col("sy") * F.col("sy") / n
    defined = (F.col("lx") < F.col("hx")) & (F.col("ly") < F.col("hy")) & (var_x > 0) & (var_y > 0)
    named = F.array(*[F.lit(c) for c in names])
    return sums.select(
        F.get(named, F.col("i")).alias("column1"),
        F.get(named, F.col("j")).alias("column2"),
        n.cast("bigint").alias("n"),
        F.when(defined, cov / F.sqrt(var_x * var_y)).alias("correlation"),
    )


def average_ranks(counts: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Distinct values with the mean of the 1-based positions they occupy."""
    return cumulate(counts, by, value, ["n"]).select(
        *by, value, "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank")
    )


def hot_values(counts: DataFrame, value: str) -> list:
    """The at most HOT_SHARE values with more than 1/HOT_SHARE of the rows."""
    total = counts.agg(F.sum("n")).scalar()
    return [r[0] for r in counts.where(F.col("n") * HOT_SHARE > total).select(value).collect()]


def lookup(
    rows: DataFrame, value: str, table: DataFrame, result: str, hot: list, spread: Column
) -> DataFrame:
    """``rows`` with ``result`` of the matching row of ``table`` (value, result).

    Rows with a hot value find it in a broadcast table of the hot values. In
    the shuffled join they carry keys that match nothing and spread over all
    tasks, so that no task receives a hot value.
    """
    if not hot:
        return rows.join(table.select(value, result), value)
    is_hot = F.col(value).isin(hot)
    off = F.lit(0).cast("bigint")
    keyed = rows.withColumn(
        "_slot", F.when(is_hot, 1 + F.pmod(spread, F.lit(1 << 20))).otherwise(off)
    )
    few = table.where(is_hot).select(value, F.col(result).alias("_hot"))
    rest = table.where(~is_hot).select(value, F.col(result).alias("_cold"), off.alias("_slot"))
    return (
        keyed.join(F.broadcast(few), value, "left")
        .join(rest, [value, "_slot"], "left")
        .withColumn(result, F.coalesce("_hot", "_cold"))
        .drop("_hot", "_cold", "_slot")
    )


def counted_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """(x, y, w): how often each pair of values occurs, written once because
    ranks and the joint table both start from it."""
    x, y = present(df, a).cast("double").alias("x"), present(df, b).cast("double").alias("y")
    pairs = df.select(x, y).where("x is not null and y is not null")
    return materialize(pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")))


def side_of(pairs: DataFrame, side: str) -> DataFrame:
    return pairs.groupBy(side).agg(F.sum("w").alias("n")).select(
        F.lit(side).alias("column"), F.col(side).alias("value"), "n", F.lit(1).alias("one")
    )


def column_ranks(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns of ``df`` replaced by the average ranks of their known values.

    All columns are ranked together by one value count and one cumulation. The ranks of a
    column of few distinct values are looked up in a broadcast table; only a column of
    more deals the rows by its value, one shuffle of the rows for each.
    """
    values = [present(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]
    rows = df.select(*values)
    cells = rows.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("column"), F.col(f"c{i}").alias("value")) for i in range(len(names))
    ]))).where("value is not null")
    counts = materialize(cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    ranks = materialize(average_ranks(counts, ["column"]))
    sizes = {r["column"]: r for r in counts.groupBy("column").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).collect()}
    many = [i for i in range(len(names)) if i in sizes and sizes[i]["distinct"] > FEW_VALUES]
    for i in [i for i in range(len(names)) if i not in many] + many:
        value, rank = f"c{i}", f"r{i}"
        mine = ranks.where(F.col("column") == i).select(F.col("value").alias(value), F.col("rank").alias(rank), "n")
        if i not in many:
            rows = rows.join(F.broadcast(mine.drop("n")), value, "left").drop(value)
            continue
        # at most HOT_SHARE values are hot: their rows are answered from a broadcast table, and those and
        # rows without a value carry keys that match nothing through the shuffled join
        least, off = sizes[i]["n"] // HOT_SHARE, F.lit(0).cast("bigint")
        hot = mine.where(F.col("n") > least).select(value, F.col(rank).alias("_hot"))
        cold = mine.where(F.col("n") <= least).select(value, rank, off.alias("_slot"))
        others = [c for c in rows.columns if c != value]
        spread = 1 + F.pmod(F.xxhash64(*others), F.lit(1 << 20))
        known = rows.join(F.broadcast(hot), value, "left")
        slot = F.when(F.col("_hot").isNotNull() | F.col(value).isNull(), spread).otherwise(off)
        rows = known.withColumn("_slot", slot).join(cold, [value, "_slot"], "left").select(*others, F.coalesce("_hot", rank).alias(rank))
    return rows.select(*[F.col(f"r{i}").alias(c) for i, c in enumerate(names)])


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson on average ranks, taken within the complete rows of each pair.

    Each column is ranked once and one matrix product over the ranks serves all pairs
    without gaps. A pair of which one column is null where the other is not has
    ranks of its own: those pairs, and only they, are ranked one by one.
    """
    names = list(columns)
    if len(names) == 2:  # one pair: its own ranks are all there is to take
        return _spearman_pair(df, *names)
    known = df.agg(*[F.count(present(df, c)).alias(f"n{i}") for i, c in enumerate(names)]).first()
    sizes = {c: known[i] for i, c in enumerate(names)}
    ranked = materialize(column_ranks(df, names))
    # ranks are finite, so a matrix product of them is safe; a row emits no pairs
    whole = materialize(_pearson_by_matrix(ranked, names))
    gaps = [(r["column1"], r["column2"]) for r in whole.collect() if not r["n"] == sizes[r["column1"]] == sizes[r["column2"]]]
    if not gaps:
        return whole
    gapped = F.array(*[F.struct(F.lit(a).alias("column1"), F.lit(b).alias("column2")) for a, b in gaps])
    result = whole.where(~F.array_contains(gapped, F.struct(F.col("column1"), F.col("column2"))))
    for a, b in gaps:
        result = result.unionByName(_spearman_pair(df, a, b))
    return result


def _spearman_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """One pair ranked within its complete rows, pairs of values counted first."""
    ranked = pairs = counted_pairs(df, a, b)
    for side in ("x", "y"):
        counts = side_of(pairs, side)
        table = average_ranks(counts, ["column"]).select(
            F.col("value").alias(side), F.col("rank").alias(f"rank_{side}")
        )
        ranked = lookup(ranked, side, table, f"rank_{side}", hot_values(counts, "value"), F.xxhash64("x", "y"))
    return _weighted_corr(ranked, "rank_x", "rank_y", "w", a, b)


def _weighted_corr(rows: DataFrame, x: str, y: str, w: str, a: str, b: str) -> DataFrame:
    # ranks average (n + 1) / 2 exactly, so the centre needs no pass of its own
    n = F.sum(w)
    sums = rows.agg(
        n.alias("n"),
        *[
            F.sum(F.col(w) * F.col(p) * F.col(q)).alias(name)
            for p, q, name in ((x, x, "xx"), (y, y, "yy"), (x, y, "xy"))
        ],
    )
    centre = F.col("n") * F.pow((F.col("n") + 1) / 2, 2)
    var_x, var_y, cov = F.col("xx") - centre, F.col("yy") - centre, F.col("xy") - centre
    return sums.select(
        F.lit(a).alias("column1"), F.lit(b).alias("column2"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.when((var_x > 0) & (var_y > 0), cov / F.sqrt(var_x * var_y)).alias("correlation"),
    )


#: Distinct points a task compares at once, and ranges a side of more points is cut into.
POINTS = 250_000
RANGES = 128
WIDE = "decimal(38,0)"


def kendall(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Kendall tau-b, exact, all pairs of columns in the same jobs.

    Discordant pairs are counted without forming pairs (``discordant``); ties come
    from the value counts of each pair's complete rows.
    """
    names = list(columns)
    values = [present(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]
    rows = df.select(*values)
    chosen = list(combinations(range(len(names)), 2))
    cells = F.array(*[
        F.struct(F.lit(k).alias("pair"), F.col(f"c{i}").alias("x"), F.col(f"c{j}").alias("y")) for k, (i, j) in enumerate(chosen)
    ])
    points = rows.select(F.inline(cells)).where("x is not null and y is not null").groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    points = materialize(points)

    def ties(counts: DataFrame, name: str) -> DataFrame:
        """Pairs of rows inside groups of equal values."""
        m = F.col("w").cast(WIDE)
        return counts.groupBy("pair").agg((F.sum((m * (m - 1)).cast(WIDE)).cast("double") / 2).alias(name))

    sums = points.groupBy("pair").agg(F.sum("w").cast("double").alias("n"))
    for by, name in ((["x"], "tx"), (["y"], "ty")):
        sums = sums.join(ties(points.groupBy("pair", *by).agg(F.sum("w").alias("w")), name), "pair")
    sums = sums.join(ties(points, "txy"), "pair")
    crossed = discordant(points.select(F.col("pair").cast("bigint").alias("group"), "x", "y", "w")).select(F.col("group").alias("pair"), F.col("q").cast("double").alias("q"))
    # one row per pair of columns from here on
    joined = df.sparkSession.createDataFrame(
        [(k, names[i], names[j]) for k, (i, j) in enumerate(chosen)], "pair int, column1 string, column2 string",
    ).join(sums, "pair", "left").join(crossed, "pair", "left")
    n = F.col("n")
    total = n * (n - 1) / 2
    balance = total - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.coalesce("q", F.lit(0.0))
    size = F.sqrt(total - F.col("tx")) * F.sqrt(total - F.col("ty"))
    return joined.select(
        "column1", "column2", F.coalesce(n, F.lit(0.0)).cast("bigint").alias("n"),
        F.when(size > 0, balance / size).alias("correlation"),
    )


def discordant(points: DataFrame) -> DataFrame:
    """(group, q): per group of (group bigint, x, y, w) the weight of pairs with x smaller and y larger.

    A group of at most POINTS points is counted in one task. A larger one is cut into
    ranges of x and ranges of y at sketched values, a frequent value being a range of its
    own. Two points in different ranges of both sides are counted from the totals of the
    cells (range, range); points that share a range of x, or else one of y, form smaller
    groups of the same kind. So a point is repeated twice a level, and two levels reach
    some 4 billion points a pair. ``points`` must be cheap to read again.
    """
    sizes = points.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"))
    # one side constant: no pair is discordant
    sizes = materialize(sizes.where("lx < hx and ly < hy").select("group", "n"))
    result = _whole(points.join(sizes.where(F.col("n") <= POINTS).select("group"), "group"))
    large = sizes.where(F.col("n") > POINTS).select("group")
    if large.isEmpty():
        return result
    shares = [k / RANGES for k in range(1, RANGES)]
    split = points.join(large, "group")
    borders = split.groupBy("group").agg(*[
        F.array_distinct(F.approx_percentile(c, shares, 4 * RANGES)).alias(f"_{c}") for c in ("x", "y")
    ])

    def place(value: str) -> Column:
        """Even: between two borders; odd: on one."""
        held, mine = F.col(f"_{value}"), F.col(value)
        below = count_where_prefix(held, lambda b: b < mine, RANGES)
        return 2 * below + F.coalesce((F.get(held, below) == mine).cast("int"), F.lit(0))

    placed = materialize(split.join(borders, "group").select("group", "x", "y", "w", place("x").alias("i"), place("y").alias("j")))
    cells = placed.groupBy("group", "i", "j").agg(F.sum("w").alias("w"))
    # numbers of the smaller groups: ranges of x, then ranges of y
    most = 4 * RANGES + 2
    inside = placed.where("i % 2 = 0").select((F.col("group") * most + F.col("i")).alias("group"), "x", "y", "w")
    # points of one range of x are ties here: they are counted above
    beside = placed.where("j % 2 = 0").select((F.col("group") * most + (2 * RANGES + 1) + F.col("j")).alias("group"), F.col("i").cast("double").alias("x"), "y", "w")
    parts = discordant(inside.unionByName(beside)).select(F.floor(F.col("group") / most).alias("group"), "q")
    everywhere = _whole(cells.select("group", F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), "w"))
    found = parts.unionByName(everywhere).groupBy("group").agg(F.sum("q").cast(WIDE).alias("q"))
    return result.unionByName(found)


def _crossings(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """The weight of pairs with x smaller and y larger, in n log n steps and without overflow."""
    order = np.lexsort((y, x))
    held = w[order].astype(object) if float(w.sum()) ** 2 >= 2**62 else w[order].astype(np.int64)
    rank = np.unique(y[order], return_inverse=True)[1]
    total, here = 0, np.arange(len(rank))
    # two points differ first at some bit of their ranks; the one with the 1 must come first
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        prefix = rank >> (bit + 1)
        one = (rank >> bit) & 1
        ones = np.cumsum(held * one)
        start = np.maximum.accumulate(np.where(np.r_[True, prefix[1:] != prefix[:-1]], here, 0))
        base = np.where(start > 0, ones[np.maximum(start - 1, 0)], 0)
        total += int(np.sum((ones - base) * held * (1 - one)))
        # the next bit looks inside groups that agree so far, each still in the order of x
        moved = np.argsort(rank >> bit, kind="stable")
        rank, held = rank[moved], held[moved]
    return total


def _whole(points: DataFrame) -> DataFrame:
    """Groups counted by one task each: their points, or the at most (2 RANGES + 1)^2 cells."""

    def counted(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = _crossings(*[frame[c].to_numpy() for c in ("x", "y", "w")])
        return pd.DataFrame({"group": [key[0]], "q": [Decimal(found)]})

    return points.select("group", "x", "y", "w").groupBy("group").applyInPandas(counted, f"group bigint, q {WIDE}")


METHODS = {"pearson": pearson, "spearman": spearman, "kendall": kendall}


def correlation_pairs(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """Upper triangle of the matrix in the order of ``columns``."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}, use one of {sorted(METHODS)}")
    if len(columns) < 2:
        return df.sparkSession.createDataFrame(
            [], "column1 string, column2 string, n bigint, correlation double"
        )
    return METHODS[method](df, columns)


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """Both triangles and the diagonal."""
    upper = correlation_pairs(df, columns, method)
    mirrored = upper.select(F.inline(F.array(
        F.struct("column1", "column2", "n", "correlation"),
        F.struct(F.col("column2").alias("column1"), F.col("column1").alias("column2"), "n", "correlation"),
    )))
    diagonal = df.agg(F.array(*[
        F.struct(
            F.lit(c).alias("column1"), F.lit(c).alias("column2"),
            F.count(present(df, c)).alias("n"),
            # a constant column has no correlation, not even with itself
            F.when(F.min(present(df, c)) < F.max(present(df, c)), F.lit(1.0)).alias("correlation"),
        ) for c in columns
    ]).alias("cells")).select(F.inline("cells"))
    return mirrored.unionByName(diagonal)


def high_correlations(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    return pairs.where(F.abs("correlation") >= threshold).orderBy(
        F.desc(F.abs("correlation")), "column1", "column2"
    )
