import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.operators import correlate, divergence, ordered
from hushframe.operators.ordered import cumulate, even_quantiles, quantiles, value_counts
from hushframe.operators.pairs import side_counts


def values_frame(spark, seed=1, n=4000):
    rng = random.Random(seed)
    rows = [("a", rng.gauss(5, 2)) for _ in range(n)]
    rows += [("b", float(rng.randint(0, 30))) for _ in range(n)]
    # a third of c is one value
    rows += [("c", 7.0 if rng.random() < 0.34 else rng.expovariate(0.1)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "column string, value double")


@pytest.mark.parametrize("per_range", [10_000, 300])
def test_cumulate_does_not_depend_on_ranges(spark, per_range):
    rows, df = values_frame(spark)
    found = cumulate(value_counts(df, ["column"]), ["column"], "value", ["n"], per_range=per_range).collect()
    for column in "abc":
        data = sorted(v for c, v in rows if c == column)
        mine = sorted((r for r in found if r["column"] == column), key=lambda r: r["value"])
        assert [r["value"] for r in mine] == sorted(set(data))
        before = 0
        for i, row in enumerate(mine):
            assert row["n_before"] == before and row["n_total"] == len(data)
            before += row["n"]
            assert row["next_value"] == (mine[i + 1]["value"] if i + 1 < len(mine) else None)


def test_quantiles_match_numpy(spark):
    rows, df = values_frame(spark)
    shares = {"p5": 0.05, "q1": 0.25, "median": 0.5, "p99": 0.99}
    for row in quantiles(value_counts(df, ["column"]), ["column"], shares).collect():
        data = [v for c, v in rows if c == row["column"]]
        for name, share in shares.items():
            assert row[name] == pytest.approx(np.quantile(data, share), abs=1e-9)


def test_even_quantiles_match_numpy(spark):
    rows, df = values_frame(spark)
    found = even_quantiles(value_counts(df, ["column"]), ["column"], F.lit(101)).collect()
    for column in "abc":
        data = [v for c, v in rows if c == column]
        mine = [r["value"] for r in sorted((r for r in found if r["column"] == column), key=lambda r: r["point"])]
        assert mine == pytest.approx(list(np.quantile(data, np.linspace(0, 1, 101))), abs=1e-9)


def tau_b(pairs):
    agree = ties_x = ties_y = 0
    for (a, b), (c, d) in itertools.combinations(pairs, 2):
        agree += ((a > c) - (a < c)) * ((b > d) - (b < d))
        ties_x += a == c
        ties_y += b == d
    total = len(pairs) * (len(pairs) - 1) / 2
    return agree / math.sqrt((total - ties_x) * (total - ties_y))


def test_kendall_matches_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(float(rng.randint(0, 12)), rng.gauss(0, 1), float(rng.randint(0, 5))) for _ in range(400)]
    rows = [(x, y + 0.2 * x, 2.0 if rng.random() < 0.4 else z) for x, y, z in rows]
    rows += [(None, 1.0, 2.0), (1.0, None, None)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    # few points a task and small ranges, so that sums cross range borders
    monkeypatch.setattr(correlate, "POINTS", 30)
    monkeypatch.setattr(correlate, "RANGES", 6)
    found = {(r["column1"], r["column2"]): r for r in correlate.kendall(df, ["x", "y", "z"]).collect()}
    for i, j in itertools.combinations(range(3), 2):
        known = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        row = found["xyz"[i], "xyz"[j]]
        assert row["n"] == len(known)
        assert row["correlation"] == pytest.approx(tau_b(known), abs=1e-12)


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(10)], "x double, y double")
    for method in ("pearson", "spearman", "kendall"):
        assert correlate.correlation_pairs(df, ["x", "y"], method).first()["correlation"] is None


def test_transport_matches_sorted_samples(spark):
    rng = random.Random(5)
    pairs = [("v", rng.gauss(0, 1), rng.gauss(0.3, 1.2)) for _ in range(1500)]
    cells = spark.createDataFrame(pairs, "column string, o double, p double")
    row = divergence.transport(side_counts(cells)).first()
    o, p = sorted(x for _, x, _ in pairs), sorted(x for _, _, x in pairs)
    assert row["wasserstein"] == pytest.approx(np.mean(np.abs(np.array(o) - np.array(p))), abs=1e-9)
    grid = sorted(o + p)
    gaps = np.searchsorted(o, grid, "right") / len(o) - np.searchsorted(p, grid, "right") / len(p)
    assert row["ks_statistic"] == pytest.approx(np.abs(gaps).max(), abs=1e-12)


def test_histogram_of_counts_is_the_histogram(spark):
    rng = random.Random(6)
    cells = spark.createDataFrame(
        [("v", round(rng.gauss(0, 1), 2), round(rng.gauss(1, 1), 2)) for _ in range(800)] + [("v", None, 1.0)],
        "column string, o double, p double",
    )
    direct = divergence.histogram(cells, 13).orderBy("bin").collect()
    counted = divergence.histogram_of_counts(side_counts(cells), 13).orderBy("bin").collect()
    assert direct == counted
    edges = [direct[0]["bin_low"]] + [r["bin_high"] for r in direct]
    o = [r["o"] for r in cells.collect() if r["o"] is not None]
    assert [r["n_o"] for r in direct] == list(np.histogram(o, bins=13, range=(edges[0], edges[-1]))[0])


def test_divergences_are_metrics(spark):
    rows = [("same", float(i), float(i)) for i in range(1, 5)] + [("apart", 1.0, 0.0), ("apart", 0.0, 1.0)]
    found = {r["column"]: r for r in divergence.divergences(
        spark.createDataFrame(rows, "column string, p double, q double")).collect()}
    assert found["same"]["kl_divergence"] == found["same"]["tvd"] == found["same"]["js_distance"] == 0
    assert found["apart"]["tvd"] == found["apart"]["js_distance"] == found["apart"]["hellinger_distance"] == 1
    assert found["apart"]["kl_divergence"] == pytest.approx(math.log(1e10), abs=1e-6)


@pytest.mark.parametrize("points, per_range", [(2, 3), (7, 3), (40, 5), (1, 3), (300, 50_000)])
def test_even_quantiles_order_only_the_ranges_they_need(spark, points, per_range):
    rng = random.Random(points)
    rows = [("a", round(rng.gauss(0, 9), 1)) for _ in range(900)] + [("b", float(i % 4)) for i in range(50)] + [("c", 1.5)]
    counts = ordered.value_counts(spark.createDataFrame(rows, "column string, value double"), ["column"])
    got = {}
    for r in ordered.even_quantiles(counts, ["column"], F.lit(points), per_range=per_range).collect():
        got.setdefault(r["column"], {})[r["point"]] = r["value"]
    for column in "abc":
        known = [v for c, v in rows if c == column]
        want = np.quantile(known, np.arange(points) / max(points - 1, 1)) if points > 1 else [min(known)]
        if len(known) > 1 or points == 1:
            assert [got[column][k] for k in range(points)] == pytest.approx(list(want), abs=1e-9)

def test_unwanted_ranges_are_not_ordered(spark):
    counts = spark.range(1000).select(F.lit("c").alias("column"), F.col("id").cast("double").alias("value"), F.lit(1).alias("n"))
    some = ordered.ranked_where(counts, ["column"], "value", lambda before, rows, total: (before <= 500) & (500 < before + rows), per_range=50).collect()
    assert 0 < len(some) < 400 and {r.n_before: r.value for r in some}[500] == 500.0
    assert all(r.n_before == r.value for r in some)
