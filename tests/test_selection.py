"""Quantiles by narrowing brackets, numbering and category places, against plain code."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.operators import divergence, ordered, profile, selection

SHARES = {"low": 0.0, "p1": 0.01, "q1": 0.25, "median": 0.5, "p777": 0.777, "p99": 0.99, "high": 1.0}


def columns(seed):
    rng = random.Random(seed)
    n = 3000
    return {
        "spread": [rng.gauss(0, 100) for _ in range(n)],
        "few": [rng.choice([1.0, 2.0, 2.0, 7.5]) for _ in range(n)],
        "hot": [0.0 if rng.random() < 0.6 else rng.random() for _ in range(n)],
        "flat": [4.25] * n,
        "gaps": [None if i % 3 else (float("nan") if i % 5 == 0 else float(i % 701)) for i in range(n)],
        "ends": [float("inf") if i % 50 == 0 else float("-inf") if i % 49 == 0 else float(i) for i in range(n)],
        "one": [5.5 if i == 17 else None for i in range(n)],
        "none": [None] * n,
    }


def plain_quantile(values, share):
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    position = share * (len(known) - 1)
    low, high = known[math.floor(position)], known[math.ceil(position)]
    return low + (high - low) * (position - math.floor(position))


@pytest.mark.parametrize("few, slack", [(100_000, 1 / 512), (40, 1 / 512), (1, 1 / 4096)])
def test_quantiles_are_exact_whatever_the_brackets(spark, monkeypatch, few, slack):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "SLACK", slack)
    data = columns(few)
    names = list(data)
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"`{n}` double" for n in names)).repartition(3)
    found = {r["column"]: r for r in selection.exact_quantiles(df, {n: F.col(n) for n in names}, SHARES)}
    for name, values in data.items():
        known = [v for v in values if v is not None and not math.isnan(v)]
        assert found[name]["count"] == len(known)
        for share, p in SHARES.items():
            want = plain_quantile(values, p) if known else None
            got = found[name][share]
            assert got == want or (math.isnan(got) and math.isnan(want)), (name, share)


def test_brackets_end_where_a_sketch_is_wrong(spark, monkeypatch):
    """Proposals that miss their rank are thrown away, and the bracket as it is gets ordered."""
    monkeypatch.setattr(selection, "FEW", 10)
    monkeypatch.setattr(selection.F, "approx_percentile", lambda value, shares, accuracy: F.array(*[F.max(value)] * len(shares)))
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    found = selection.exact_quantiles(df, {"v": F.col("v")}, {"q": 0.3, "m": 0.5})[0]
    assert math.isclose(found["q"], 299.7) and found["m"] == 499.5


def test_no_rows_and_no_columns(spark):
    empty = spark.createDataFrame([], "v double")
    assert selection.exact_quantiles(empty, {"v": F.col("v")}, {"m": 0.5}) == [{"column": "v", "count": 0, "m": None}]
    assert selection.quantile_table(empty, {"v": F.col("v")}, {"m": 0.5}).count() == 0


def test_outliers_and_profile_agree_with_numpy(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=500), [50.0, -70.0]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    row = profile.profile_numeric(df).first()
    low, high = np.quantile(values, 0.25), np.quantile(values, 0.75)
    outside = ((values < low - 1.5 * (high - low)) | (values > high + 1.5 * (high - low))).sum()
    assert row["outlier_count"] == outside and math.isclose(row["median"], np.median(values))
    assert profile.outlier_rows(df.withColumn("k", F.monotonically_increasing_id()), "v", ["k"]).count() == outside


def test_rows_are_numbered_in_order(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.random()]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, i long").repartition(5)
    got = {r.i: r.place for r in ordered.number_rows(df, ["g"], ["v", "i"], "place").collect()}
    for group in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in mine] == list(range(len(mine)))


def test_places_of_long_categories(spark):
    """16384 categories that agree in far more code points than the first ones."""
    rows = [("c", "x" * 200 + f"{i * 7919 % 16384:05d}" + "y" * (i % 5)) for i in range(16384)]
    rows += [("c", "x" * k) for k in range(0, 70, 5)] + [("d", "x" * 64), ("d", "x" * 65), ("d", "")]
    df = spark.createDataFrame(rows, "column string, value string")
    got = {(r["column"], r.value): r["index"] for r in divergence.category_index(df, shared=1000).collect()}
    for column in "cd":
        values = sorted(v for c, v in rows if c == column)
        assert [got[column, v] for v in values] == list(range(len(values)))


def test_weighted_distance(spark):
    rng = random.Random(6)
    sample = lambda n: [("g", rng.choice([None, rng.gauss(0, 3), 1.0]), rng.choice([0.0, rng.random() / 9])) for _ in range(n)]
    left, right = sample(200) + [("alone", 1.0, 2.0)], sample(150) + [("g", 2.0, None), ("g", float("nan"), 1.0)]
    schema = "column string, value double, weight double"
    got = {r["column"]: r for r in divergence.weighted_transport(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}
    plain = [[(v, w) for g, v, w in side if g == "g" and v is not None and w is not None and v == v] for side in (left, right)]
    points = sorted({v for side in plain for v, _ in side})
    share = lambda side, x: sum(w for v, w in side if v <= x) / sum(w for _, w in side)
    gaps = [abs(share(plain[0], x) - share(plain[1], x)) for x in points]
    want = sum(g * (b - a) for g, a, b in zip(gaps, points, points[1:]))
    assert math.isclose(got["g"].wasserstein, want, rel_tol=1e-9) and math.isclose(got["g"].ks_statistic, max(gaps), rel_tol=1e-9)
    assert got["alone"].wasserstein == 0.0
    bad = spark.createDataFrame([("g", 1.0, -0.5)], schema)
    with pytest.raises(Exception, match="negative"):
        divergence.weighted_transport(bad, bad).collect()


def test_distribution_over_a_fixed_set(spark):
    cells = spark.createDataFrame([("c", "a", "b"), ("c", "a", "a"), ("c", None, "b")], "column string, o string, p string")
    listed = spark.createDataFrame([("c", "a"), ("c", "z"), ("c", None)], "column string, value string")
    got = {r.value: (r.n_o, r.n_p) for r in divergence.distribution(cells, categories=listed).collect()}
    assert got == {"a": (2, 1), "b": (0, 1), "z": (0, 0)}
