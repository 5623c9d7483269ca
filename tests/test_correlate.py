"""Rank correlations and discordant pairs against pair-by-pair code."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hushframe.operators import correlate


def table_of(spark, seed, n=400, gaps=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.gauss(0, 1)
        rows.append((a, rng.choice([1.0, 2.0, 3.0]), None if gaps and i % 7 == 0 else a + rng.gauss(0, 1), float(rng.randrange(40)), 3.0))
    rows += rows[:30]
    return spark.createDataFrame(rows, "a double, few double, gap double, mid double, flat double"), rows


NAMES = ["a", "few", "gap", "mid", "flat"]


def complete(rows, i, j):
    return [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]


def ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def pearson(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    sx, sy = sum((v - mx) ** 2 for v in x), sum((v - my) ** 2 for v in y)
    return sum((u - mx) * (v - my) for u, v in zip(x, y)) / math.sqrt(sx * sy) if sx * sy else None


def tau(pairs):
    s = tx = ty = 0
    for k, (x1, y1) in enumerate(pairs):
        for x2, y2 in pairs[:k]:
            s += ((x1 > x2) - (x1 < x2)) * ((y1 > y2) - (y1 < y2))
            tx, ty = tx + (x1 == x2), ty + (y1 == y2)
    total = len(pairs) * (len(pairs) - 1) / 2
    return s / math.sqrt((total - tx) * (total - ty)) if (total - tx) * (total - ty) else None


def same(got, want):
    return got is None and want is None or math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("gaps", [True, False])
def test_spearman(spark, gaps):
    df, rows = table_of(spark, 3, gaps=gaps)
    found = {(r.column1, r.column2): r for r in correlate.spearman(df, NAMES).collect()}
    assert len(found) == 10
    for i, a in enumerate(NAMES):
        for j in range(i + 1, 5):
            pairs = complete(rows, i, j)
            r = found[a, NAMES[j]]
            assert r.n == len(pairs)
            assert same(r.correlation, pearson(ranks([x for x, _ in pairs]), ranks([y for _, y in pairs])))


@pytest.mark.parametrize("few", [0, 50_000])
def test_ranks_of_columns_with_few_and_many_values(spark, monkeypatch, few):
    monkeypatch.setattr(correlate, "FEW_VALUES", few)
    monkeypatch.setattr(correlate, "HOT_SHARE", 5)  # hot and other values in one column
    monkeypatch.setattr(correlate, "_pearson_by_pair", None)  # rows of ranks emit no pairs
    df, rows = table_of(spark, 4, gaps=False)
    held = sorted(tuple(r) for r in correlate.column_ranks(df.repartition(3), NAMES).collect())
    assert held == sorted(zip(*[ranks([r[i] for r in rows]) for i in range(len(NAMES))]))
    for r in correlate.spearman(df, NAMES).collect():
        pairs = complete(rows, NAMES.index(r.column1), NAMES.index(r.column2))
        assert r.n == len(pairs) and same(r.correlation, pearson(*map(ranks, zip(*pairs))))
    gapped, rows = table_of(spark, 4)
    assert correlate.column_ranks(gapped, NAMES).where("gap is null").count() == sum(r[2] is None for r in rows)


@pytest.mark.parametrize("points, ranges", [(250_000, 128), (60, 5), (20, 3)])
def test_kendall(spark, monkeypatch, points, ranges):
    monkeypatch.setattr(correlate, "POINTS", points)
    monkeypatch.setattr(correlate, "RANGES", ranges)
    df, rows = table_of(spark, 5, n=200)
    found = {(r.column1, r.column2): r for r in correlate.kendall(df, NAMES).collect()}
    for i, a in enumerate(NAMES):
        for j in range(i + 1, 5):
            pairs = complete(rows, i, j)
            r = found[a, NAMES[j]]
            assert r.n == len(pairs) and same(r.correlation, tau(pairs)), (a, NAMES[j])


def test_discordant_weights(spark):
    rng = random.Random(1)
    rows = sorted({(float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(60)})
    weighted = [(x, y, 10**12 + k) for k, (x, y) in enumerate(rows)]  # products beyond 64 bits
    df = spark.createDataFrame(weighted, "x double, y double, w long").withColumn("group", F.lit(3).cast("bigint"))
    want = sum(w1 * w2 for x1, y1, w1 in weighted for x2, y2, w2 in weighted if x1 < x2 and y1 > y2)
    assert int(correlate.discordant(df).first().q) == want


@pytest.mark.parametrize("narrow", [24, 0])
def test_pearson_by_pair_and_by_matrix(spark, monkeypatch, narrow):
    monkeypatch.setattr(correlate, "NARROW", narrow)
    df, rows = table_of(spark, 9)
    for r in correlate.pearson(df.repartition(3), NAMES).collect():
        pairs = complete(rows, NAMES.index(r.column1), NAMES.index(r.column2))
        assert r.n == len(pairs) and same(r.correlation, pearson(*zip(*pairs)))


def test_two_columns_without_common_rows(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, 3.0)], "a double, b double")
    for method in ("pearson", "spearman", "kendall"):
        rows = correlate.correlation_pairs(df, ["a", "b"], method).collect()
        assert all((r.n, r.correlation) == (0, None) for r in rows)
