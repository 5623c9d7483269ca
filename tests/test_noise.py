import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushframe.functions import keyed, noise
from hushframe.operators import sampling
from hushframe.plans.common import orders_release


def draws(spark, expression, n=10_000, secret="s"):
    df = spark.range(n)
    digest = keyed.cell_digest(F.lit(secret), "r", "c", keyed.key_columns(df, ["id"]))
    return np.array([r[0] for r in df.select(expression(digest)).collect()])


def ks_p(sample, cdf):
    x = np.sort(sample)
    f, n = cdf(x), len(x)
    d = max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max()) * math.sqrt(n)
    return 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * d * d) for j in range(1, 101))


def test_laplace_law(spark):
    x = draws(spark, lambda d: noise.laplace(2.0, keyed.uniform(d)))
    assert ks_p(x, lambda v: np.where(v < 0, np.exp(v / 2) / 2, 1 - np.exp(-v / 2) / 2)) > 0.01
    assert np.abs(x).mean() == pytest.approx(2.0, rel=0.1)


def test_gaussian_law(spark):
    x = draws(spark, lambda d: noise.gaussian(3.0, keyed.uniform(d, 0), keyed.uniform(d, 1)))
    assert ks_p(x, np.vectorize(lambda v: 0.5 * (1 + math.erf(v / 3 / math.sqrt(2))))) > 0.01


def test_uniforms_of_a_digest_are_independent(spark):
    u = np.stack([draws(spark, lambda d, i=i: keyed.uniform(d, i)) for i in range(4)])
    assert u.min() > 0 and u.max() < 1
    assert np.abs(np.corrcoef(u) - np.eye(4)).max() < 0.05


def test_noise_survives_repartitioning(spark, sf_dir):
    data = orders_release(spark, sf_dir, unique_key=True).data
    first = {r["o_orderkey"]: r for r in data.collect()}
    again = {r["o_orderkey"]: r for r in data.repartition(11, "o_orderstatus").collect()}
    assert first == again


def test_other_secret_other_noise(spark):
    a = draws(spark, lambda d: keyed.uniform(d), 100, "one")
    b = draws(spark, lambda d: keyed.uniform(d), 100, "two")
    assert not np.any(a == b)


def test_secret_table_stays_out_of_the_plan(spark):
    secret = spark.createDataFrame([("do-not-print",)], "secret string")
    df = spark.range(5)
    digest = keyed.cell_digest(keyed.secret_column(secret), "r", "c", keyed.key_columns(df, ["id"]))
    out = df.select(keyed.uniform(digest).alias("u"))
    assert [r.u for r in out.collect()] == list(draws(spark, keyed.uniform, 5, "do-not-print"))


def test_keys_cannot_collide(spark):
    df = spark.createDataFrame([("a|", "b"), ("a", "|b")], "x string, y string")
    digests = df.select(keyed.cell_digest(F.lit("s"), "r", "c", keyed.key_columns(df, ["x", "y"]))).collect()
    assert digests[0] != digests[1]


def test_float_keys_are_refused(spark):
    with pytest.raises(ValueError):
        keyed.key_columns(spark.createDataFrame([(1.0,)], "x double"), ["x"])


@pytest.mark.parametrize("epsilon,delta", [(0.1, 1e-5), (1.0, 1e-6), (5.0, 1e-9)])
def test_concentrated_budget_round_trip(epsilon, delta):
    assert noise.achieved_epsilon(noise.rho(epsilon, delta), delta) == pytest.approx(epsilon)


@pytest.mark.parametrize("check,bad", [
    (noise.check_epsilon, [0.0, -1, 0.001, 11, math.nan, math.inf]),
    (noise.check_delta, [0.0, 0.1, 1e-11, math.nan]),
    (noise.check_sensitivity, [0.0, -1, math.inf, math.nan]),
])
def test_bad_parameters_are_refused(check, bad):
    for value in bad:
        with pytest.raises(ValueError):
            check(value)
    with pytest.raises(ValueError):
        noise.check_bounds(1, 1)


@pytest.mark.parametrize("head", [2000, 3, 0])
def test_category_law_is_the_same_for_any_head(spark, head):
    """Probabilities by head and by levels agree with the closed form."""
    counts = {"a": 40, "b": 38, "c": 38, "d": 35, "e": 35, "f": 35, "g": 1}
    rows = [(i, c) for i, c in enumerate(c for c, n in counts.items() for _ in range(n))]
    seed = spark.createDataFrame(rows, "id bigint, cat string")
    law = sampling.category_laws(seed, {"cat": (0.4, 1.0)}, head=head)["cat"]
    cells = spark.range(20_000).withColumn("cat", F.lit("a"))
    digest = keyed.cell_digest(F.lit("s"), "r", "cat", keyed.key_columns(cells, ["id"]))
    frame, cell = law.draw(cells, "cat", digest)
    found = {r["v"]: r["count"] for r in frame.select(cell.alias("v")).groupBy("v").count().collect()}
    weights = {c: math.exp((n - 40) * 0.2) for c, n in counts.items()}
    total = sum(weights.values())
    chi = sum((found.get(c, 0) - 20_000 * w / total) ** 2 / (20_000 * w / total)
              for c, w in weights.items() if w / total > 1e-3)
    assert sum(found.values()) == 20_000 and chi < 20  # 5 degrees of freedom


def test_private_top1_prefers_high_scores(spark):
    scores = spark.range(500).crossJoin(spark.createDataFrame([("x", 30), ("y", 1)], "cand string, score int"))
    picked = sampling.select_per_group(scores, ["id"], "cand", "score", 1.0, 1.0, "s")
    assert {r["selected"] for r in picked.collect()} == {"x"}
