"""Noise mechanisms over columns, aggregates and candidate sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.functions import keyed, noise
from hushframe.operators import sampling
from hushframe.plans.common import (
    RELEASE, SECRET, r, rounded, sql_gaussian, sql_laplace, sql_uniform, table,
)

QUERIES, SQL = {}, {}


def _digest(df, column, key):
    return keyed.cell_digest(keyed.secret_column(SECRET), RELEASE, column, keyed.key_columns(df, key))


def laplace_column(spark, sf):
    """Every order total with its own draw, as given and clamped first."""
    orders = table(spark, sf, "orders")
    scale = noise.laplace_scale(noise.bounded_sensitivity(0.0, 300000.0), 0.5)
    draw = noise.laplace(scale, keyed.uniform(_digest(orders, "o_totalprice", ["o_orderkey"])))
    price = F.col("o_totalprice")
    return rounded(orders.select(
        "o_orderkey", (price + draw).alias("noisy"),
        (noise.clamp(price, 0.0, 300000.0) + draw).alias("noisy_clamped"),
    ), 3)


QUERIES["laplace_column"] = laplace_column
_L = sql_laplace("300000.0 / 0.5", sql_uniform("o_totalprice", "o_orderkey"))
SQL["laplace_column"] = f"""SELECT o_orderkey, {r(f'o_totalprice + {_L}', 3)} AS noisy,
 {r(f'least(greatest(o_totalprice, 0), 300000) + {_L}', 3)} AS noisy_clamped FROM orders"""


def laplace_aggregate(spark, sf):
    """A noisy count and a noisy mean per priority: one draw per result."""
    groups = table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(noise.clamp(F.col("o_totalprice"), 0.0, 500000.0)).alias("mean"),
    )
    count_draw = keyed.uniform(_digest(groups, "n", ["o_orderpriority"]))
    mean_draw = keyed.uniform(_digest(groups, "mean", ["o_orderpriority"]))
    return rounded(groups.select(
        "o_orderpriority",
        (F.col("n") + noise.laplace(noise.laplace_scale(1.0, 0.5), count_draw)).alias("noisy_count"),
        (F.col("mean") + noise.laplace(500000.0 / F.col("n") / 0.5, mean_draw)).alias("noisy_mean"),
    ), 4)


QUERIES["laplace_aggregate"] = laplace_aggregate
_K = "concat(length(o_orderpriority), ':', o_orderpriority)"
SQL["laplace_aggregate"] = f"""SELECT o_orderpriority,
 {r(f"n + {sql_laplace('2.0', sql_uniform('n', _K))}", 4)} AS noisy_count,
 {r(f"m + {sql_laplace('500000.0 / n / 0.5', sql_uniform('mean', _K))}", 4)} AS noisy_mean
 FROM (SELECT o_orderpriority, count(*) AS n, avg(least(greatest(o_totalprice, 0), 500000)) AS m FROM orders GROUP BY 1)"""

_SIGMA = "1000.0 / sqrt(2 * pow(sqrt(-ln(1e-5) + 1.0) - sqrt(-ln(1e-5)), 2))"


def gaussian_column(spark, sf):
    customer = table(spark, sf, "customer")
    digest = _digest(customer, "c_acctbal", ["c_custkey"])
    sigma = noise.gaussian_scale(1000.0, 1.0, 1e-5)
    draw = noise.gaussian(sigma, keyed.uniform(digest, 0), keyed.uniform(digest, 1))
    return rounded(customer.select("c_custkey", (F.col("c_acctbal") + draw).alias("noisy")), 4)


QUERIES["gaussian_column"] = gaussian_column
SQL["gaussian_column"] = f"""SELECT c_custkey, {r('c_acctbal + ' + sql_gaussian(
    _SIGMA, sql_uniform('c_acctbal', 'c_custkey', 0), sql_uniform('c_acctbal', 'c_custkey', 1)), 4)} AS noisy FROM customer"""


def gaussian_aggregate(spark, sf):
    groups = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("total"))
    digest = _digest(groups, "total", ["c_nationkey"])
    sigma = noise.gaussian_scale(1000.0, 1.0, 1e-5)
    draw = noise.gaussian(sigma, keyed.uniform(digest, 2), keyed.uniform(digest, 3))
    return rounded(groups.select("c_nationkey", (F.col("total") + draw).alias("noisy_total")), 3)


QUERIES["gaussian_aggregate"] = gaussian_aggregate
SQL["gaussian_aggregate"] = f"""SELECT c_nationkey, {r('t + ' + sql_gaussian(
    _SIGMA, sql_uniform('total', 'c_nationkey', 2), sql_uniform('total', 'c_nationkey', 3)), 3)} AS noisy_total
 FROM (SELECT c_nationkey, sum(c_acctbal) AS t FROM customer GROUP BY 1)"""


def mechanism_parameters(spark, sf):
    """Scales, concentrated budget and the epsilon it gives at other deltas,
    for a table of requested parameters (one per part)."""
    asked = table(spark, sf, "part").select(
        "p_partkey",
        (F.lit(0.02) * (F.col("p_partkey") % 600)).alias("epsilon"),
        F.pow(F.lit(10.0), -(F.col("p_partkey") % 9 + 2)).alias("delta"),
        (F.col("p_retailprice") / 100).alias("sensitivity"),
    )
    eps, delta, sens = F.col("epsilon"), F.col("delta"), F.col("sensitivity")
    ok = asked.withColumn("problem", noise.parameter_problem(eps, delta, sens))
    fine = F.col("problem").isNull()
    budget = noise.rho(eps, delta)
    return rounded(ok.select(
        "p_partkey", "problem",
        F.when(fine, noise.laplace_scale(sens, eps)).alias("laplace_scale"),
        F.when(fine, noise.exponential_scale(sens, eps)).alias("exponential_scale"),
        F.when(fine, budget).alias("rho"),
        F.when(fine, noise.gaussian_scale(sens, eps, delta)).alias("gaussian_scale"),
        F.when(fine, noise.achieved_epsilon(budget, delta)).alias("epsilon_same_delta"),
        F.when(fine, noise.achieved_epsilon(budget, 1e-7)).alias("epsilon_at_1e7"),
        F.when(fine, F.coalesce(delta, F.lit(0.0)) == 0).alias("is_pure"),
    ))


QUERIES["mechanism_parameters"] = mechanism_parameters
SQL["mechanism_parameters"] = f"""WITH asked AS (SELECT p_partkey, 0.02::DOUBLE * (p_partkey % 600) AS e,
  pow(10.0, -(p_partkey % 9 + 2)) AS d, p_retailprice / 100 AS s FROM part),
judged AS (SELECT *, CASE WHEN e < 0.01 OR e > 10 THEN 'epsilon' WHEN d < 1e-10 OR d > 1e-3 THEN 'delta'
  WHEN s <= 0 THEN 'sensitivity' END AS problem, pow(sqrt(-ln(d) + e) - sqrt(-ln(d)), 2) AS rho FROM asked)
SELECT p_partkey, problem, CASE WHEN problem IS NULL THEN {r('s / e')} END AS laplace_scale,
 CASE WHEN problem IS NULL THEN {r('2 * s / e')} END AS exponential_scale,
 CASE WHEN problem IS NULL THEN {r('rho')} END AS rho,
 CASE WHEN problem IS NULL THEN {r('s / sqrt(2 * rho)')} END AS gaussian_scale,
 CASE WHEN problem IS NULL THEN {r('rho + 2 * sqrt(rho * -ln(d))')} END AS epsilon_same_delta,
 CASE WHEN problem IS NULL THEN {r('rho + 2 * sqrt(rho * -ln(1e-7))')} END AS epsilon_at_1e7,
 CASE WHEN problem IS NULL THEN coalesce(d, 0) = 0 END AS is_pure FROM judged"""


def mechanism_cost(spark, sf):
    """One use of a mechanism per part; some state a delta of zero, most mechanisms none."""
    part = table(spark, sf, "part")
    k = F.col("p_partkey")
    mechanism = F.when(k % 3 == 0, "laplace").when(k % 3 == 1, "gaussian").otherwise("exponential")
    delta = F.when(k % 4 == 0, F.lit(0.0)).otherwise(F.pow(F.lit(10.0), -(k % 7 + 3)))
    return part.select("p_partkey", mechanism.alias("mechanism"), noise.mechanism_cost(mechanism, k % 100 / 10 + 0.01, delta).alias("cost")).select(
        "p_partkey", "mechanism", F.round("cost.epsilon", 6).alias("epsilon"), F.round(F.col("cost.delta") * 1e9, 3).alias("delta_e9"), "cost.is_pure",
    )


QUERIES["mechanism_cost"] = mechanism_cost
SQL["mechanism_cost"] = """WITH t AS (SELECT p_partkey, ['laplace', 'gaussian', 'exponential'][1 + p_partkey % 3] AS mechanism,
  p_partkey % 100 / 10 + 0.01 AS epsilon, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE pow(10.0, -(p_partkey % 7 + 3)) END AS d FROM part),
c AS (SELECT *, CASE WHEN mechanism = 'gaussian' THEN d END AS delta FROM t)
SELECT p_partkey, mechanism, round(epsilon::DOUBLE, 6) AS epsilon, round(delta::DOUBLE * 1e9, 3) AS delta_e9, delta IS NULL OR delta = 0 AS is_pure FROM c"""


def _event_scores(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES["private_top1"] = lambda spark, sf: sampling.select_per_group(
    _event_scores(spark, sf), ["user_id"], "event_type", "n", 0.3, 1.0, SECRET, RELEASE
).select("user_id", "selected", "candidates")
_CANDIDATE = "user_id, concat(length(event_type), ':', event_type), draw"


def _top1(draws: int) -> str:
    return f"""noisy AS (SELECT user_id, draw, event_type,
  n * 0.3 / 2 - ln(-ln({sql_uniform('event_type', _CANDIDATE)})) AS score
  FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), range(1, {draws + 1}) t(draw)),
picked AS (SELECT user_id, draw, max_by(event_type, score) AS selected, count(*) AS candidates FROM noisy GROUP BY 1, 2)"""


SQL["private_top1"] = f"WITH {_top1(1)} SELECT user_id, selected, candidates FROM picked"

QUERIES["private_top1_draws"] = lambda spark, sf: sampling.select_per_group(
    _event_scores(spark, sf), ["user_id"], "event_type", "n", 0.3, 1.0, SECRET, RELEASE, draws=5
).withColumn("total_epsilon", F.lit(1.5))
SQL["private_top1_draws"] = f"WITH {_top1(5)} SELECT user_id, draw, selected, candidates, 1.5::DOUBLE AS total_epsilon FROM picked"


QUERIES["private_draws"] = lambda spark, sf: sampling.draw_per_group(
    _event_scores(spark, sf), ["user_id"], "event_type", "n", 0.3, 1.0, SECRET, 20, RELEASE)
SQL["private_draws"] = f"""WITH w AS (SELECT user_id, event_type, exp(n * 0.15 - max(n * 0.15) OVER (PARTITION BY user_id)) AS w,
  count(*) OVER (PARTITION BY user_id) AS candidates
  FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)),
c AS (SELECT *, sum(w) OVER (PARTITION BY user_id ORDER BY event_type) AS high, sum(w) OVER (PARTITION BY user_id) AS total FROM w),
d AS (SELECT user_id, draw::INTEGER AS draw, {sql_uniform('event_type', 'user_id, draw')} AS u FROM (SELECT DISTINCT user_id FROM events), range(1, 21) t(draw))
SELECT user_id, draw, min(event_type) AS selected, any_value(candidates) AS candidates
FROM d JOIN c USING (user_id) WHERE u * total < high GROUP BY 1, 2"""


def exponential_weights(spark, sf):
    """The selection law itself, per user."""
    scores = _event_scores(spark, sf)
    top = scores.groupBy("user_id").agg(F.max("n").alias("top"))
    weighted = scores.join(top, "user_id").withColumn(
        "w", F.exp((F.col("n") - F.col("top")) * (0.3 / 2)))
    total = weighted.groupBy("user_id").agg(F.sum("w").alias("total"))
    return rounded(weighted.join(total, "user_id").select(
        "user_id", "event_type", (F.col("w") / F.col("total")).alias("probability")))


QUERIES["exponential_weights"] = exponential_weights
SQL["exponential_weights"] = f"""WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
w AS (SELECT user_id, event_type, exp((n - max(n) OVER (PARTITION BY user_id)) * 0.15) AS w FROM s)
SELECT user_id, event_type, {r('w / sum(w) OVER (PARTITION BY user_id)')} AS probability FROM w"""
