"""Distances between the distributions of both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.operators import divergence
from hushframe.operators.pairs import number, pair_cells, side_counts, text
from hushframe.plans.common import r, rounded, table
from hushframe.plans.comparing import CF, FREQ, GAPPY, _gappy, _returned

QUERIES, SQL = {}, {}
_round = r


def _brands(spark, sf):
    return divergence.distribution(pair_cells(_returned(spark, sf), ["p_brand", "p_name"], text))


_TOTALS = """t AS (SELECT *, min(p_p) OVER (PARTITION BY "column") < 1e-15 AS zero, count(*) OVER (PARTITION BY "column") AS k FROM cf),
s AS (SELECT *, CASE WHEN zero THEN (p_p + 1e-10) / (1 + k * 1e-10) ELSE p_p END AS q FROM t)"""


def _metric(name: str, expression: str, column: str, **options):
    QUERIES[name] = lambda spark, sf: rounded(
        divergence.divergences(_brands(spark, sf), **options).select("column", F.col(column).alias(name)))
    SQL[name] = f"""WITH {CF}, {_TOTALS} SELECT "column", {r(expression)} AS {name} FROM s GROUP BY 1"""


_KL = "sum(CASE WHEN p_o > 1e-15 THEN p_o * ln(p_o / q) ELSE 0 END)"
_JS = """sum(CASE WHEN p_o > 0 THEN 0.5 * p_o * log2(p_o / ((p_o + p_p) / 2)) ELSE 0 END
 + CASE WHEN p_p > 0 THEN 0.5 * p_p * log2(p_p / ((p_o + p_p) / 2)) ELSE 0 END)"""
_H = "-sum(CASE WHEN p_o > 1e-15 THEN p_o * log2(p_o) ELSE 0 END)"
_metric("kl", _KL, "kl_divergence")
_metric("kl_bits", f"{_KL} / ln(2)", "kl_divergence", kl_base="2")
_metric("js", f"sqrt(greatest({_JS}, 0))", "js_distance")
_metric("js_divergence", _JS, "js_divergence")
_metric("tvd", "0.5 * sum(abs(p_o - p_p))", "tvd")
_metric("hellinger", "sqrt(0.5 * sum(pow(sqrt(p_o) - sqrt(p_p), 2)))", "hellinger_distance")
_metric("entropy", _H, "entropy_original")
_metric("cross_entropy", f"{_H} + {_KL} / ln(2)", "cross_entropy")

QUERIES["category_distribution"] = lambda spark, sf: _brands(spark, sf).select("column", "value", "n_o", "n_p")
SQL["category_distribution"] = f"""WITH {CF} SELECT "column", value, n_o, n_p FROM cf"""


def _quantities(spark, sf):
    """Numbers on both sides of a line: quantity of returned lines moved up."""
    lines = table(spark, sf, "lineitem")
    moved = F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * 1.25 + 0.5).otherwise(F.col("l_quantity"))
    return lines.select(
        F.struct("l_quantity", "l_extendedprice", F.lit(3.0).alias("flat")).alias("orig"),
        F.struct(
            moved.alias("l_quantity"), (F.col("l_extendedprice") * 0.9).alias("l_extendedprice"),
            F.lit(3.0).alias("flat"),
        ).alias("prot"),
    )


MOVED = """moved AS (SELECT l_quantity AS quantity_o, CASE WHEN l_returnflag = 'R' THEN l_quantity * 1.25 + 0.5 ELSE l_quantity END AS quantity_p,
 l_extendedprice AS extendedprice_o, l_extendedprice * 0.9 AS extendedprice_p, 3.0::DOUBLE AS flat_o, 3.0::DOUBLE AS flat_p FROM lineitem)"""


def hist_sql(c: str, bins: int = 50, source: str = "moved") -> str:
    """(bin, n_o, n_p) with empty bins; a single value gets half a unit each way."""
    return f"""(WITH b AS (SELECT lo - CASE WHEN lo = hi THEN 0.5 ELSE 0 END AS lo, hi + CASE WHEN lo = hi THEN 0.5 ELSE 0 END AS hi
  FROM (SELECT least(min({c}_o), min({c}_p)) AS lo, greatest(max({c}_o), max({c}_p)) AS hi FROM {source})),
 v AS (SELECT least(floor(({c}_o - lo) / ((hi - lo) / {bins}))::BIGINT + 1, {bins}) AS bin, 1 AS a, 0 AS z FROM {source}, b
  UNION ALL SELECT least(floor(({c}_p - lo) / ((hi - lo) / {bins}))::BIGINT + 1, {bins}), 0, 1 FROM {source}, b)
 SELECT i AS bin, lo + (i - 1) * (hi - lo) / {bins} AS bin_low, lo + i * (hi - lo) / {bins} AS bin_high,
  coalesce(sum(a), 0)::BIGINT AS n_o, coalesce(sum(z), 0)::BIGINT AS n_p
 FROM range(1, {bins + 1}) t(i) CROSS JOIN b LEFT JOIN v ON v.bin = i GROUP BY i, lo, hi)"""


QUERIES["histogram"] = lambda spark, sf: rounded(divergence.histogram(
    pair_cells(_quantities(spark, sf), ["l_extendedprice", "flat"], number), 37))
SQL["histogram"] = f"WITH {MOVED} " + "\nUNION ALL\n".join(
    f"""SELECT '{n}' AS "column", bin, {r('bin_low')} AS bin_low, {r('bin_high')} AS bin_high, n_o, n_p FROM {hist_sql(c, 37)}"""
    for n, c in (("l_extendedprice", "extendedprice"), ("flat", "flat")))


def cdf_sql(c: str, source: str = "moved") -> str:
    return f"""(SELECT v, sum(a) OVER w / sum(a) OVER () AS f, sum(z) OVER w / sum(z) OVER () AS g, lead(v) OVER (ORDER BY v) - v AS gap,
  sum(a) OVER ()::DOUBLE AS n, sum(z) OVER ()::DOUBLE AS m
 FROM (SELECT v, sum(a)::DOUBLE AS a, sum(z)::DOUBLE AS z FROM (SELECT {c}_o AS v, 1 AS a, 0 AS z FROM {source} UNION ALL SELECT {c}_p, 0, 1 FROM {source}) GROUP BY v)
 WINDOW w AS (ORDER BY v))"""


def ks_p(d: str) -> str:
    """Kolmogorov tail of d * sqrt(nm / (n + m)) in SQL."""
    x = f"({d} * sqrt(max(n) * max(m) / (max(n) + max(m))))"
    upper = "2 * (" + " ".join(f"{'+' if j % 2 else '-'} exp(-2 * {j * j} * {x} * {x})" for j in range(1, 6)) + ")"
    lower = f"1 - sqrt(2 * pi()) / {x} * (" + " + ".join(
        f"exp(-{(2 * j - 1) ** 2} * pi() * pi() / (8 * {x} * {x}))" for j in range(1, 6)) + ")"
    return f"CASE WHEN {x} < 0.04 THEN 1 WHEN {x} < 1 THEN greatest(least({lower}, 1), 0) ELSE greatest(least({upper}, 1), 0) END"


NAMES = (("l_quantity", "quantity"), ("l_extendedprice", "extendedprice"), ("flat", "flat"))

QUERIES["wasserstein"] = lambda spark, sf: rounded(divergence.transport(side_counts(pair_cells(
    _quantities(spark, sf), [n for n, _ in NAMES], number))).select("column", "wasserstein"))
SQL["wasserstein"] = f"WITH {MOVED} " + "\nUNION ALL\n".join(
    f"""SELECT '{n}' AS "column", {r('coalesce(sum(abs(f - g) * gap), 0)')} AS wasserstein FROM {cdf_sql(c)}""" for n, c in NAMES)


def _weighted(spark, sf):
    """Quantities weighted by price against quantities weighted by tax."""
    lines = table(spark, sf, "lineitem")
    counts = lines.groupBy(F.col("l_quantity").alias("value")).agg(
        F.sum("l_extendedprice").alias("w_o"), F.sum(F.col("l_tax") + 0.01).alias("w_p"))
    return divergence.transport(
        counts.withColumn("column", F.lit("l_quantity")), ("column",), "w_o", "w_p").select("column", "wasserstein")


QUERIES["wasserstein_weighted"] = lambda spark, sf: rounded(_weighted(spark, sf))
SQL["wasserstein_weighted"] = f"""SELECT 'l_quantity' AS "column", {r('sum(abs(f - g) * gap)')} AS wasserstein FROM
 (SELECT sum(a) OVER w / sum(a) OVER () AS f, sum(z) OVER w / sum(z) OVER () AS g, lead(v) OVER (ORDER BY v) - v AS gap
 FROM (SELECT l_quantity AS v, sum(l_extendedprice) AS a, sum(l_tax + 0.01) AS z FROM lineitem GROUP BY 1) WINDOW w AS (ORDER BY v))"""

QUERIES["ks_test"] = lambda spark, sf: rounded(divergence.transport(side_counts(pair_cells(
    _quantities(spark, sf), [n for n, _ in NAMES], number))).select("column", "ks_statistic", "ks_pvalue"))
SQL["ks_test"] = f"WITH {MOVED} " + "\nUNION ALL\n".join(
    f"""SELECT '{n}' AS "column", {r('max(abs(f - g))')} AS ks_statistic, {r(ks_p('max(abs(f - g))'))} AS ks_pvalue FROM {cdf_sql(c)}"""
    for n, c in NAMES)


def drift_sql(c: str, n: str, source: str = "moved", bins: int = 50, digits: int | None = 6) -> str:
    """Rounded, or for use in a larger query as it is (``digits`` None)."""
    r = (lambda e: f"({e})") if digits is None else (lambda e: _round(e, digits))
    p = f"(n_o + 1e-10) / (sum(n_o) OVER () + {bins} * 1e-10)"
    q = f"(n_p + 1e-10) / (sum(n_p) OVER () + {bins} * 1e-10)"
    return f"""SELECT '{n}' AS "column", w AS wasserstein, ks AS ks_statistic, pv AS ks_pvalue, kl AS kl_divergence, js AS js_distance, tvd, shift AS mean_shift, ratio AS std_ratio FROM
 (SELECT {r('coalesce(sum(abs(f - g) * gap), 0)')} AS w, {r('max(abs(f - g))')} AS ks, {r(ks_p('max(abs(f - g))'))} AS pv FROM {cdf_sql(c, source)}),
 (SELECT {r('sum(CASE WHEN p > 1e-15 THEN p * log2(p / CASE WHEN small THEN (q + 1e-10) / (1 + ' + str(bins) + ' * 1e-10) ELSE q END) ELSE 0 END)')} AS kl,
   {r('sqrt(greatest(sum(0.5 * p * log2(p / ((p + q) / 2)) + 0.5 * q * log2(q / ((p + q) / 2))), 0))')} AS js
  FROM (SELECT *, min(q) OVER () < 1e-15 AS small FROM (SELECT {p} AS p, {q} AS q FROM {hist_sql(c, bins, source)}))),
 (SELECT {r('0.5 * sum(abs(p - q))')} AS tvd FROM (SELECT n_o / sum(n_o) OVER () AS p, n_p / sum(n_p) OVER () AS q FROM {hist_sql(c, bins, source)})),
 (SELECT {r(f'CASE WHEN stddev_pop({c}_o) > 0 THEN (avg({c}_p) - avg({c}_o)) / stddev_pop({c}_o) ELSE 0 END')} AS shift,
   {r(f'CASE WHEN stddev_pop({c}_o) > 0 THEN stddev_pop({c}_p) / stddev_pop({c}_o) ELSE 1 END')} AS ratio FROM {source})"""


QUERIES["numeric_drift"] = lambda spark, sf: rounded(divergence.numeric_drift(
    _quantities(spark, sf), [n for n, _ in NAMES]))
SQL["numeric_drift"] = f"WITH {MOVED} " + "\nUNION ALL\n".join(drift_sql(c, n) for n, c in NAMES)

QUERIES["category_drift"] = lambda spark, sf: rounded(divergence.category_drift(
    _returned(spark, sf), include_wasserstein=True))
_RATE = "(SELECT avg(({c}_o <> {c}_p)::INT) FROM coarse)"
SQL["category_drift"] = f"""WITH {CF}, {_TOTALS},
idx AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS i FROM cf),
wass AS (SELECT "column", sum(abs(f - g)) AS w FROM (SELECT "column", i, sum(p_o) OVER (PARTITION BY "column" ORDER BY i) AS f,
 sum(p_p) OVER (PARTITION BY "column" ORDER BY i) AS g FROM idx) GROUP BY 1)
SELECT "column", {r(f"CASE WHEN " + '"column"' + f" = 'p_brand' THEN {_RATE.format(c='brand')} ELSE {_RATE.format(c='name')} END")} AS drift_rate,
 {r(f'{_KL} / ln(2)')} AS kl_divergence, {r(f'sqrt(greatest({_JS}, 0))')} AS js_distance, {r('0.5 * sum(abs(p_o - p_p))')} AS tvd,
 {r(_H)} AS entropy_original, {r(_H.replace('p_o', 'p_p'))} AS entropy_protected, {r(f"({_H.replace('p_o', 'p_p')}) - ({_H})")} AS entropy_difference,
 {r('max(w)')} AS wasserstein FROM s JOIN wass USING ("column") GROUP BY 1"""

QUERIES["category_top_changes"] = lambda spark, sf: rounded(divergence.top_changes(_returned(spark, sf)))
TOP_CHANGES = """SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY round(abs(p_p - p_o), 12) DESC, value) AS rank FROM cf"""
SQL["category_top_changes"] = f"""WITH {CF} SELECT "column", rank, value, {r('p_o')} AS original, {r('p_p')} AS protected,
 {r('p_p - p_o')} AS difference FROM ({TOP_CHANGES}) WHERE rank <= 10"""

QUERIES["all_divergences"] = lambda spark, sf: rounded(divergence.all_divergences(
    _gappy(spark, sf), ["o_totalprice"], ["o_orderpriority"]))
_ALL = f"""
num AS (SELECT price_o, price_p FROM known),
drift AS ({drift_sql('price', 'o_totalprice', 'num', digits=None)}),
htvd AS (SELECT 0.5 * sum(abs(p - q)) AS tvd FROM (SELECT n_o / sum(n_o) OVER () AS p, n_p / sum(n_p) OVER () AS q FROM {hist_sql('price', 50, 'num')})),
cat AS (SELECT *, min(p_p) OVER () < 1e-15 AS zero, count(*) OVER () AS k FROM freq),
cats AS (SELECT *, CASE WHEN zero THEN (p_p + 1e-10) / (1 + k * 1e-10) ELSE p_p END AS q FROM cat),
metrics AS (SELECT 'o_totalprice' AS "column", 'kl_divergence' AS metric, kl_divergence AS value, false AS is_symmetric, 'bits' AS unit FROM drift
UNION ALL SELECT 'o_totalprice', 'js_distance', js_distance, true, 'bits' FROM drift
UNION ALL SELECT 'o_totalprice', 'wasserstein', wasserstein, true, 'value' FROM drift
UNION ALL SELECT 'o_totalprice', 'tvd', tvd, true, 'probability' FROM htvd
UNION ALL SELECT 'o_orderpriority', 'kl_divergence', {_KL}, false, 'nats' FROM cats
UNION ALL SELECT 'o_orderpriority', 'js_distance', sqrt(greatest({_JS}, 0)), true, 'bits' FROM cats
UNION ALL SELECT 'o_orderpriority', 'tvd', 0.5 * sum(abs(p_o - p_p)), true, 'probability' FROM cats)"""
METRICS = f"{GAPPY}, {FREQ}, {_ALL}"
SQL["all_divergences"] = f"""WITH {METRICS} SELECT "column", metric, {r('value')} AS value, is_symmetric, unit FROM metrics"""


def _light_lines(spark, sf):
    """Prices weighted by discount against prices weighted by tax, by return flag: weights below one."""
    lines = table(spark, sf, "lineitem")
    sample = lambda weight: lines.select("l_returnflag", F.col("l_extendedprice").alias("value"), weight.alias("weight"))
    return divergence.weighted_transport(sample(F.col("l_discount") / 3), sample((F.col("l_tax") + 0.001) / 7), ["l_returnflag"])


QUERIES["wasserstein_real_weights"] = lambda spark, sf: rounded(_light_lines(spark, sf))
SQL["wasserstein_real_weights"] = f"""WITH c AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_discount / 3) AS a, sum((l_tax + 0.001) / 7) AS z FROM lineitem GROUP BY 1, 2),
f AS (SELECT l_returnflag, sum(a) OVER w / sum(a) OVER (PARTITION BY l_returnflag) AS f, sum(z) OVER w / sum(z) OVER (PARTITION BY l_returnflag) AS g,
 lead(v) OVER w - v AS gap FROM c WINDOW w AS (PARTITION BY l_returnflag ORDER BY v))
SELECT l_returnflag, {r('sum(abs(f - g) * gap)')} AS wasserstein, {r('max(abs(f - g))')} AS ks_statistic FROM f GROUP BY 1"""


def _fixed_categories(spark, sf):
    """Ship flags of returned lines over all flags there are, and two that nothing has."""
    lines = table(spark, sf, "lineitem")
    flags = lines.select(F.lit("flag").alias("column"), F.col("l_returnflag").alias("value")).distinct()
    extra = spark.createDataFrame([("flag", "X"), ("flag", "Y")], "column string, value string")
    cells = lines.where("l_returnflag <> 'N'").select(
        F.lit("flag").alias("column"), F.col("l_returnflag").alias("o"), F.when(F.col("l_tax") > 0.04, "R").otherwise(F.col("l_returnflag")).alias("p"))
    return divergence.distribution(cells, categories=flags.unionByName(extra))


QUERIES["category_set"] = lambda spark, sf: _fixed_categories(spark, sf).select("column", "value", "n_o", "n_p")
SQL["category_set"] = """WITH kept AS (SELECT l_returnflag AS o, CASE WHEN l_tax > 0.04 THEN 'R' ELSE l_returnflag END AS p FROM lineitem WHERE l_returnflag <> 'N')
SELECT 'flag' AS "column", value, (SELECT count(*) FROM kept WHERE o = value) AS n_o, (SELECT count(*) FROM kept WHERE p = value) AS n_p
FROM (SELECT DISTINCT l_returnflag AS value FROM lineitem UNION SELECT 'X' UNION SELECT 'Y')"""


def _long_categories(spark, sf):
    """Places of part names behind a beginning longer than what deals them out."""
    parts = table(spark, sf, "part")
    long = F.concat(F.lit("part-" * 30), "p_name", F.lit("/"), F.col("p_partkey").cast("string"))
    counts = parts.select(F.col("p_brand").alias("column"), long.alias("value"))
    return divergence.category_index(counts, shared=100)


QUERIES["category_index"] = _long_categories
SQL["category_index"] = """SELECT p_brand AS "column", repeat('part-', 30) || p_name || '/' || p_partkey AS value,
 row_number() OVER (PARTITION BY p_brand ORDER BY repeat('part-', 30) || p_name || '/' || p_partkey) - 1 AS index FROM part"""
