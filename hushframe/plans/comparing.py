"""Original orders against their release."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from hushframe.operators import compare, pairs
from hushframe.operators.protect import ColumnRule, protect
from hushframe.plans.common import RELEASE, RELEASED, SECRET, orders_pairs, orders_release, r, rounded, sql_laplace, sql_uniform, table

QUERIES, SQL = {}, {}


def _gappy(spark, sf):
    """The pairs with values missing on either side."""
    paired = orders_pairs(spark, sf)
    key = F.col("o_orderkey")
    return paired.select(
        "o_orderkey",
        F.struct(
            F.when(key % 11 != 0, F.col("orig.o_totalprice")).alias("o_totalprice"),
            F.when(key % 11 != 0, F.col("orig.o_orderdate")).alias("o_orderdate"),
            F.when(key % 11 != 0, F.col("orig.o_orderpriority")).alias("o_orderpriority"),
        ).alias("orig"),
        F.struct(
            F.when(key % 13 != 0, F.col("prot.o_totalprice")).alias("o_totalprice"),
            F.when(key % 13 != 0, F.col("prot.o_orderdate")).alias("o_orderdate"),
            F.when(key % 13 != 0, F.col("prot.o_orderpriority")).alias("o_orderpriority"),
        ).alias("prot"),
    )


GAPPY = f"""{RELEASED},
known AS (SELECT * FROM released WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0)"""
_MISSING = "(SELECT count(*) FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0)"

QUERIES["compare_numeric"] = lambda spark, sf: rounded(compare.compare_numeric(_gappy(spark, sf)), 3)
SQL["compare_numeric"] = f"""WITH {GAPPY}
SELECT 'o_totalprice' AS "column", count(*) AS count, {_MISSING} AS null_count,
 {r('avg(abs(price_p - price_o))', 3)} AS mae, {r('sqrt(avg(pow(price_p - price_o, 2)))', 3)} AS rmse,
 {r('avg(abs((price_p - price_o) / price_o)) * 100', 3)} AS mape, {r('max(abs(price_p - price_o))', 3)} AS max_absolute_error,
 {r('avg(price_o)', 3)} AS mean_original, {r('avg(price_p)', 3)} AS mean_protected,
 {r('stddev_samp(price_o)', 3)} AS std_original, {r('stddev_samp(price_p)', 3)} AS std_protected,
 {r('min(price_o)', 3)} AS min_original, {r('min(price_p)', 3)} AS min_protected,
 {r('max(price_o)', 3)} AS max_original, {r('max(price_p)', 3)} AS max_protected,
 {r('avg(price_p) - avg(price_o)', 3)} AS mean_difference,
 {r('abs((avg(price_p) - avg(price_o)) / avg(price_o)) * 100', 3)} AS mean_relative_error,
 {r('stddev_samp(price_p) - stddev_samp(price_o)', 3)} AS std_difference,
 {r('abs((stddev_samp(price_p) - stddev_samp(price_o)) / stddev_samp(price_o)) * 100', 3)} AS std_relative_error,
 {r('median(price_o)', 3)} AS median_original, {r('median(price_p)', 3)} AS median_protected FROM known"""

QUERIES["compare_percentiles"] = lambda spark, sf: rounded(compare.compare_percentiles(_gappy(spark, sf)), 3)
SQL["compare_percentiles"] = f"WITH {GAPPY} " + "\nUNION ALL\n".join(
    f"""SELECT 'o_totalprice' AS "column", 'p{p}' AS percentile, {r(f'quantile_cont(price_o, {p / 100})', 3)} AS original,
 {r(f'quantile_cont(price_p, {p / 100})', 3)} AS protected,
 {r(f'quantile_cont(price_p, {p / 100}) - quantile_cont(price_o, {p / 100})', 3)} AS difference FROM known"""
    for p in (5, 25, 50, 75, 95))

QUERIES["compare_category"] = lambda spark, sf: rounded(compare.compare_categorical(_gappy(spark, sf)))
FREQ = """freq AS (SELECT cat, coalesce(a.n, 0) AS n_o, coalesce(b.n, 0) AS n_p,
 coalesce(a.n, 0) / (SELECT count(*) FROM known)::DOUBLE AS p_o, coalesce(b.n, 0) / (SELECT count(*) FROM known)::DOUBLE AS p_p
 FROM (SELECT prio_o AS cat, count(*) AS n FROM known GROUP BY 1) a FULL JOIN
 (SELECT prio_p AS cat, count(*) AS n FROM known GROUP BY 1) b USING (cat))"""
SQL["compare_category"] = f"""WITH {GAPPY}, {FREQ}
SELECT 'o_orderpriority' AS "column", (SELECT count(*) FROM known) AS count, {_MISSING} AS null_count,
 (SELECT {r('avg((prio_o <> prio_p)::INT)')} FROM known) AS category_drift,
 count(*) FILTER (n_o > 0) AS cardinality_original, count(*) FILTER (n_p > 0) AS cardinality_protected,
 count(*) FILTER (n_p > 0) - count(*) FILTER (n_o > 0) AS cardinality_difference,
 (SELECT cat FROM freq ORDER BY n_o DESC, cat LIMIT 1) AS mode_original,
 (SELECT cat FROM freq ORDER BY n_p DESC, cat LIMIT 1) AS mode_protected,
 (SELECT cat FROM freq ORDER BY n_o DESC, cat LIMIT 1) = (SELECT cat FROM freq ORDER BY n_p DESC, cat LIMIT 1) AS mode_preserved,
 {r('avg(abs(p_p - p_o))')} AS frequency_mae, count(*) FILTER (n_o = 0) AS new_categories,
 count(*) FILTER (n_p = 0) AS missing_categories FROM freq"""


def _returned(spark, sf):
    """Pairs whose categories differ: brand against a coarser brand."""
    part = table(spark, sf, "part")
    return part.select(
        "p_partkey", F.struct("p_brand", "p_name").alias("orig"),
        F.struct(
            F.when(F.col("p_size") > 25, F.concat(F.substring("p_brand", 1, 7), F.lit("x")))
            .otherwise(F.col("p_brand")).alias("p_brand"),
            F.concat(F.substring_index("p_name", " ", 1), F.lit(" thing")).alias("p_name"),
        ).alias("prot"),
    )


COARSE = """coarse AS (SELECT p_brand AS brand_o, CASE WHEN p_size > 25 THEN substr(p_brand, 1, 7) || 'x' ELSE p_brand END AS brand_p,
 p_name AS name_o, split_part(p_name, ' ', 1) || ' thing' AS name_p FROM part)"""


def coarse_freq(c: str) -> str:
    return f"""SELECT 'p_{c}' AS "column", cat AS value, coalesce(a.n, 0) AS n_o, coalesce(b.n, 0) AS n_p,
 coalesce(a.n, 0) / (SELECT count(*) FROM part)::DOUBLE AS p_o, coalesce(b.n, 0) / (SELECT count(*) FROM part)::DOUBLE AS p_p
 FROM (SELECT {c}_o AS cat, count(*) AS n FROM coarse GROUP BY 1) a FULL JOIN (SELECT {c}_p AS cat, count(*) AS n FROM coarse GROUP BY 1) b USING (cat)"""


CF = f"{COARSE}, cf AS ({coarse_freq('brand')} UNION ALL {coarse_freq('name')})"

QUERIES["category_changes"] = lambda spark, sf: compare.category_changes(_returned(spark, sf))
SQL["category_changes"] = f"""WITH {CF} SELECT "column", value, CASE WHEN n_o = 0 THEN 'new' ELSE 'missing' END AS change
 FROM cf WHERE n_o = 0 OR n_p = 0"""

QUERIES["compare_frequencies"] = lambda spark, sf: rounded(compare.compare_frequencies(_returned(spark, sf), top_n=5))
SQL["compare_frequencies"] = f"""WITH {CF}, ranked AS (SELECT *,
 row_number() OVER (PARTITION BY "column" ORDER BY n_o DESC, value) AS ro, row_number() OVER (PARTITION BY "column" ORDER BY n_p DESC, value) AS rp FROM cf)
SELECT "column", value, {r('p_o')} AS original, {r('p_p')} AS protected FROM ranked WHERE (ro <= 5 AND n_o > 0) OR (rp <= 5 AND n_p > 0)"""

QUERIES["compare_dates"] = lambda spark, sf: rounded(compare.compare_dates(_gappy(spark, sf)))
_GAP = "(date_p::DATE - date_o::DATE)"
SQL["compare_dates"] = f"""WITH {GAPPY} SELECT 'o_orderdate' AS "column", count(*) AS count, {_MISSING} AS null_count,
 {r(f'avg(abs({_GAP}))')} AS mae_days, {r(f'sqrt(avg({_GAP} * {_GAP}))')} AS rmse_days,
 max(abs({_GAP}))::DOUBLE AS max_absolute_error_days,
 (max(date_o)::DATE - min(date_o)::DATE) AS range_original_days, (max(date_p)::DATE - min(date_p)::DATE) AS range_protected_days,
 (min(date_p)::DATE - min(date_o)::DATE) AS min_date_diff_days, (max(date_p)::DATE - max(date_o)::DATE) AS max_date_diff_days,
 (max(date_p)::DATE - min(date_p)::DATE) - (max(date_o)::DATE - min(date_o)::DATE) AS range_difference_days FROM known"""

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]
_SCALES = {"l_quantity": (0, 50, 5.0), "l_extendedprice": (0, 105000, 2.0), "l_discount": (0, 0.1, 10.0)}


def lineitem_pairs(spark, sf):
    """Three correlated numbers of lineitem beside their release. A line is
    not unique by its columns, so equal lines are told apart by a count."""
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    copy = F.row_number().over(Window.partitionBy(*columns).orderBy(*NUMBERS))
    lines = table(spark, sf, "lineitem").select(*columns, copy.alias("copy"), *NUMBERS)
    rules = {c: ColumnRule(lower=lo, upper=hi, epsilon=e) for c, (lo, hi, e) in _SCALES.items()}
    key = [*columns, "copy"]
    rules.update({k: ColumnRule("passthrough") for k in key})
    return protect(lines, rules, key, SECRET, RELEASE, keep_original=True, unique_key=True).data


_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
_LK = f"{_LINE}, copy"
LINES = f"""lines AS (SELECT {_LINE}, l_quantity, l_extendedprice, l_discount,
 row_number() OVER (PARTITION BY {_LINE} ORDER BY l_quantity, l_extendedprice, l_discount) AS copy FROM lineitem),
noisy AS (SELECT """ + ", ".join(
    f"{c} AS {c}_o, least(greatest({c}, {lo}), {hi}) + {sql_laplace(f'({hi - lo}) / {e}', sql_uniform(c, _LK))} AS {c}_p"
    for c, (lo, hi, e) in _SCALES.items()) + " FROM lines)"
_CPAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1:]]
SHIFT = "shift AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS column1, '{b}' AS column2, corr({a}_o, {b}_o) AS original, corr({a}_p, {b}_p) AS protected FROM noisy"
    for a, b in _CPAIRS) + ")"

QUERIES["corr_preservation"] = lambda spark, sf: rounded(compare.correlation_preservation(
    lineitem_pairs(spark, sf), NUMBERS, threshold=0.005))
SQL["corr_preservation"] = f"""WITH {LINES}, {SHIFT} SELECT {r('avg(abs(protected - original))')} AS mae,
 {r('sqrt(avg(pow(protected - original, 2)))')} AS rmse, {r('max(abs(protected - original))')} AS max_absolute_error,
 count(*) FILTER (abs(protected - original) <= 0.005) AS preserved_count, count(*) AS total_count,
 {r('avg((abs(protected - original) <= 0.005)::INT)')} AS preservation_rate FROM shift"""

QUERIES["compare_columns"] = lambda spark, sf: rounded(compare.compare_columns(_gappy(spark, sf)), 3)
_COLUMNS = f"""SELECT 'o_totalprice' AS "column", 'numeric' AS kind, count(*) AS count, {_MISSING} AS null_count,
 avg(abs(price_p - price_o)) AS mae, sqrt(avg(pow(price_p - price_o, 2))) AS rmse, max(abs(price_p - price_o)) AS max_error, NULL::DOUBLE AS drift FROM known
UNION ALL SELECT 'o_orderpriority', 'categorical', count(*), {_MISSING}, NULL, NULL, NULL, avg((prio_o <> prio_p)::INT) FROM known
UNION ALL SELECT 'o_orderdate', 'date', count(*), {_MISSING}, avg(abs({_GAP})), sqrt(avg({_GAP} * {_GAP})), max(abs({_GAP})), NULL FROM known"""
SQL["compare_columns"] = f"""WITH {GAPPY} SELECT "column", kind, count, null_count, {r('mae', 3)} AS mae, {r('rmse', 3)} AS rmse,
 {r('max_error', 3)} AS max_error, {r('drift', 3)} AS drift FROM ({_COLUMNS})"""

QUERIES["compare_dataset"] = lambda spark, sf: rounded(compare.compare_dataset(
    lineitem_pairs(spark, sf), numeric=NUMBERS), 4)
SQL["compare_dataset"] = f"""WITH {LINES}, {SHIFT} SELECT (SELECT count(*) FROM lines) AS row_count, 3::BIGINT AS numeric_columns,
 0::BIGINT AS categorical_columns, 0::BIGINT AS date_columns,
 (SELECT {r(' + '.join(f'avg(abs({c}_p - {c}_o))' for c in NUMBERS).join(('(', ') / 3')), 4)} FROM noisy) AS overall_numeric_mae,
 (SELECT {r(' + '.join(f'sqrt(avg(pow({c}_p - {c}_o, 2)))' for c in NUMBERS).join(('(', ') / 3')), 4)} FROM noisy) AS overall_numeric_rmse,
 NULL::DOUBLE AS mean_category_drift, {r('avg((abs(protected - original) <= 0.1)::INT)', 4)} AS correlation_preservation_rate FROM shift"""


def compare_by_key(spark, sf):
    """Original and release as two tables, matched by key."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    released = orders_release(spark, sf, unique_key=True).data.select("o_orderkey", "o_totalprice")
    paired = pairs.pair_by_key(orders, released, ["o_orderkey"])
    return rounded(compare.compare_numeric(paired).select("column", "count", "mae", "rmse"), 3)


QUERIES["compare_by_key"] = compare_by_key
SQL["compare_by_key"] = f"""WITH {RELEASED} SELECT 'o_totalprice' AS "column", count(*) AS count,
 {r('avg(abs(price_p - price_o))', 3)} AS mae, {r('sqrt(avg(pow(price_p - price_o, 2)))', 3)} AS rmse FROM released"""


def _empty_pairs(spark, sf):
    """Orders whose totals are missing on one side and whose priorities on both."""
    orders = table(spark, sf, "orders")
    none = F.lit(None)
    return orders.select(
        F.struct(F.col("o_totalprice").alias("total"), none.cast("string").alias("priority"), none.cast("timestamp").alias("day")).alias("orig"),
        F.struct(none.cast("double").alias("total"), none.cast("string").alias("priority"), F.col("o_orderdate").alias("day")).alias("prot"),
    )


QUERIES["compare_empty"] = lambda spark, sf: compare.compare_numeric(_empty_pairs(spark, sf), ["total"])
SQL["compare_empty"] = """SELECT 'total' AS "column", 0::BIGINT AS count, count(*) AS null_count, NULL::DOUBLE AS mape, """ + ", ".join(
    f"0.0::DOUBLE AS {c}" for c in (
        "mae", "rmse", "max_absolute_error", "mean_original", "mean_protected", "std_original", "std_protected", "min_original", "min_protected",
        "max_original", "max_protected", "mean_difference", "std_difference", "median_original", "median_protected")
) + ", NULL::DOUBLE AS mean_relative_error, NULL::DOUBLE AS std_relative_error FROM orders"

QUERIES["compare_empty_columns"] = lambda spark, sf: compare.compare_columns(
    _empty_pairs(spark, sf), ["total"], ["priority"], ["day"]).select("column", "kind", "count", "null_count", "drift")
SQL["compare_empty_columns"] = """SELECT "column", kind, 0::BIGINT AS count, n AS null_count, drift FROM (SELECT count(*) AS n FROM orders),
 (VALUES ('total', 'numeric', NULL), ('priority', 'categorical', 0.0::DOUBLE), ('day', 'date', NULL)) t("column", kind, drift)"""
