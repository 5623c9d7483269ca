"""Protected copies of columns and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.functions import keyed
from hushframe.operators.protect import (
    EXCLUDE, PASSTHROUGH, ColumnRule, protect, protect_with_budget,
)
from hushframe.operators import sampling
from hushframe.plans.common import (
    RELEASE, RELEASED, SECRET, orders_release, r, rounded, sql_category_law,
    sql_gaussian, sql_laplace, sql_uniform, table,
)

QUERIES, SQL = {}, {}


def _only(df, key, rules):
    """Rules for some columns, the key passed on, the rest left out."""
    full = {c: ColumnRule(EXCLUDE) for c in df.columns}
    full.update({k: ColumnRule(PASSTHROUGH) for k in key})
    full.update(rules)
    return full


def _orders(spark, sf, rules, **options):
    orders = table(spark, sf, "orders")
    return protect(orders, _only(orders, ["o_orderkey"], rules), ["o_orderkey"], SECRET, RELEASE, **options)


QUERIES["protect_dataset"] = lambda spark, sf: rounded(orders_release(spark, sf).data, 3)
SQL["protect_dataset"] = f"""WITH {RELEASED} SELECT {r('price_p', 3)} AS o_totalprice, date_p AS o_orderdate,
 prio_p AS o_orderpriority, o_orderkey, o_orderstatus FROM released"""


def protect_numeric(spark, sf):
    """Bounded numbers: whole ones stay whole, some of both are missing."""
    customer = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("c_nationkey"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"),
    )
    rules = {
        "c_custkey": ColumnRule(PASSTHROUGH),
        "c_nationkey": ColumnRule(lower=0, upper=24, epsilon=2.0),
        "c_acctbal": ColumnRule(lower=-500.0, upper=5000.0, epsilon=0.5),
    }
    return rounded(protect(customer, rules, ["c_custkey"], SECRET, RELEASE).data, 4)


QUERIES["protect_numeric"] = protect_numeric
SQL["protect_numeric"] = f"""SELECT c_custkey,
 CASE WHEN c_custkey % 5 <> 0 THEN round_even(c_nationkey + {sql_laplace('24.0 / 2', sql_uniform('c_nationkey', 'c_custkey'))}, 0)::BIGINT END AS c_nationkey,
 CASE WHEN c_custkey % 7 <> 0 THEN {r('least(greatest(c_acctbal, -500), 5000) + ' + sql_laplace('5500.0 / 0.5', sql_uniform('c_acctbal', 'c_custkey')), 4)} END AS c_acctbal
 FROM customer"""


def protect_gaussian(spark, sf):
    """Unbounded numbers: one with a given sensitivity, one whose sensitivity
    is the spread of the data, one bounded column sent to Gaussian noise."""
    customer = table(spark, sf, "customer")
    rules = _only(customer, ["c_custkey"], {
        "c_acctbal": ColumnRule(epsilon=1.0),
        "c_nationkey": ColumnRule(epsilon=1.0, lower=0, upper=24, mechanism="gaussian", delta=1e-5),
    })
    return rounded(protect(customer, rules, ["c_custkey"], SECRET, RELEASE).data, 4)


def _sigma(sensitivity: str, delta: str) -> str:
    return f"({sensitivity}) / sqrt(2 * pow(sqrt(-ln({delta}) + 1.0) - sqrt(-ln({delta})), 2))"


def _gauss(column: str, sensitivity: str, delta: str, key: str = "c_custkey") -> str:
    return sql_gaussian(_sigma(sensitivity, delta), sql_uniform(column, key, 0), sql_uniform(column, key, 1))


QUERIES["protect_gaussian"] = protect_gaussian
SQL["protect_gaussian"] = f"""SELECT c_custkey,
 {r("c_acctbal + " + _gauss('c_acctbal', '(SELECT max(c_acctbal) - min(c_acctbal) FROM customer)', '1e-6'), 4)} AS c_acctbal,
 round_even(c_nationkey + {_gauss('c_nationkey', '24.0', '1e-5')}, 0)::BIGINT AS c_nationkey FROM customer"""

QUERIES["protect_category"] = lambda spark, sf: _orders(spark, sf, {
    "o_orderpriority": ColumnRule(epsilon=1.0),
    "o_orderstatus": ColumnRule(epsilon=0.1, score_sensitivity=20.0),
}).data


def _drawn(column: str, law: str) -> str:
    u = sql_uniform(column, "o_orderkey")
    return f"""(SELECT cat FROM {law} WHERE ({u} >= lo OR place = 1) AND ({u} < hi OR place = k))"""


SQL["protect_category"] = f"""WITH {sql_category_law('orders', 'o_orderpriority', '1.0 / 2', 'pl')},
{sql_category_law('orders', 'o_orderstatus', '0.1 / 40', 'sl')}
SELECT o_orderkey, pl.cat AS o_orderpriority, sl.cat AS o_orderstatus
FROM (SELECT *, {sql_uniform('o_orderpriority', 'o_orderkey')} AS u, {sql_uniform('o_orderstatus', 'o_orderkey')} AS v FROM orders) o
JOIN pl ON (u >= pl.lo OR pl.place = 1) AND (u < pl.hi OR pl.place = pl.k)
JOIN sl ON (v >= sl.lo OR sl.place = 1) AND (v < sl.hi OR sl.place = sl.k)"""


def category_law_levels(spark, sf):
    """High-cardinality draws: customer ids of orders as categories, a small
    head so that most draws go through levels and positions. What is checked
    is the law: draws per level of equal counts."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("cust"))
    law = sampling.category_laws(orders, {"cust": (0.1, 1.0)}, head=20)["cust"]
    rules = {"o_orderkey": ColumnRule(PASSTHROUGH), "cust": ColumnRule(epsilon=0.1)}
    digest = keyed.cell_digest(F.lit(SECRET), RELEASE, "cust", keyed.key_columns(orders, ["o_orderkey"]))
    frame, cell = law.draw(orders, "cust", digest)
    counts = sampling.category_counts(orders, ["cust"]).select(F.col("value").alias("drawn"), "n")
    return (
        frame.select(cell.alias("drawn")).join(counts, "drawn")
        .groupBy("n").agg(F.count(F.lit(1)).alias("draws"))
    )


QUERIES["category_law_levels"] = category_law_levels
SQL["category_law_levels"] = f"""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
lv AS (SELECT n, count(*) AS m, count(*) * exp((n - max(n) OVER ()) * 0.05) AS w FROM c GROUP BY n),
cdf AS (SELECT n, sum(w) OVER (ORDER BY n DESC) / sum(w) OVER () AS hi,
 (sum(w) OVER (ORDER BY n DESC) - w) / sum(w) OVER () AS lo FROM lv)
SELECT n, count(*) AS draws FROM (SELECT {sql_uniform('cust', 'o_orderkey')} AS u FROM orders)
JOIN cdf ON u >= lo AND u < hi GROUP BY n"""

QUERIES["protect_date"] = lambda spark, sf: _orders(spark, sf, {"o_orderdate": ColumnRule(epsilon=2.0)}).data
SQL["protect_date"] = f"""WITH b AS (SELECT min(o_orderdate)::DATE - DATE '1970-01-01' AS lo, max(o_orderdate)::DATE - DATE '1970-01-01' AS hi FROM orders)
SELECT o_orderkey, (DATE '1970-01-01' + least(greatest(round_even((o_orderdate::DATE - DATE '1970-01-01')
 + {sql_laplace('(hi - lo) / 2.0', sql_uniform('o_orderdate', 'o_orderkey'))}, 0), -719162), 2932896)::INTEGER)::TIMESTAMP AS o_orderdate
FROM orders, b"""


def protect_seconds(spark, sf):
    events = table(spark, sf, "events")
    rules = _only(events, ["event_id"], {
        "ts": ColumnRule(epsilon=2.0, unit="s", lower="2024-01-01 00:00:00", upper="2024-02-01 00:00:00")})
    return protect(events, rules, ["event_id"], SECRET, RELEASE).data


QUERIES["protect_seconds"] = protect_seconds
SQL["protect_seconds"] = f"""SELECT event_id, make_timestamp((round_even(
 least(greatest(epoch_us(ts) / 1e6, epoch_us(TIMESTAMP '2024-01-01') / 1e6), epoch_us(TIMESTAMP '2024-02-01') / 1e6)
 + {sql_laplace('31 * 86400.0 / 2', sql_uniform('ts', 'event_id'))}, 0) * 1000000)::BIGINT) AS ts FROM events"""


def protect_with_total(spark, sf):
    """A total of 3 over three columns of customer."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment", "c_name")
    release = protect_with_budget(
        customer, 3.0, ["c_custkey"], SECRET, ["c_acctbal", "c_nationkey", "c_mktsegment"], ["c_name"],
        rules={
            "c_acctbal": ColumnRule(lower=-1000.0, upper=10000.0), "c_nationkey": ColumnRule(lower=0, upper=24),
            "c_mktsegment": ColumnRule(score_sensitivity=50.0),
        }, release=RELEASE)
    total = F.lit(release.total_epsilon)
    return rounded(release.data.withColumn("total_epsilon", total), 4)


QUERIES["protect_with_budget"] = protect_with_total
SQL["protect_with_budget"] = f"""WITH {sql_category_law('customer', 'c_mktsegment', '1.0 / 100')}
SELECT {r('least(greatest(c_acctbal, -1000), 10000) + ' + sql_laplace('11000.0', sql_uniform('c_acctbal', 'c_custkey')), 4)} AS c_acctbal,
 round_even(c_nationkey + {sql_laplace('24.0', sql_uniform('c_nationkey', 'c_custkey'))}, 0)::BIGINT AS c_nationkey,
 cat AS c_mktsegment, c_custkey, 3.0::DOUBLE AS total_epsilon
FROM (SELECT *, {sql_uniform('c_mktsegment', 'c_custkey')} AS u FROM customer) JOIN law
 ON (u >= lo OR place = 1) AND (u < hi OR place = k)"""


def protect_bad_column(spark, sf):
    """Columns that cannot be protected leave as nulls, never as they are."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.lit(7.0).alias("flat_number"), F.lit("same").alias("flat_text"),
        F.lit("2020-01-01").cast("timestamp_ntz").alias("flat_date"),
        (F.col("o_totalprice") > 250000).alias("is_large"),
    )
    rules = {
        "o_orderkey": ColumnRule(PASSTHROUGH),
        "is_large": ColumnRule(epsilon=0.1, score_sensitivity=1000.0),
    }
    data = protect(orders, rules, ["o_orderkey"], SECRET, RELEASE, on_error="null").data
    return data.groupBy("flat_number", "flat_text", "flat_date", "is_large").agg(F.count(F.lit(1)).alias("n"))


QUERIES["protect_bad_column"] = protect_bad_column
SQL["protect_bad_column"] = f"""WITH flagged AS (SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'true' ELSE 'false' END AS large FROM orders),
{sql_category_law('flagged', 'large', '0.1 / 2000')}
SELECT NULL::DOUBLE AS flat_number, 'same' AS flat_text, NULL::TIMESTAMP AS flat_date, (cat = 'true') AS is_large, count(*) AS n
FROM (SELECT {sql_uniform('is_large', 'o_orderkey')} AS u FROM flagged) JOIN law
 ON (u >= lo OR place = 1) AND (u < hi OR place = k) GROUP BY cat"""


def release_summary(spark, sf):
    return orders_release(spark, sf, unique_key=True).summary().select(
        "column", "mode", "mechanism", "epsilon", "delta", "null_count", "error")


QUERIES["release_summary"] = release_summary
SQL["release_summary"] = """SELECT * FROM (VALUES
 ('o_orderkey', 'passthrough', NULL, NULL), ('o_custkey', 'exclude', NULL, NULL), ('o_orderstatus', 'passthrough', NULL, NULL),
 ('o_totalprice', 'protect', 'laplace', 1.0::DOUBLE), ('o_orderdate', 'protect', 'laplace', 1.0::DOUBLE),
 ('o_orderpriority', 'protect', 'exponential', 1.0::DOUBLE)) t("column", mode, mechanism, epsilon),
 (SELECT NULL::DOUBLE AS delta, count(*) - count(o_totalprice) AS null_count, NULL::VARCHAR AS error FROM orders)"""

QUERIES["release_totals"] = lambda spark, sf: rounded(orders_release(spark, sf, unique_key=True).totals())
SQL["release_totals"] = """SELECT count(*) AS row_count, 5::BIGINT AS column_count, 3.0::DOUBLE AS total_epsilon,
 NULL::DOUBLE AS total_delta, 0.6::DOUBLE AS protection_rate FROM orders"""
