"""Inputs and SQL fragments the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hushframe.operators.protect import EXCLUDE, PASSTHROUGH, ColumnRule, Release, protect

SECRET = "demo-secret"
RELEASE = "orders-1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded for the comparison with another engine."""
    out = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind == "double":
            # + 0.0 turns a negative zero into zero
            column = F.round(column, special.get(name, digits)) + F.lit(0.0)
        out.append(column.alias(name))
    return df.select(*out)


def r(expression: str, digits: int = 6) -> str:
    return f"(round(({expression})::DOUBLE, {digits}) + 0.0)"


def lineitem_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem where one tax and one flag value went missing."""
    return table(spark, sf_dir, "lineitem").withColumns({
        "l_tax": F.when(F.col("l_linenumber") != 7, F.col("l_tax")),
        "l_returnflag": F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")),
    })


GAPS = """gaps AS (SELECT * REPLACE (
  CASE WHEN l_linenumber <> 7 THEN l_tax END AS l_tax,
  CASE WHEN l_linenumber <> 3 THEN l_returnflag END AS l_returnflag) FROM lineitem)"""


def sql_uniform(column: str, key: str, draw: int = 0, release: str = RELEASE) -> str:
    """The keyed uniform in SQL; ``key`` is a list of SQL expressions."""
    parts = ", ".join(f"'{len(part)}:{part}'" for part in (SECRET, release, column))
    text = f"concat_ws('|', {parts}, {key})"
    return f"((('0x' || substr(sha256({text}), {1 + 13 * draw}, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"


def sql_laplace(scale: str, u: str) -> str:
    return f"(-({scale}) * sign({u} - 0.5) * ln(1 - 2 * abs({u} - 0.5)))"


def sql_gaussian(sigma: str, u1: str, u2: str) -> str:
    return f"(({sigma}) * sqrt(-2 * ln({u1})) * cos(2 * pi() * {u2}))"


PRICE_BOUNDS = (0.0, 500000.0)
DATE_BOUNDS = ("1992-01-01", "2002-12-31")


def orders_rules() -> dict[str, ColumnRule]:
    return {
        "o_orderkey": ColumnRule(PASSTHROUGH),
        "o_orderstatus": ColumnRule(PASSTHROUGH),
        "o_custkey": ColumnRule(EXCLUDE),
        "o_totalprice": ColumnRule(epsilon=1.0, lower=PRICE_BOUNDS[0], upper=PRICE_BOUNDS[1]),
        "o_orderdate": ColumnRule(epsilon=1.0, lower=DATE_BOUNDS[0], upper=DATE_BOUNDS[1]),
        # counts are in the thousands: a wide score sensitivity keeps the law
        # from collapsing to the most frequent priority
        "o_orderpriority": ColumnRule(epsilon=1.0, score_sensitivity=50.0),
    }


def orders_release(spark: SparkSession, sf_dir: str, **options) -> Release:
    return protect(
        table(spark, sf_dir, "orders"), orders_rules(), key=["o_orderkey"], secret=SECRET,
        release=RELEASE, **options,
    )


def orders_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders beside their release, unprotected columns left out."""
    paired = orders_release(spark, sf_dir, keep_original=True, unique_key=True).data
    kept = ["o_totalprice", "o_orderdate", "o_orderpriority"]
    return paired.select(
        "o_orderkey",
        *[F.struct(*[F.col(side)[c].alias(c) for c in kept]).alias(side) for side in ("orig", "prot")],
    )


_U = {c: sql_uniform(c, "o_orderkey") for c in ("o_totalprice", "o_orderdate", "o_orderpriority")}
_DAYS = f"(DATE '{DATE_BOUNDS[1]}' - DATE '{DATE_BOUNDS[0]}')"
_LOW_DAY = f"(DATE '{DATE_BOUNDS[0]}' - DATE '1970-01-01')"
_HIGH_DAY = f"(DATE '{DATE_BOUNDS[1]}' - DATE '1970-01-01')"


def sql_category_law(source: str, column: str, rate: str, name: str = "law") -> str:
    """CTEs: the category law of a column with cumulative borders."""
    return f"""{name}_counts AS (SELECT {column} AS cat, count(*) AS n FROM {source}
  WHERE {column} IS NOT NULL GROUP BY 1),
{name}_weights AS (SELECT cat, n, exp((n - max(n) OVER ()) * ({rate})) AS w FROM {name}_counts),
{name} AS (SELECT cat, n, sum(w) OVER (ORDER BY n DESC, cat) / sum(w) OVER () AS hi,
  (sum(w) OVER (ORDER BY n DESC, cat) - w) / sum(w) OVER () AS lo,
  row_number() OVER (ORDER BY n DESC, cat) AS place, count(*) OVER () AS k FROM {name}_weights)"""


# The orders release in SQL: o = original, p = protected.
RELEASED = f"""{sql_category_law('orders', 'o_orderpriority', '1.0 / (2 * 50.0)')},
drawn AS (SELECT o.*, {_U['o_orderpriority']} AS u FROM orders o),
released AS (SELECT d.o_orderkey, d.o_custkey, d.o_orderstatus,
  d.o_totalprice AS price_o,
  least(greatest(d.o_totalprice, 0.0), 500000.0) + {sql_laplace('500000.0', _U['o_totalprice'])} AS price_p,
  d.o_orderdate AS date_o,
  (DATE '1970-01-01' + least(greatest(round_even(
    least(greatest((d.o_orderdate::DATE - DATE '1970-01-01'), {_LOW_DAY}), {_HIGH_DAY})
    + {sql_laplace(_DAYS, _U['o_orderdate'])}, 0), -719162), 2932896)::INTEGER)::TIMESTAMP AS date_p,
  d.o_orderpriority AS prio_o, law.cat AS prio_p
  FROM drawn d JOIN law ON (d.u >= law.lo OR law.place = 1) AND (d.u < law.hi OR law.place = law.k))"""
