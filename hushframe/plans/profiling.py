"""Loading and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.operators import correlate, profile
from hushframe.plans.common import GAPS, lineitem_with_gaps, r, rounded, table
from hushframe.sources import readers

QUERIES, SQL = {}, {}

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(pieces) -> str:
    return "\nUNION ALL\n".join(pieces)


# --- columns of a loaded table -------------------------------------------

INFO = {
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
               ("event_type", "string"), ("value", "double"), ("props", "string")],
}
CUSTOMER = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
            ("c_acctbal", "double"), ("c_mktsegment", "string")]
PART = [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
        ("p_size", "int"), ("p_retailprice", "double")]


def column_info(spark, sf):
    info = readers.column_info(table(spark, sf, "customer"), [c for c, t in CUSTOMER if t != "double"])
    return info.select(
        "column", "dtype", "rows", "null_count", "unique_count",
        F.array_join("sample_values", ",").alias("sample_values"),
    )


QUERIES["column_info"] = column_info
SQL["column_info"] = _union(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) AS rows, count(*) - count({c}) AS null_count,
  count(DISTINCT {c}) AS unique_count,
  (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM customer ORDER BY v LIMIT 5))
    AS sample_values FROM customer"""
    for c, t in CUSTOMER if t != "double"
)


_DIMENSIONS = {
    "customer": CUSTOMER, "part": PART,
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
}


def column_info_all(spark, sf):
    """Every column of three tables, numbers with fractions too."""
    parts = [readers.column_info(table(spark, sf, t)) for t in _DIMENSIONS]
    info = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return info.withColumn("sample_values", F.array_join("sample_values", ","))


QUERIES["column_info_all"] = column_info_all


def dated_events(spark, sf):
    """events with its times also as text, some of them slashed or broken."""
    stamp = F.col("ts").cast("string")
    slashed = F.date_format("ts", "yyyy/MM/dd")
    return table(spark, sf, "events").select(
        "event_id", "event_type", "value",
        stamp.alias("iso_text"),
        F.when(F.col("event_id") % 10 < 9, slashed).otherwise("unknown").alias("slash_text"),
        F.when(F.col("event_id") % 10 < 5, slashed).otherwise(F.col("event_type")).alias("mixed_text"),
    )


QUERIES["date_parse_rate"] = lambda spark, sf: rounded(
    readers.date_parse_rate(dated_events(spark, sf), ["iso_text", "slash_text", "mixed_text", "event_type"]))
SQL["date_parse_rate"] = """
SELECT 'iso_text' AS "column", count(*) AS values, 1.0::DOUBLE AS parse_rate FROM events
UNION ALL SELECT 'slash_text', count(*), round(avg((event_id % 10 < 9)::INT), 6) FROM events
UNION ALL SELECT 'mixed_text', count(*), round(avg((event_id % 10 < 5)::INT), 6) FROM events
UNION ALL SELECT 'event_type', count(*), 0.0 FROM events"""

QUERIES["column_kinds"] = lambda spark, sf: readers.column_kinds(dated_events(spark, sf)).unionByName(
    readers.column_kinds(table(spark, sf, "part"))).select("column", "kind", "unique_count")


def _kind_sql(source: str, column: str, kind: str) -> str:
    if kind == "number":
        rule = f"""CASE WHEN (count(DISTINCT {column}) / count({column})::DOUBLE < 0.05 AND count(DISTINCT {column}) <= 100
  AND count({column}) >= 20) OR (count(DISTINCT {column}) <= 5 AND count({column}) >= 50)
  THEN 'categorical' ELSE 'numeric' END"""
    else:
        rule = f"'{kind}'"
    return f"""SELECT '{column}' AS "column", {rule} AS kind, count(DISTINCT {column}) AS unique_count FROM {source}"""


_TEXTS = """(SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS iso_text,
 CASE WHEN event_id % 10 < 9 THEN strftime(ts, '%Y/%m/%d') ELSE 'unknown' END AS slash_text,
 CASE WHEN event_id % 10 < 5 THEN strftime(ts, '%Y/%m/%d') ELSE event_type END AS mixed_text FROM events)"""
SQL["column_kinds"] = _union(
    [_kind_sql(_TEXTS, c, k) for c, k in (
        ("event_id", "number"), ("event_type", "categorical"), ("value", "number"), ("iso_text", "date"),
        ("slash_text", "date"), ("mixed_text", "categorical"))]
    + [_kind_sql("part", c, "number" if t in ("bigint", "int", "double") else "categorical") for c, t in PART]
)

# --- numbers ---------------------------------------------------------------

QUERIES["profile_numeric"] = lambda spark, sf: rounded(
    profile.profile_numeric(lineitem_with_gaps(spark, sf), NUMERIC), 6, kurtosis=5, skewness=5, std=5, mean=5)


def _profile_sql(c: str) -> str:
    def q(share):
        return f"quantile_cont({c}, {share})"

    moment = f"(SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM gaps)"
    return f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS null_count,
  {r(f'avg({c})', 5)} AS mean, {r(f'stddev_samp({c})', 5)} AS std, min({c}) AS min, max({c}) AS max,
  {r(q(0.05))} AS p5, {r(q(0.10))} AS p10, {r(q(0.25))} AS q1, {r(q(0.5))} AS median, {r(q(0.75))} AS q3,
  {r(q(0.9))} AS p90, {r(q(0.95))} AS p95, {r(q(0.99))} AS p99, {r(f'{q(0.75)} - {q(0.25)}')} AS iqr,
  (SELECT {r(f'avg(pow(({c} - m) / s, 3))', 5)} FROM gaps, {moment}) AS skewness,
  (SELECT {r(f'avg(pow(({c} - m) / s, 4)) - 3', 5)} FROM gaps, {moment}) AS kurtosis,
  (SELECT count(*) FROM gaps, (SELECT {q(0.25)} AS a, {q(0.75)} AS b FROM gaps)
     WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outlier_count,
  {r(f'{q(0.25)} - 1.5 * ({q(0.75)} - {q(0.25)})')} AS lower_bound,
  {r(f'{q(0.75)} + 1.5 * ({q(0.75)} - {q(0.25)})')} AS upper_bound FROM gaps"""


SQL["profile_numeric"] = f"WITH {GAPS} " + _union(_profile_sql(c) for c in NUMERIC)

QUERIES["outlier_rows"] = lambda spark, sf: profile.outlier_rows(
    table(spark, sf, "events"), "value", ["event_id"], 1.5)
SQL["outlier_rows"] = """SELECT event_id, value FROM events,
 (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
 WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)"""

# --- categories --------------------------------------------------------------

QUERIES["profile_categorical"] = lambda spark, sf: rounded(profile.profile_categorical(
    lineitem_with_gaps(spark, sf), ["l_returnflag", "l_linestatus"]).unionByName(
    profile.profile_categorical(table(spark, sf, "customer"), ["c_name", "c_mktsegment"])))


def _categorical_sql(source: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", sum(n)::BIGINT AS count, (SELECT count(*) - count({c}) FROM {source}) AS null_count,
  count(*) AS cardinality, (SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode,
  max(n) AS mode_count, {r('max(n) / sum(n)')} AS mode_frequency,
  {r('greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0)')} AS entropy, count(*) = sum(n) AS is_unique
  FROM (SELECT {c}, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1)"""


SQL["profile_categorical"] = f"WITH {GAPS} " + _union(
    [_categorical_sql("gaps", c) for c in ("l_returnflag", "l_linestatus")]
    + [_categorical_sql("customer", c) for c in ("c_name", "c_mktsegment")])

QUERIES["top_values"] = lambda spark, sf: profile.top_values(
    table(spark, sf, "part"), ["p_name", "p_brand", "p_type"], 10)
SQL["top_values"] = _union(
    f"""SELECT * FROM (SELECT '{c}' AS "column", row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank,
  {c} AS value, count(*) AS n FROM part GROUP BY {c}) WHERE rank <= 10""" for c in ("p_name", "p_brand", "p_type"))

QUERIES["value_frequencies"] = lambda spark, sf: rounded(profile.value_frequencies(
    table(spark, sf, "part"), ["p_brand", "p_type"], normalize=True))
SQL["value_frequencies"] = _union(
    f"""SELECT '{c}' AS "column", {c} AS value, {r('count(*) / (SELECT count(*) FROM part)')} AS frequency
  FROM part GROUP BY {c}""" for c in ("p_brand", "p_type"))

# --- dates ---------------------------------------------------------------------

QUERIES["profile_dates"] = lambda spark, sf: profile.profile_dates(
    table(spark, sf, "orders"), ["o_orderdate"]).unionByName(
    profile.profile_dates(table(spark, sf, "lineitem"), ["l_shipdate"]))
SQL["profile_dates"] = _union(
    f"""SELECT '{c}' AS "column", sum(n)::BIGINT AS count, (SELECT count(*) - count({c}) FROM {t}) AS null_count,
  min({c}) AS min_date, max({c}) AS max_date, count(*) AS cardinality,
  (SELECT {c} FROM {t} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode, max(n) AS mode_count,
  date_diff('day', min({c}), max({c})) AS range_days
  FROM (SELECT {c}, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)"""
    for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")))

QUERIES["date_distributions"] = lambda spark, sf: profile.date_distributions(
    table(spark, sf, "orders"), ["o_orderdate"])
SQL["date_distributions"] = _union(
    f"""SELECT 'o_orderdate' AS "column", '{part}' AS part, {expr}::INTEGER AS value, count(*) AS n
  FROM orders GROUP BY 3""" for part, expr in (
        ("weekday", "isodow(o_orderdate) - 1"), ("month", "month(o_orderdate)"), ("year", "year(o_orderdate)")))

# --- the whole table -------------------------------------------------------------

QUERIES["missing_summary"] = lambda spark, sf: rounded(profile.missing_summary(lineitem_with_gaps(spark, sf)))
_MISS = "(l_tax IS NULL)::INT + (l_returnflag IS NULL)::INT"
SQL["missing_summary"] = f"""WITH {GAPS} SELECT count(*) * 11 AS total_cells, sum({_MISS})::BIGINT AS total_missing,
  {r(f'sum({_MISS}) * 100.0 / (count(*) * 11)')} AS missing_percentage, 2::BIGINT AS columns_with_missing,
  count(*) FILTER ({_MISS} > 0) AS rows_with_missing, count(*) FILTER ({_MISS} = 0) AS complete_rows FROM gaps"""

QUERIES["missing_by_column"] = lambda spark, sf: rounded(profile.missing_by_column(
    lineitem_with_gaps(spark, sf), ["l_tax", "l_returnflag", "l_quantity"]))
SQL["missing_by_column"] = f"WITH {GAPS} " + _union(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
  {r(f'(count(*) - count({c})) * 100.0 / count(*)')} AS percentage FROM gaps""" for c in ("l_tax", "l_returnflag", "l_quantity"))

QUERIES["duplicate_rows"] = lambda spark, sf: profile.duplicate_rows(
    lineitem_with_gaps(spark, sf).select("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag"))
SQL["duplicate_rows"] = f"""WITH {GAPS} SELECT sum(n)::BIGINT AS row_count, sum(n - 1)::BIGINT AS duplicate_rows FROM
  (SELECT count(*) AS n FROM gaps GROUP BY l_linenumber, l_quantity, l_discount, l_tax, l_returnflag)"""

QUERIES["profile_dataset"] = lambda spark, sf: rounded(profile.profile_dataset(lineitem_with_gaps(spark, sf)))
SQL["profile_dataset"] = f"""WITH {GAPS} SELECT count(*) AS row_count, 11::BIGINT AS column_count,
  8::BIGINT AS numeric_columns, 2::BIGINT AS categorical_columns, 1::BIGINT AS date_columns,
  sum({_MISS})::BIGINT AS total_missing, {r(f'1 - sum({_MISS}) / (count(*) * 11.0)')} AS completeness,
  sum({_MISS}) > 0 AS has_missing,
  (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM gaps GROUP BY ALL
     HAVING true) ) AS duplicate_rows FROM gaps""".replace(
    "SELECT count(*) AS n FROM gaps GROUP BY ALL\n     HAVING true",
    "SELECT count(*) AS n FROM gaps g GROUP BY " + ", ".join(
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
         "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]))

def _dataset_correlations(spark, sf):
    """The dataset profile by rank correlation, its pairs as rows."""
    found = profile.profile_dataset(lineitem_with_gaps(spark, sf), ["l_quantity", "l_discount", "l_tax", "l_returnflag"], "spearman")
    return rounded(found.select("row_count", "column_count", "numeric_columns", F.inline("correlations")))


QUERIES["profile_dataset_correlations"] = _dataset_correlations

QUERIES["profile_columns"] = lambda spark, sf: profile.profile_columns(
    table(spark, sf, "orders"), ["o_orderdate", "o_orderstatus", "o_totalprice"]
).where("statistic in ('count', 'null_count', 'cardinality', 'mode', 'is_unique', 'range_days', 'outlier_count')")
SQL["profile_columns"] = """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders),
out AS (SELECT count(*) AS n FROM orders, q WHERE o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a))
SELECT "column", kind, statistic, value FROM (
SELECT 'o_totalprice' AS "column", 'numeric' AS kind, unnest(['count', 'null_count', 'outlier_count']) AS statistic,
  unnest([count(o_totalprice)::VARCHAR, (count(*) - count(o_totalprice))::VARCHAR, (SELECT n FROM out)::VARCHAR]) AS value FROM orders
UNION ALL SELECT 'o_orderstatus', 'categorical', unnest(['count', 'null_count', 'cardinality', 'mode', 'is_unique']),
  unnest([count(o_orderstatus)::VARCHAR, '0', count(DISTINCT o_orderstatus)::VARCHAR,
   (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), 'false']) FROM orders
UNION ALL SELECT 'o_orderdate', 'date', unnest(['count', 'null_count', 'cardinality', 'mode', 'range_days']),
  unnest([count(o_orderdate)::VARCHAR, '0', count(DISTINCT o_orderdate)::VARCHAR,
   (SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') FROM orders GROUP BY o_orderdate ORDER BY count(*) DESC, o_orderdate LIMIT 1),
   date_diff('day', min(o_orderdate), max(o_orderdate))::VARCHAR]) FROM orders)"""

def profile_columns_all(spark, sf):
    """Every statistic of every column of orders: numbers as numbers, the rest as text."""
    found = profile.profile_columns(table(spark, sf, "orders"))
    number = F.col("value").try_cast("double")
    return found.select("column", "kind", "statistic", (F.round(number, 4) + F.lit(0.0)).alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))


QUERIES["profile_columns_all"] = profile_columns_all


def _stat_rows(column: str, kind: str, numbers: dict[str, str], texts: dict[str, str]) -> str:
    names = ", ".join(f"'{n}'" for n in [*numbers, *texts])
    values = ", ".join([*[r(e, 4) for e in numbers.values()], *["NULL" for _ in texts]])
    words = ", ".join([*["NULL" for _ in numbers], *texts.values()])
    return f"""SELECT '{column}' AS "column", '{kind}' AS kind, unnest([{names}]) AS statistic, unnest([{values}]) AS number, unnest([{words}]) AS text FROM orders"""


def _numeric_stats(c: str) -> str:
    q = {n: f"quantile_cont({c}, {p})" for n, p in profile.PERCENTILES.items()}
    low, high = (f"(SELECT {q['q1' if side < 0 else 'q3']} {'-' if side < 0 else '+'} 1.5 * ({q['q3']} - {q['q1']}) FROM orders)" for side in (-1, 1))
    power = lambda k: f"(SELECT avg(pow(({c} - m) / s, {k})) FROM orders, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM orders))"
    return _stat_rows(c, "numeric", {
        "count": f"count({c})", "null_count": f"count(*) - count({c})", "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "max": f"max({c})",
        **q, "iqr": f"{q['q3']} - {q['q1']}", "skewness": power(3), "kurtosis": f"{power(4)} - 3",
        "outlier_count": f"(SELECT count(*) FROM orders WHERE {c} < {low} OR {c} > {high})", "lower_bound": low, "upper_bound": high,
    }, {})


def _text_stats(c: str) -> str:
    mode = f"(SELECT {{}} FROM (SELECT {c} AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"
    return _stat_rows(c, "categorical", {
        "count": f"count({c})", "null_count": f"count(*) - count({c})", "cardinality": f"count(DISTINCT {c})", "mode_count": mode.format("n"),
        "mode_frequency": f"{mode.format('n')} / count({c})",
        "entropy": f"(SELECT -sum(n / t * log2(n / t)) FROM (SELECT count(*) AS n, (SELECT count({c})::DOUBLE FROM orders) AS t FROM orders WHERE {c} IS NOT NULL GROUP BY {c}))",
    }, {"mode": mode.format("v"), "is_unique": f"CASE WHEN count(DISTINCT {c}) = count({c}) THEN 'true' ELSE 'false' END"})


def _date_stats(c: str) -> str:
    mode = f"(SELECT {{}} FROM (SELECT {c} AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"
    shown = lambda e: f"strftime({e}, '%Y-%m-%d %H:%M:%S')"
    return _stat_rows(c, "date", {
        "count": f"count({c})", "null_count": f"count(*) - count({c})", "cardinality": f"count(DISTINCT {c})", "mode_count": mode.format("n"),
        "range_days": f"date_diff('day', min({c}), max({c}))",
    }, {"min_date": shown(f"min({c})"), "max_date": shown(f"max({c})"), "mode": mode.format(shown("v"))})


SQL["profile_columns_all"] = _union([
    *[_numeric_stats(c) for c in ("o_orderkey", "o_custkey", "o_totalprice")], *[_text_stats(c) for c in ("o_orderstatus", "o_orderpriority")], _date_stats("o_orderdate")])
SQL["column_info_all"] = _union(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) AS rows, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count,
  (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM {name} ORDER BY v LIMIT 5)) AS sample_values FROM {name}"""
    for name, fields in _DIMENSIONS.items() for c, t in fields)

QUERIES["fingerprint_same_rows"] = lambda spark, sf: _same_rows(table(spark, sf, "customer"))
SQL["fingerprint_same_rows"] = "SELECT count(*) AS rows, true AS reordered_equal, false AS changed_equal FROM customer"


def _same_rows(df):
    first = profile.fingerprint(df).scalar()
    shuffled = profile.fingerprint(df.repartition(7, "c_name")).scalar()
    changed = profile.fingerprint(df.withColumn("c_nationkey", F.col("c_nationkey") + 1)).scalar()
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", (first == shuffled).alias("reordered_equal"), (first == changed).alias("changed_equal"))


# --- correlations ------------------------------------------------------------------

def _pairs(columns):
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]


QUERIES["corr_pearson"] = lambda spark, sf: rounded(correlate.correlation_matrix(
    lineitem_with_gaps(spark, sf), CORRELATED))
SQL["corr_pearson"] = f"WITH {GAPS} " + _union(
    [f"""SELECT '{a}' AS column1, '{b}' AS column2, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n,
  {r(f'corr({a}, {b})')} AS correlation FROM gaps""" for x, y in _pairs(CORRELATED) for a, b in ((x, y), (y, x))]
    + [f"SELECT '{c}', '{c}', count({c}), 1.0::DOUBLE FROM gaps" for c in CORRELATED])

QUERIES["corr_pearson_wide"] = lambda spark, sf: rounded(correlate.pearson(
    lineitem_with_gaps(spark, sf), CORRELATED))
SQL["corr_pearson_wide"] = f"WITH {GAPS} " + _union(
    f"""SELECT '{a}' AS column1, '{b}' AS column2, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n,
  {r(f'corr({a}, {b})')} AS correlation FROM gaps""" for a, b in _pairs(CORRELATED))


def _rank(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


QUERIES["corr_spearman"] = lambda spark, sf: rounded(correlate.correlation_pairs(
    lineitem_with_gaps(spark, sf), ["l_quantity", "l_extendedprice", "l_tax"], "spearman"))
SQL["corr_spearman"] = f"WITH {GAPS} " + _union(
    f"""SELECT '{a}' AS column1, '{b}' AS column2, count(*) AS n, {r('corr(x, y)')} AS correlation FROM
  (SELECT {_rank(a)} AS x, {_rank(b)} AS y FROM gaps WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
    for a, b in _pairs(["l_quantity", "l_extendedprice", "l_tax"]))

_DATASET = ["l_quantity", "l_discount", "l_tax"]
SQL["profile_dataset_correlations"] = f"WITH {GAPS} " + _union(
    f"""SELECT (SELECT count(*) FROM gaps) AS row_count, 4::BIGINT AS column_count, 3::BIGINT AS numeric_columns, '{min(a, b)}' AS column1, '{max(a, b)}' AS column2,
  count(*) AS n, {r('corr(x, y)')} AS correlation FROM
  (SELECT {_rank(a)} AS x, {_rank(b)} AS y FROM gaps WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
    for a, b in _pairs(_DATASET)).replace("'l_discount' AS column1, 'l_quantity' AS column2", "'l_quantity' AS column1, 'l_discount' AS column2")

# twenty columns, each a number of its own: one rank per column serves all 190 pairs
WIDE = {f"m{k}": f"(l_{c} * {k + 3} % {m})" for k, (c, m) in enumerate([
    ("orderkey", 101), ("partkey", 97), ("suppkey", 31), ("linenumber", 5), ("orderkey", 1009), ("partkey", 13), ("suppkey", 7), ("orderkey", 17),
    ("partkey", 499), ("suppkey", 61), ("orderkey", 53), ("partkey", 251)])}
_PLAIN = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def wide_lines(spark, sf):
    return table(spark, sf, "lineitem").select(*_PLAIN, *[F.expr(e).alias(c) for c, e in WIDE.items()])


QUERIES["corr_spearman_wide"] = lambda spark, sf: rounded(correlate.spearman(wide_lines(spark, sf), [*_PLAIN, *WIDE]))
SQL["corr_spearman_wide"] = f"""WITH wide AS (SELECT {', '.join(_PLAIN)}, {', '.join(f'{e} AS {c}' for c, e in WIDE.items())} FROM lineitem),
ranks AS (SELECT {', '.join(f'{_rank(c)} AS {c}' for c in [*_PLAIN, *WIDE])} FROM wide),
one AS (SELECT count(*) AS n, {', '.join(f'corr({a}, {b}) AS {a}__{b}' for a, b in _pairs([*_PLAIN, *WIDE]))} FROM ranks)
""" + _union(f"SELECT '{a}' AS column1, '{b}' AS column2, n, {r(f'{a}__{b}')} AS correlation FROM one" for a, b in _pairs([*_PLAIN, *WIDE]))

QUERIES["corr_kendall"] = lambda spark, sf: rounded(correlate.correlation_pairs(
    lineitem_with_gaps(spark, sf), ["l_quantity", "l_discount", "l_tax"], "kendall"))
SQL["corr_kendall"] = f"WITH {GAPS} " + _union(
    f"""SELECT '{a}' AS column1, '{b}' AS column2, max(n)::BIGINT AS n, {r('max(s) / (sqrt(max(n) * (max(n) - 1) / 2 - max(tx)) * sqrt(max(n) * (max(n) - 1) / 2 - max(ty)))')} AS correlation
  FROM (SELECT (SELECT sum(p.w::DOUBLE * q.w * sign(p.y - q.y)) FROM c_{a}_{b} p JOIN c_{a}_{b} q ON p.x > q.x) AS s,
   (SELECT sum(w)::DOUBLE FROM c_{a}_{b}) AS n,
   (SELECT sum(t * (t - 1) / 2.0) FROM (SELECT sum(w)::DOUBLE AS t FROM c_{a}_{b} GROUP BY x)) AS tx,
   (SELECT sum(t * (t - 1) / 2.0) FROM (SELECT sum(w)::DOUBLE AS t FROM c_{a}_{b} GROUP BY y)) AS ty)"""
    for a, b in _pairs(["l_quantity", "l_discount", "l_tax"]))
SQL["corr_kendall"] = SQL["corr_kendall"].replace(
    f"WITH {GAPS} ", f"WITH {GAPS}, " + ", ".join(
        f"c_{a}_{b} AS (SELECT {a} AS x, {b} AS y, count(*) AS w FROM gaps WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)"
        for a, b in _pairs(["l_quantity", "l_discount", "l_tax"])) + " ", 1)

QUERIES["high_correlations"] = lambda spark, sf: rounded(correlate.high_correlations(
    correlate.correlation_pairs(table(spark, sf, "lineitem"), CORRELATED), 0.001))
SQL["high_correlations"] = "SELECT * FROM (" + _union(
    f"""SELECT '{a}' AS column1, '{b}' AS column2, count(*) AS n, {r(f'corr({a}, {b})')} AS correlation FROM lineitem"""
    for a, b in _pairs(CORRELATED)) + ") WHERE abs(correlation) >= 0.001"
