"""Round trips through files, with and without metadata."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hushframe.operators.profile import profile_categorical
from hushframe.operators.protect import protect
from hushframe.plans.common import GAPS, RELEASE, RELEASED, SECRET, lineitem_with_gaps, orders_release, orders_rules, r, rounded, table
from hushframe.session import scratch_folder
from hushframe.sources import partials, readers, writers
from hushframe.sources.profiles import saved_profile
from hushframe.sources.releases import compare_release

QUERIES, SQL = {}, {}


def _path(spark, extension: str) -> str:
    return f"{scratch_folder(spark)}/export-{uuid.uuid4().hex}.{extension}"


def csv_round_trip(spark, sf):
    customer = table(spark, sf, "customer")
    path = _path(spark, "csv")
    writers.export(customer, path)
    return readers.load(spark, path, schema=customer.schema).data


QUERIES["csv_round_trip"] = csv_round_trip
SQL["csv_round_trip"] = "SELECT * FROM customer"


def csv_text_round_trip(spark, sf):
    """Documents with line breaks and quotes, written and read back: how many
    rows there are, and how many differ from the ones written."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit(' "a ""b"", c" '), "text", F.lit("\n;, ")).alias("text"), "lang")
    path = _path(spark, "csv")
    done = writers.export(docs, path)
    back = readers.load(spark, path, schema=docs.schema).data
    lost = docs.exceptAll(back).agg(F.count(F.lit(1)).alias("n")).scalar()
    return back.agg(F.count(F.lit(1)).alias("rows")).select("rows", lost.alias("lost"), F.lit(done.row_count).cast("bigint").alias("reported"))


QUERIES["csv_text_round_trip"] = csv_text_round_trip
SQL["csv_text_round_trip"] = "SELECT count(*) AS rows, 0::BIGINT AS lost, count(*) AS reported FROM documents"


def parquet_round_trip(spark, sf):
    release = orders_release(spark, sf, unique_key=True)
    path = _path(spark, "parquet")
    writers.export(release.data, path, release)
    return rounded(readers.load(spark, path).data, 3)


QUERIES["parquet_round_trip"] = parquet_round_trip
SQL["parquet_round_trip"] = f"""WITH {RELEASED} SELECT {r('price_p', 3)} AS o_totalprice, date_p AS o_orderdate,
 prio_p AS o_orderpriority, o_orderkey, o_orderstatus FROM released"""


def metadata_read_back(spark, sf):
    """Footer of a Parquet export and sidecar of a CSV export, side by side."""
    release = orders_release(spark, sf, unique_key=True)
    rows = None
    for extension in ("parquet", "csv"):
        path = _path(spark, extension)
        writers.export(release.data, path, release)
        found = writers.read_metadata(spark, path)
        columns = F.map_entries("column_metadata")
        flat = found.select(
            "format", "version", "source_row_count", "source_column_count", "exported_column_count",
            "total_epsilon", "total_delta", F.array_join("protected_columns", ",").alias("protected_columns"),
            F.array_join("excluded_columns", ",").alias("excluded_columns"), F.explode(columns).alias("c"),
        ).select(
            "*", F.col("c.key").alias("column"), F.col("c.value")["mode"].alias("mode"),
            F.col("c.value")["mechanism"].alias("mechanism"),
            F.col("c.value")["epsilon"].cast("double").alias("epsilon"),
            F.col("c.value")["null_count"].cast("bigint").alias("null_count"),
        ).drop("c")
        rows = flat if rows is None else rows.unionByName(flat)
    return rows


QUERIES["metadata_read_back"] = metadata_read_back
SQL["metadata_read_back"] = """SELECT f.format, '1.0' AS version, n AS source_row_count, 6::BIGINT AS source_column_count, 5::BIGINT AS exported_column_count,
 3.0::DOUBLE AS total_epsilon, NULL::DOUBLE AS total_delta, 'o_totalprice,o_orderdate,o_orderpriority' AS protected_columns, 'o_custkey' AS excluded_columns, c.*,
 CASE WHEN c."column" <> 'o_custkey' THEN missing ELSE 0 END AS null_count
FROM (VALUES ('parquet'), ('csv')) f(format), (SELECT count(*) AS n, count(*) - count(o_totalprice) AS missing FROM orders),
 (VALUES ('o_orderkey', 'passthrough', NULL, NULL), ('o_custkey', 'exclude', NULL, NULL), ('o_orderstatus', 'passthrough', NULL, NULL),
 ('o_totalprice', 'protect', 'laplace', 1.0::DOUBLE), ('o_orderdate', 'protect', 'laplace', 1.0::DOUBLE),
 ('o_orderpriority', 'protect', 'exponential', 1.0::DOUBLE)) c("column", mode, mechanism, epsilon)"""


def metadata_properties(spark, sf):
    customer = table(spark, sf, "customer")
    path = _path(spark, "csv")
    writers.export(customer, path)
    return writers.metadata_properties(writers.read_metadata(spark, path)).where("property <> 'Export Timestamp'")


QUERIES["metadata_properties"] = metadata_properties
SQL["metadata_properties"] = """SELECT unnest(['Source Row Count', 'Source Column Count', 'Exported Column Count', 'Total Epsilon', 'Total Delta',
 'Protected Columns', 'Passthrough Columns', 'Excluded Columns', 'Format', 'Version']) AS property,
 unnest([count(*)::VARCHAR, '5', '5', '0.0', 'N/A', 'None', 'c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment', 'None', 'csv', '1.0']) AS value FROM customer"""


def export_result(spark, sf):
    customer = table(spark, sf, "customer")
    done = writers.export(customer, _path(spark, "parquet"))
    return spark.createDataFrame(
        [(done.format, done.row_count, done.column_count, done.file_bytes > 0, done.metadata_path is None)],
        "format string, row_count bigint, column_count bigint, has_bytes boolean, no_sidecar boolean")


QUERIES["export_result"] = export_result
SQL["export_result"] = "SELECT 'parquet' AS format, count(*) AS row_count, 5::BIGINT AS column_count, true AS has_bytes, true AS no_sidecar FROM customer"


def dataset_info(spark, sf):
    loaded = readers.load(spark, f"{sf}/orders.parquet")
    return readers.dataset_info(loaded).select("format", "encoding", "row_count", "column_count")


QUERIES["dataset_info"] = dataset_info
SQL["dataset_info"] = "SELECT 'parquet' AS format, NULL::VARCHAR AS encoding, count(*) AS row_count, 6::BIGINT AS column_count FROM orders"


def encoding_fallback(spark, sf):
    """Names with an accent written as ISO-8859-1 and as UTF-8, then loaded
    without saying which."""
    customer = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" José")).alias("c_name"))
    parts = []
    for encoding in ("ISO-8859-1", "UTF-8"):
        path = _path(spark, "csv")
        writers.export(customer, path, encoding=encoding, include_metadata=False)
        loaded = readers.load(spark, path, schema=customer.schema)
        parts.append(loaded.data.withColumn("encoding", F.lit(loaded.encoding)))
    return parts[0].unionByName(parts[1])


QUERIES["encoding_fallback"] = encoding_fallback
SQL["encoding_fallback"] = """SELECT c_custkey, c_name || ' José' AS c_name, e AS encoding FROM customer, (VALUES ('ISO-8859-1'), ('UTF-8')) t(e)"""


def reused_profile(spark, sf):
    """A saved profile met again by the same rows in another order, and not by
    changed ones."""
    customer = table(spark, sf, "customer").select("c_name", "c_mktsegment")
    folder = f"{scratch_folder(spark)}/profiles-{uuid.uuid4().hex}"
    build = lambda df: profile_categorical(df, ["c_mktsegment"]).withColumn("built", F.expr("uuid()"))
    first, again, other = (
        saved_profile(df, folder, build).select("column", "count", "cardinality", F.col("built"))
        for df in (customer, customer.repartition(5), customer.withColumn("c_name", F.lower("c_name")))
    )
    marks = {"same_content": again, "other_content": other}
    result = first
    for name, df in marks.items():
        result = result.join(df.select("column", F.col("built").alias(f"_{name}")), "column").withColumn(
            f"{name}_reused", F.col("built") == F.col(f"_{name}")).drop(f"_{name}")
    return result.drop("built")


QUERIES["profile_reuse"] = reused_profile
SQL["profile_reuse"] = """SELECT 'c_mktsegment' AS "column", count(*) AS count, count(DISTINCT c_mktsegment) AS cardinality,
 true AS same_content_reused, false AS other_content_reused FROM customer"""


def compare_exported(spark, sf):
    """The orders release, exported both ways and compared by its own metadata."""
    orders, release = table(spark, sf, "orders"), orders_release(spark, sf, unique_key=True)
    rows = None
    for extension in ("parquet", "csv"):
        path = _path(spark, extension)
        writers.export(release.data, path, release)
        found = compare_release(spark, orders, path, ["o_orderkey"]).withColumn("format", F.lit(extension))
        rows = found if rows is None else rows.unionByName(found)
    return rounded(rows, 3)


QUERIES["compare_release"] = compare_exported
_DAY_GAP = "(date_p::DATE - date_o::DATE)"
SQL["compare_release"] = f"""WITH {RELEASED} SELECT f.format, c.* FROM (VALUES ('parquet'), ('csv')) f(format),
 (SELECT 'o_totalprice' AS "column", 'numeric' AS kind, count(*) AS count, 0::BIGINT AS null_count,
  {r('avg(abs(price_p - price_o))', 3)} AS mae, {r('sqrt(avg(pow(price_p - price_o, 2)))', 3)} AS rmse, {r('max(abs(price_p - price_o))', 3)} AS max_error, NULL::DOUBLE AS drift FROM released
 UNION ALL SELECT 'o_orderpriority', 'categorical', count(*), 0, NULL, NULL, NULL, {r('avg((prio_o <> prio_p)::INT)', 3)} FROM released
 UNION ALL SELECT 'o_orderdate', 'date', count(*), 0, {r(f'avg(abs({_DAY_GAP}))', 3)}, {r(f'sqrt(avg({_DAY_GAP} * {_DAY_GAP}))', 3)}, {r(f'max(abs({_DAY_GAP}))', 3)}, NULL FROM released) c"""


def compare_exported_empty(spark, sf):
    """A release of orders whose totals are all missing."""
    none = table(spark, sf, "orders").withColumn("o_totalprice", F.lit(None).cast("double"))
    release = protect(none, orders_rules(), ["o_orderkey"], SECRET, RELEASE, unique_key=True)
    path = _path(spark, "parquet")
    writers.export(release.data, path, release)
    return compare_release(spark, none, path, ["o_orderkey"]).where("kind <> 'date'").select("column", "kind", "count", "null_count", "mae", "rmse", "max_error")


QUERIES["compare_release_empty"] = compare_exported_empty
SQL["compare_release_empty"] = """SELECT 'o_totalprice' AS "column", 'numeric' AS kind, 0::BIGINT AS count, count(*) AS null_count, 0.0::DOUBLE AS mae, 0.0::DOUBLE AS rmse, 0.0::DOUBLE AS max_error FROM orders
UNION ALL SELECT 'o_orderpriority', 'categorical', count(*), 0, NULL, NULL, NULL FROM orders"""


#: Rows of a file of the growing table, about: what one task writes does not grow with the table.
ROWS_PER_FILE = 2_000_000
_LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _growing(spark, sf):
    """lineitem as a table of two files, profiled, then of three, of more where three would
    hold over ROWS_PER_FILE rows each: (partials of all, files read again).

    Every line is in one file. The last file is appended after the first update, so the
    second one reads that file alone."""
    lines = lineitem_with_gaps(spark, sf)
    base = f"{scratch_folder(spark)}/growing-{uuid.uuid4().hex}"
    path, folder = f"{base}/table", f"{base}/partials"
    files = max(3, -(-lines.count() // ROWS_PER_FILE))
    last = F.pmod(F.xxhash64(*_LINE_KEY), F.lit(files)) == files - 1
    # other keys than the ones that deal the last file: the hashes of one list would go together
    lines.where(~last).repartition(files - 1, "l_partkey", "l_orderkey", "l_linenumber").write.parquet(path)
    partials.update(spark, path, folder)
    lines.where(last).repartition(1).write.mode("append").parquet(path)
    return partials.update(spark, path, folder)


def growing_numbers(spark, sf):
    merged, read = _growing(spark, sf)
    return rounded(partials.numbers(merged).withColumn("files_read", F.lit(read)), 5)


QUERIES["profile_growing"] = growing_numbers
_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SQL["profile_growing"] = f"WITH {GAPS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS null_count, {r(f'avg({c})', 5)} AS mean, {r(f'stddev_samp({c})', 5)} AS std,
 {r(f'min({c})', 5)} AS min, {r(f'max({c})', 5)} AS max, {r(f"avg(pow(({c} - m_{c}) / s_{c}, 3))", 5)} AS skewness, {r(f"avg(pow(({c} - m_{c}) / s_{c}, 4)) - 3", 5)} AS kurtosis,
 1::INTEGER AS files_read FROM gaps, (SELECT avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c} FROM gaps)""" for c in _NUMBERS)


def growing_rest(spark, sf):
    """Correlations, categories and dates of the grown table."""
    merged, _ = _growing(spark, sf)
    text = "struct<name:string,other:string,n:bigint,x:double,mode:string>"
    pairs = partials.correlations(merged).select(F.struct("column1", "column2", "n", "correlation", F.lit(None).cast("string")).cast(text).alias("r"))
    labels = partials.categories(merged).select(F.struct("column", F.lit("categories"), "cardinality", "entropy", "mode").cast(text).alias("r"))
    days = partials.dates(merged).select(F.struct("column", F.lit("days"), "count", F.date_diff("max_date", "min_date"), F.lit(None).cast("string")).cast(text).alias("r"))
    return rounded(pairs.unionByName(labels).unionByName(days).select("r.*"), 6)


QUERIES["profile_growing_pairs"] = growing_rest
SQL["profile_growing_pairs"] = f"WITH {GAPS} " + " UNION ALL ".join(
    [f"""SELECT '{a}' AS name, '{b}' AS other, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, {r(f'corr({a}, {b})')} AS x, NULL::VARCHAR AS mode FROM gaps"""
     for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1:]]
    + [f"""SELECT '{c}', 'categories', count(DISTINCT {c}), (SELECT {r('-sum(n / t * log2(n / t))')} FROM (SELECT count(*) AS n, (SELECT count({c}) FROM gaps)::DOUBLE AS t FROM gaps WHERE {c} IS NOT NULL GROUP BY {c})),
 (SELECT {c} FROM gaps WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) FROM gaps""" for c in ("l_returnflag", "l_linestatus")]
    + ["SELECT 'l_shipdate', 'days', count(l_shipdate), date_diff('day', min(l_shipdate), max(l_shipdate))::DOUBLE, NULL FROM gaps"])
