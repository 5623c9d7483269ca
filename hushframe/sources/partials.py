"""Profiles of growing tables from partial results kept per file.

Every data file of a table is summed up once: moments and extremes of numbers,
co-moments of their pairs, value counts of texts, days of dates. A file is known by path,
length and modification time, so an appended file is read alone and a removed or rewritten one
drops out. What is merged is exact; order statistics need the rows themselves and are
not part of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hushframe.operators.profile import date_columns, numeric_columns, text_columns
from hushframe.operators.protect import present
from hushframe.sources.writers import path_exists

#: One row per (file, kind, column pair or value); ``a`` to ``f`` are what the kind sums.
SCHEMA = (
    "file string, length bigint, modified timestamp, kind string, column1 string, column2 string, value string, "
    "n bigint, nulls bigint, a double, b double, c double, d double, e double, f double, low string, high string"
)
NUMBER, PAIR, TEXT, DATE, FILE = "number", "pair", "text", "date", "file"
FILES_AT_ONCE = 1000


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, modified) of the Parquet files of a table; contents are not read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return listing.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))


def _as_listed(path: Column, encoded: bool = True) -> Column:
    """A path as the lister spells it: readers escape signs, and both differ in leading slashes."""
    plain = F.url_decode(F.regexp_replace(path, r"\+", "%2B")) if encoded else path
    return F.regexp_replace(plain, "^file:/+", "/")


def _row(kind: str, **values: Column) -> Column:
    names = [part.split() for part in SCHEMA.split(", ")][3:]
    given = {"kind": F.lit(kind), **values}
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])


def _sums(df: DataFrame) -> DataFrame:
    """The partial rows of each file of ``df`` (a table with ``_file``)."""
    numbers, texts, dates = numeric_columns(df), [c for c in text_columns(df) if c != "_file"], date_columns(df)
    values = {c: present(df, c).cast("double") for c in numbers}
    sums = [F.count(F.lit(1)).alias("_rows")]
    cells = [_row(FILE, n=F.col("_rows"))]
    for i, c in enumerate(numbers):
        v = values[c]
        constant = F.min(v) == F.max(v)
        sums += [
            F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.when(constant, 0.0).otherwise(F.var_pop(v)).alias(f"v{i}"),
            F.when(constant, 0.0).otherwise(F.skewness(v)).alias(f"s{i}"), F.when(constant, 0.0).otherwise(F.kurtosis(v) + 3).alias(f"k{i}"),
            F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"),
        ]
        n, var = F.col(f"n{i}"), F.col(f"v{i}")
        cells.append(_row(
            NUMBER, column1=F.lit(c), n=n, nulls=F.col("_rows") - n, a=F.col(f"a{i}"), b=var * n,
            c=F.col(f"s{i}") * F.pow(var, 1.5) * n, d=F.col(f"k{i}") * var * var * n, e=F.col(f"l{i}"), f=F.col(f"h{i}"),
        ))
    for k, (c1, c2) in enumerate(combinations(numbers, 2)):
        both = values[c1].isNotNull() & values[c2].isNotNull()
        x, y = F.when(both, values[c1]), F.when(both, values[c2])
        flat = lambda v: F.min(v) == F.max(v)
        sums += [
            F.count(x).alias(f"pn{k}"), F.avg(x).alias(f"px{k}"), F.avg(y).alias(f"py{k}"),
            F.when(flat(x), 0.0).otherwise(F.var_pop(x)).alias(f"pv{k}"), F.when(flat(y), 0.0).otherwise(F.var_pop(y)).alias(f"pw{k}"),
            F.when(flat(x) | flat(y), 0.0).otherwise(F.covar_pop(x, y)).alias(f"pc{k}"),
        ]
        n = F.col(f"pn{k}")
        cells.append(_row(
            PAIR, column1=F.lit(c1), column2=F.lit(c2), n=n, a=F.col(f"px{k}"), b=F.col(f"py{k}"),
            c=F.col(f"pv{k}") * n, d=F.col(f"pw{k}") * n, e=F.col(f"pc{k}") * n,
        ))
    for i, c in enumerate(dates):
        v = F.col(f"`{c}`").cast("timestamp_ntz")
        sums += [F.count(v).alias(f"dn{i}"), F.min(v).alias(f"dl{i}"), F.max(v).alias(f"dh{i}")]
        cells.append(_row(DATE, column1=F.lit(c), n=F.col(f"dn{i}"), nulls=F.col("_rows") - F.col(f"dn{i}"), low=F.col(f"dl{i}"), high=F.col(f"dh{i}")))
    rows = df.groupBy("_file").agg(*sums).select("_file", F.inline(F.array(*cells)))
    if texts:
        values = df.select("_file", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in texts])))
        counted = values.groupBy("_file", "column", "value").agg(F.count(F.lit(1)).alias("_n"))
        rows = rows.unionByName(counted.select("_file", F.inline(F.array(_row(TEXT, column1=F.col("column"), value=F.col("value"), n=F.col("_n"))))))
    return rows


def update(spark: SparkSession, path: str, folder: str) -> tuple[DataFrame, int]:
    """The partials of the table's present files, and how many files had to be read for them.

    Partials are appended to ``folder``, one writer at a time.
    """
    files = data_files(spark, path)
    known = path_exists(spark, f"{folder.rstrip('/')}/_SUCCESS")
    stored = spark.read.schema(SCHEMA).parquet(folder) if known else spark.createDataFrame([], SCHEMA)
    key = ["file", "length", "modified"]
    # of the files only those without partials are named on the driver
    fresh = [tuple(r) for r in files.join(stored.where(F.col("kind") == FILE).select(*key), key, "left_anti").collect()]
    for start in range(0, len(fresh), FILES_AT_ONCE):
        part = fresh[start:start + FILES_AT_ONCE]
        table = spark.read.option("basePath", path).parquet(*[f for f, _, _ in part])
        listed = spark.createDataFrame(part, "file string, length bigint, modified timestamp")
        sums = _sums(table.withColumn("_file", _as_listed(table.metadataColumn("_metadata")["file_path"])))
        # at most FILES_AT_ONCE rows are listed; a file without rows is kept as such
        met = F.broadcast(listed).join(sums, _as_listed(F.col("file"), False) == F.col("_file"), "left")
        empty = {"kind": F.coalesce("kind", F.lit(FILE)), "n": F.when(F.col("kind").isNull(), F.lit(0)).otherwise(F.col("n"))}
        met.withColumns(empty).select(*[p.split()[0] for p in SCHEMA.split(", ")]).write.mode("append").parquet(folder)
    current = spark.read.schema(SCHEMA).parquet(folder) if known or fresh else stored
    return current.join(files, key, "left_semi"), len(fresh)


def _merged(partials: DataFrame, kind: str, by: Sequence[str], means: Sequence[str]) -> DataFrame:
    """Partials of a kind beside the means over all files, from which they measure their distance."""
    rows = partials.where((F.col("kind") == kind) & (F.col("n") > 0))
    totals = rows.groupBy(*by).agg(F.sum("n").alias("_n"), *[(F.sum(F.col(m) * F.col("n")) / F.sum("n")).alias(f"_{m}") for m in means])
    return rows.join(totals, list(by))


def numbers(partials: DataFrame) -> DataFrame:
    """column, count, null_count, mean, std, min, max, skewness, kurtosis over all files."""
    rows, n = _merged(partials, NUMBER, ["column1"], ["a"]), F.col("n")
    gap = F.col("a") - F.col("_a")
    m2 = F.sum(F.col("b") + n * gap * gap)
    m3 = F.sum(F.col("c") + 3 * gap * F.col("b") + n * F.pow(gap, 3))
    m4 = F.sum(F.col("d") + 4 * gap * F.col("c") + 6 * gap * gap * F.col("b") + n * F.pow(gap, 4))
    found = rows.groupBy(F.col("column1").alias("column")).agg(
        F.first("_n").alias("_n"), F.first("_a").alias("_mean"), m2.alias("_m2"), m3.alias("_m3"), m4.alias("_m4"), F.min("e").alias("_low"), F.max("f").alias("_high"),
    )
    all_columns = partials.where(F.col("kind") == NUMBER).groupBy(F.col("column1").alias("column")).agg(F.sum("n").alias("count"), F.sum("nulls").alias("null_count"))
    k, shaped = F.col("_n"), (F.col("_n") >= 3) & (F.col("_low") < F.col("_high"))
    return all_columns.join(found, "column", "left").select(
        "column", "count", "null_count", F.col("_mean").alias("mean"),
        F.when(F.col("_low") == F.col("_high"), 0.0).when(k > 1, F.sqrt(F.col("_m2") / (k - 1))).alias("std"),
        F.col("_low").alias("min"), F.col("_high").alias("max"),
        F.when(shaped, F.sqrt(k) * F.col("_m3") / F.pow(F.col("_m2"), 1.5)).alias("skewness"),
        F.when(shaped, k * F.col("_m4") / (F.col("_m2") * F.col("_m2")) - 3).alias("kurtosis"),
    )


def correlations(partials: DataFrame) -> DataFrame:
    """Pearson correlations over the complete rows of each pair: column1, column2, n, correlation."""
    rows, n = _merged(partials, PAIR, ["column1", "column2"], ["a", "b"]), F.col("n")
    x, y = F.col("a") - F.col("_a"), F.col("b") - F.col("_b")
    found = rows.groupBy("column1", "column2").agg(
        F.first("_n").alias("n"), F.sum(F.col("c") + n * x * x).alias("_x"), F.sum(F.col("d") + n * y * y).alias("_y"), F.sum(F.col("e") + n * x * y).alias("_xy"),
    )
    defined = (F.col("_x") > 0) & (F.col("_y") > 0)
    return found.select("column1", "column2", "n", F.when(defined, F.col("_xy") / F.sqrt(F.col("_x") * F.col("_y"))).alias("correlation"))


def categories(partials: DataFrame) -> DataFrame:
    """column, count, null_count, cardinality, mode, mode_count, entropy in bits."""
    counts = partials.where(F.col("kind") == TEXT).groupBy(F.col("column1").alias("column"), "value").agg(F.sum("n").alias("n"))
    known, n = F.col("value").isNotNull(), F.col("n")
    held = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(known, n)), F.lit(0)).alias("count"), F.coalesce(F.sum(F.when(~known, n)), F.lit(0)).alias("null_count"),
        F.count_if(known).alias("cardinality"), F.min_by("value", F.when(known, F.struct(-n, "value"))).alias("mode"),
        F.coalesce(F.max(F.when(known, n)), F.lit(0)).alias("mode_count"), F.sum(F.when(known, n * F.log2(n))).alias("_nlogn"),
    )
    k = F.col("count")
    return held.withColumn("entropy", F.when(k > 0, F.log2(k) - F.col("_nlogn") / k)).drop("_nlogn")


def dates(partials: DataFrame) -> DataFrame:
    """column, count, null_count, min_date, max_date."""
    return partials.where(F.col("kind") == DATE).groupBy(F.col("column1").alias("column")).agg(
        F.sum("n").alias("count"), F.sum("nulls").alias("null_count"),
        F.min(F.col("low").cast("timestamp_ntz")).alias("min_date"), F.max(F.col("high").cast("timestamp_ntz")).alias("max_date"),
    )
