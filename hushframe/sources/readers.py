"""Loading tables and describing their columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from hushframe.operators.profile import parse_date, text_columns, top_per_column
from hushframe.operators.protect import present

# Formats by file extension, words that hint at a date column.
FORMATS = {"csv": "csv", "tsv": "csv", "txt": "csv", "parquet": "parquet", "pq": "parquet"}
DATE_WORDS = ("date", "time", "timestamp", "created", "updated", "born", "dob")
CATEGORICAL_SHARE = 0.05
CATEGORICAL_VALUES = 100
DATE_SHARE = 0.8
SAMPLE_VALUES = 5


# quotes inside a field are doubled; fields may hold line breaks and spaces at their ends
CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


@dataclass(frozen=True)
class Loaded:
    data: DataFrame
    path: str
    format: str
    encoding: str | None


def format_of(path: str) -> str:
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path else ""
    if extension not in FORMATS:
        raise ValueError(f"unsupported file extension {extension!r}, use one of {sorted(FORMATS)}")
    return FORMATS[extension]


def load(spark: SparkSession, path: str, format: str | None = None, **options) -> Loaded:
    chosen = format or format_of(path)
    if chosen == "csv":
        return load_csv(spark, path, **options)
    if chosen == "parquet":
        return load_parquet(spark, path, **options)
    raise ValueError(f"unsupported format {chosen}")


def load_csv(spark: SparkSession, path: str, encoding: str | None = None, schema=None, **options) -> Loaded:
    """CSV with a header. Without ``encoding`` the bytes decide between UTF-8
    and ISO-8859-1; without ``schema`` types are inferred, which reads the
    file once more. Quoted fields may hold line breaks, so one file is one
    task: at scale write many files, pass ``multiLine=False``, or use Parquet.
    An empty text and a missing one look alike and are both read as null."""
    encoding = encoding or detect_encoding(spark, path)
    reader = spark.read.options(**{**CSV, "encoding": encoding, **options})
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return Loaded(reader.csv(path), path, "csv", encoding)


def detect_encoding(spark: SparkSession, path: str) -> str:
    """ISO-8859-1 accepts any byte, so one invalid UTF-8 line decides."""
    invalid = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1)
    return "UTF-8" if invalid.isEmpty() else "ISO-8859-1"


def load_parquet(spark: SparkSession, path: str, **options) -> Loaded:
    return Loaded(spark.read.options(**options).parquet(path), path, "parquet", None)


def with_row_key(df: DataFrame, path: str, name: str = "row_key") -> DataFrame:
    """The table with a unique key. Numbers given on the fly change with the
    splits of a re-read, so they are written once and read back."""
    df.withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dataset_info(loaded: Loaded) -> DataFrame:
    """One row: path, format, encoding, shape."""
    return loaded.data.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(loaded.path).alias("path"), F.lit(loaded.format).alias("format"),
        F.lit(loaded.encoding).alias("encoding"), "row_count",
        F.lit(len(loaded.data.columns)).cast("bigint").alias("column_count"),
    )


def _distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, value text, stamp): one row per distinct value and for null, from one scan.

    Cells travel in their own types, one field per type of the table; text forms are
    made, and texts are parsed as dates, once per distinct value.
    """
    kinds = {c: df.schema[c].dataType for c in columns}
    # what cannot be grouped as it is goes as text
    slot = {c: k.simpleString() if isinstance(k, _PLAIN) else "string" for c, k in kinds.items()}
    types = sorted(set(slot.values()))

    def cell(c: str) -> Column:
        value = present(df, c).cast(slot[c])
        fields = [(value if t == slot[c] else F.lit(None).cast(t)).alias(f"v{i}") for i, t in enumerate(types)]
        return F.struct(F.lit(c).alias("column"), *fields)

    slots = [f"v{i}" for i in range(len(types))]
    values = df.select(F.inline(F.array(*[cell(c) for c in columns]))).groupBy("column", *slots).agg(F.count(F.lit(1)).alias("n"))
    text = F.coalesce(*[F.col(s).cast("string") for s in slots])
    stamp = F.lit(None).cast("timestamp_ntz")
    if "string" in types:
        texts = [c for c in columns if isinstance(kinds[c], T.StringType)]
        held = F.col(f"v{types.index('string')}")
        if texts:
            stamp = F.when(F.col("column").isin(texts) & may_be_date(held), parse_date(held))
    return values.select("column", "n", text.alias("value"), stamp.alias("stamp"))


_PLAIN = (T.NumericType, T.BooleanType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)


def may_be_date(text: Column) -> Column:
    """Cheap test that leaves out most texts that no date form reads: those begin with a
    digit, a sign, a ``T`` or the name of a month, and hold a digit."""
    return text.rlike(r"^[\s\x00-\x20]*(?:[+\-T]?[0-9]|[A-Za-z]{3,9} )") & text.rlike("[0-9]")


def _column_facts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    values = _distinct_values(df, columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    known = F.col("value").isNotNull()
    n = F.col("n")
    stats = values.groupBy("column").agg(
        F.sum(n).alias("rows"),
        F.sum(F.when(known, 0).otherwise(n)).alias("null_count"),
        F.count_if(known).alias("unique_count"),
        F.sum(F.when(F.col("stamp").isNotNull(), n).otherwise(0)).alias("parsed"),
    )
    sample = (
        top_per_column(values.where(known).select("column", "value", F.lit(0).alias("n")), SAMPLE_VALUES)
        .groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
    )
    dtype = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])[F.col("column")]
    return stats.join(F.broadcast(sample), "column", "left").withColumns({
        "dtype": dtype, "sample_values": F.coalesce("sample_values", F.array().cast("array<string>")),
    })


def column_info(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """dtype, null count, distinct count and the smallest values per column.

    Distinct values are counted after a shuffle by value; the sample is the
    first ``SAMPLE_VALUES`` of each column, kept by a per-task limit.
    """
    return _column_facts(df, list(columns or df.columns)).select("column", "dtype", "rows", "null_count", "unique_count", "sample_values")


def date_parse_rate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of the known values of text columns that read as dates."""
    columns = list(columns or text_columns(df))
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    known = F.col("rows") - F.col("null_count")
    return _column_facts(df, texts).select(
        "column", known.alias("values"), F.coalesce(F.try_divide("parsed", known), F.lit(0.0)).alias("parse_rate"),
    )


def column_kinds(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Column information plus ``kind``: date, numeric, categorical, unknown."""
    columns = list(columns or df.columns)
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    known = F.col("rows") - F.col("null_count")
    rate = F.when(F.col("column").isin(texts), F.coalesce(F.try_divide("parsed", known), F.lit(0.0)))
    info = _column_facts(df, columns).select("column", "dtype", "rows", "null_count", "unique_count", "sample_values", rate.alias("parse_rate"))
    return info.withColumn("kind", _kind(df, columns))


def _kind(df: DataFrame, columns: Sequence[str]) -> Column:
    plain = {}
    for f in df.schema:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            plain[f.name] = "date"
        elif isinstance(f.dataType, T.BooleanType):
            plain[f.name] = "categorical"
        elif isinstance(f.dataType, T.NumericType):
            # any number reads as an epoch, so the name alone decides
            hinted = any(word in f.name.lower() for word in DATE_WORDS)
            plain[f.name] = "epoch" if hinted else "number"
        elif isinstance(f.dataType, T.StringType):
            plain[f.name] = "text"
        else:
            plain[f.name] = "unknown"
    typed = F.create_map(*[F.lit(x) for c in columns for x in (c, plain[c])])[F.col("column")]
    known = F.col("rows") - F.col("null_count")
    share = F.try_divide(F.col("unique_count"), known)
    few = (share < CATEGORICAL_SHARE) & (F.col("unique_count") <= CATEGORICAL_VALUES) & (known >= 20)
    very_few = (F.col("unique_count") <= 5) & (known >= 50)
    as_date = F.coalesce(F.col("parse_rate") >= DATE_SHARE, F.lit(False))
    return (
        F.when((typed == "epoch") & (known > 0), "date")
        .when((typed == "epoch"), "numeric")
        .when((typed == "number") & (few | very_few), "categorical")
        .when(typed == "number", "numeric")
        .when((typed == "text") & as_date, "date")
        .when(typed == "text", "categorical")
        .otherwise(typed)
    )


def preview(df: DataFrame, key: Sequence[str], rows: int = 100) -> DataFrame:
    """The first rows by key."""
    return df.orderBy(*key).limit(rows)
