"""Profiles of growing tables, and releases compared by their own metadata."""

import math
import os
import uuid

import pytest
from pyspark.sql import functions as F

from hushframe.operators import correlate, profile
from hushframe.operators.protect import ColumnRule, protect
from hushframe.session import scratch_folder
from hushframe.sources import partials, readers, writers
from hushframe.sources.releases import compare_release


def folder(spark):
    return f"{scratch_folder(spark)}/test-{uuid.uuid4().hex}"


def lines(spark, low, high):
    i = F.col("id")
    return spark.range(low, high).select(
        i, (F.sin(i * 1.7) * 1e3 + 1e6).alias("x"), F.when(i % 5 != 0, F.cos(i * 0.3)).alias("y"), F.lit(2.5).alias("flat"),
        F.when(i % 4 == 0, F.lit(float("nan"))).otherwise(i * 1.0).alias("holes"), F.lit(None).cast("double").alias("none"),
        F.when(i % 3 != 0, F.concat(F.lit("k"), i % 6)).alias("label"), F.date_add(F.lit("2020-01-01"), (i % 400).cast("int")).alias("day"),
    )


def close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-8, abs_tol=1e-9))


def test_an_appended_file_is_read_alone(spark):
    path, kept = folder(spark), folder(spark)
    lines(spark, 0, 300).coalesce(1).write.parquet(path)
    lines(spark, 300, 301).coalesce(1).write.mode("append").parquet(path)
    assert partials.update(spark, path, kept)[1] == 2
    assert partials.update(spark, path, kept)[1] == 0
    lines(spark, 301, 700).coalesce(1).write.mode("append").parquet(path)
    merged, read = partials.update(spark, path, kept)
    assert read == 1
    df = spark.read.parquet(path)
    want = {r["column"]: r for r in profile.profile_numeric(df).collect()}
    for r in partials.numbers(merged).collect():
        for c in ("count", "null_count", "mean", "min", "max", "skewness", "kurtosis"):
            assert close(r[c], want[r["column"]][c]), (r["column"], c)
        assert close(r["std"], want[r["column"]]["std"])
    names = profile.numeric_columns(df)
    pairs = {(r.column1, r.column2): r for r in correlate.pearson(df, names).collect()}
    for r in partials.correlations(merged).collect():
        assert r.n == pairs[r.column1, r.column2].n and close(r.correlation, pairs[r.column1, r.column2].correlation)
    label = partials.categories(merged).first()
    whole = profile.profile_categorical(df, ["label"]).first()
    assert (label["count"], label.null_count, label.cardinality, label.mode) == (whole["count"], whole.null_count, whole.cardinality, whole["mode"])
    days, day = partials.dates(merged).first(), profile.profile_dates(df).first()
    assert (days["count"], days.min_date, days.max_date) == (day["count"], day.min_date, day.max_date)


def test_files_of_any_name_and_empty_ones(spark):
    path, kept = f"{folder(spark)}/a b%20c+d", folder(spark)
    lines(spark, 0, 40).withColumn("part", F.concat(F.lit("p q"), F.col("id") % 2)).write.partitionBy("part").parquet(path)
    lines(spark, 0, 0).coalesce(1).write.parquet(f"{path}/part=none")
    merged, read = partials.update(spark, path, kept)
    counts = {r["column"]: r["count"] for r in partials.numbers(merged).collect()}
    assert read >= 3 and counts["id"] == 40
    assert {r["column"]: r.cardinality for r in partials.categories(merged).collect()} == {"label": 4, "part": 2}
    assert partials.update(spark, path, kept)[1] == 0


def test_a_removed_file_drops_out(spark):
    path, kept = folder(spark), folder(spark)
    lines(spark, 0, 50).coalesce(1).write.parquet(f"{path}/a=1")
    lines(spark, 50, 80).coalesce(1).write.parquet(f"{path}/a=2")
    assert partials.update(spark, path, kept)[1] == 2
    place = f"{path}/a=2".removeprefix("file:")
    for name in os.listdir(place):
        os.remove(f"{place}/{name}")
    merged, read = partials.update(spark, path, kept)
    counts = {r["column"]: r["count"] for r in partials.numbers(merged).collect()}
    assert read == 0 and counts["id"] == 50


@pytest.mark.parametrize("extension", ["csv", "parquet"])
def test_a_release_is_compared_by_its_metadata(spark, extension):
    df = lines(spark, 0, 60).select("id", "x", "y", "none", "label")
    rules = {
        "id": ColumnRule("passthrough"), "x": ColumnRule(epsilon=1.0, lower=0, upper=2e6), "y": ColumnRule("exclude"),
        "none": ColumnRule(epsilon=1.0, lower=0, upper=1), "label": ColumnRule(epsilon=1.0),
    }
    release = protect(df, rules, ["id"], "s", unique_key=True)
    path = f"{folder(spark)}.{extension}"
    writers.export(release.data, path, release)
    found = {r["column"]: r for r in compare_release(spark, df, path, ["id"]).collect()}
    assert set(found) == {"x", "none", "label"}
    assert found["x"]["count"] == 60 and found["x"].mae > 0 and found["none"]["count"] == 0 and found["none"].null_count == 60
    assert found["label"].kind == "categorical" and found["label"]["count"] == 40
    with pytest.raises(ValueError, match="did not pass on"):
        compare_release(spark, df, path, ["y"])


def test_a_table_without_metadata_is_no_release(spark):
    path = f"{folder(spark)}.parquet"
    spark.range(3).write.parquet(path)
    with pytest.raises(ValueError, match="no release metadata"):
        compare_release(spark, spark.range(3).toDF("id"), path, ["id"])


def test_kinds_come_from_one_scan(spark):
    texts = ["2024-01-05", " 2024/02/07", "03/04/2020", "03-04-2020", "20240105", "Jan 5, 2024", "January 5, 2024", "5 Jan 2024", "2024", "T10:00", "x1", "", "R", "May be 3"]
    df = spark.createDataFrame([(t, i, float(i % 3), i % 2 == 0, None) for i, t in enumerate(texts)] * 5, "t string, i long, d double, b boolean, n string")
    parsed = df.select(profile.parse_date(F.col("t")).isNotNull().alias("p"), readers.may_be_date(F.col("t")).alias("m"))
    assert parsed.where("p and not m").isEmpty()  # the test lets every date through
    rate = parsed.agg(F.avg(F.col("p").cast("int"))).first()[0]
    found = {r["column"]: r for r in readers.column_kinds(df).collect()}
    assert math.isclose(found["t"].parse_rate, rate) and found["n"].parse_rate == 0.0 and found["i"].parse_rate is None
    assert found["d"].sample_values == ["0.0", "1.0", "2.0"] and found["b"].unique_count == 2 and found["n"].null_count == len(df.collect())
    scans = readers.column_kinds(df.repartition(2))._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression")
    assert scans <= 2


def test_intermediate_tables_are_deleted_on_demand(spark):
    from hushframe import session

    kept = session.materialize(spark.range(5))
    path = session._written[-1]
    assert kept.count() == 5 and writers.path_exists(spark, path)
    held = list(session._written)
    session._written[:] = [path]  # the other tests' tables stay
    assert session.clean_up(spark) == 1 and not writers.path_exists(spark, path) and session.clean_up(spark) == 0
    session._written[:] = held[:-1]


def test_dataset_comparison_makes_its_pairs_once(spark):
    from pyspark.sql import functions as F

    from hushframe.operators import compare

    made = spark.sparkContext.accumulator(0)

    def count(x: int) -> float:
        made.add(1)
        return x / 7

    noise = F.udf(count, "double").asNondeterministic()
    drawn = spark.range(50).select("id", noise("id").alias("z"))
    sides = lambda z: F.struct(F.col("id").cast("double").alias("a"), z.alias("b"))
    paired = drawn.select(sides(F.col("id") % 5 + 0.0).alias("orig"), sides(F.col("z")).alias("prot"))
    row = compare.compare_dataset(paired).first()
    assert (row["row_count"], row["numeric_columns"], made.value) == (50, 2, 50)
