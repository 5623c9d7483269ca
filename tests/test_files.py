import pytest
from pyspark.sql import functions as F

from hushframe.operators import catalog, profile
from hushframe.sources import readers, writers


def test_unknown_extension():
    with pytest.raises(ValueError):
        readers.format_of("table.xlsx")
    assert readers.format_of("a/b.TSV") == "csv"


def test_csv_types_and_encoding(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_bytes("id,name,joined\n1,José,2020-01-05\n2,Ana,2021-02-03\n".encode("latin-1"))
    loaded = readers.load(spark, str(path))
    assert loaded.encoding == "ISO-8859-1"
    assert [r["name"] for r in loaded.data.orderBy("id").collect()] == ["José", "Ana"]
    kinds = {r["column"]: r["kind"] for r in readers.column_kinds(loaded.data).collect()}
    assert kinds == {"id": "numeric", "name": "categorical", "joined": "date"}


def test_metadata_is_none_without_any(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "x.parquet"))
    spark.range(3).write.csv(str(tmp_path / "x.csv"))
    assert writers.read_metadata(spark, str(tmp_path / "x.parquet")) is None
    assert writers.read_metadata(spark, str(tmp_path / "x.csv")) is None


def test_row_key_is_unique_and_stable(spark, tmp_path):
    keyed = readers.with_row_key(spark.range(1000).repartition(7).drop("id").withColumn("v", F.lit(1)), str(tmp_path / "k"))
    assert keyed.select("row_key").distinct().count() == 1000
    assert keyed.orderBy("row_key").collect() == keyed.orderBy("row_key").collect()


def test_kinds_of_small_tables(spark):
    df = spark.createDataFrame(
        [(i % 3, i * 1.5, i % 2 == 0, "2020/01/0%d" % (i % 9 + 1), None) for i in range(60)],
        "code int, amount double, flag boolean, day string, nothing string")
    kinds = {r["column"]: r["kind"] for r in readers.column_kinds(df).collect()}
    assert kinds["code"] == "categorical" and kinds["amount"] == "numeric"
    assert kinds["flag"] == "categorical" and kinds["day"] == "date"


def test_profile_edges(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "one double, none double")
    rows = {r["column"]: r for r in profile.profile_numeric(df).collect()}
    assert rows["one"]["std"] == 0.0 and rows["one"]["skewness"] is None
    assert rows["none"]["count"] == 0 and rows["none"]["outlier_count"] == 0 and rows["none"]["median"] is None


@pytest.mark.parametrize("name,level", [
    ("patient_ssn", "high"), ("FirstName", "high"), ("first_name", "high"), ("dob", "high"), ("age", "medium"),
    ("visit-date", "medium"), ("record_id", "low"), ("xyz_id", "low"), ("status_code", "low"), ("foo", "medium"),
])
def test_name_rules(spark, name, level):
    df = spark.createDataFrame([(name,)], "column string")
    assert catalog.classify(df).first()["level"] == level


def test_rule_counts():
    assert catalog.NameRules().counts() == {"high": 71, "medium": 50, "low": 33}
    assert catalog.NameRules(low=(("x", "y"),)).counts()["low"] == 34


def test_files_of_the_growing_table_are_bounded(spark, sf_dir, monkeypatch):
    from hushframe.plans import files

    monkeypatch.setattr(files, "ROWS_PER_FILE", 1000)
    merged, read = files._growing(spark, sf_dir)
    held = [r["n"] for r in merged.where("kind = 'file'").collect()]
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert read == 1 and sum(held) == rows
    assert len(held) == -(-rows // 1000) and max(held) < 2000
