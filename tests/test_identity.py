"""Identity of ledger rows, contents, keys and constants."""

import datetime

import pytest
from pyspark.sql import functions as F

from hushframe.functions import keyed
from hushframe.operators import catalog, correlate, divergence, ledger, profile, sampling, tables
from hushframe.sources import readers, writers

REQUESTS = "query_id string, dataset string, epsilon double, delta double, ts timestamp"
TOTALS = "dataset string, total_epsilon double, total_delta double"
DAY = datetime.datetime(2024, 1, 1)


def test_equal_ids_of_two_datasets_are_two_requests(spark):
    requests = spark.createDataFrame([("q1", d, 0.5, None, DAY) for d in "AB"], REQUESTS)
    totals = spark.createDataFrame([("A", 1.0, None), ("B", 0.001, None)], TOTALS)
    got = sorted((r.dataset, r.admitted) for r in ledger.admit(requests, totals).collect())
    assert got == [("A", True), ("B", False)]
    rich = spark.createDataFrame([("A", 1.0, None), ("B", 1.0, None)], TOTALS)
    assert ledger.admit(requests, rich).count() == 2
    left = ledger.annul(requests, requests.where("dataset = 'A'"))
    assert [r.dataset for r in left.collect()] == ["B"]
    with pytest.raises(ValueError):
        ledger.admit(requests.union(requests), rich)


@pytest.mark.parametrize("same_time", [True, False])
@pytest.mark.parametrize("chunk", [40, 2000])
def test_bulk_and_fold_admit_alike(spark, same_time, chunk):
    rows = [(f"{i:04d}", "x", 0.01, None, DAY + datetime.timedelta(seconds=0 if same_time else i)) for i in range(200)]
    requests = spark.createDataFrame(rows, REQUESTS)
    totals = spark.createDataFrame([("x", 1.25, None)], TOTALS)
    assert ledger.admit(requests, totals, chunk=chunk).where("admitted").count() == 125


def test_a_null_moved_between_columns_changes_the_fingerprint(spark):
    a = spark.createDataFrame([(None, "x")], "p string, q string")
    b = spark.createDataFrame([("x", None)], "p string, q string")
    assert profile.fingerprint(a).first() != profile.fingerprint(b).first()


def test_constants_in_many_parts(spark):
    df = spark.range(4000).repartition(7).selectExpr("id", "0.1D AS c", "sin(id) AS s")
    for names in (["id", "c", "s"], ["id", "c", "s", *(f"s{i}" for i in range(12))]):
        wide = df.select("*", *[F.sin(F.col("id") * i).alias(f"s{i}") for i in range(12)])
        found = {(r.column1, r.column2): r.correlation for r in correlate.correlation_matrix(wide, names).collect()}
        assert all(v is None for k, v in found.items() if "c" in k)
        assert abs(found["id", "s"]) < 0.1 and found["s", "s"] == 1.0
    row = profile.profile_numeric(df, ["c"]).first()
    assert (row["std"], row["skewness"], row["kurtosis"]) == (0.0, None, None)
    pairs = df.selectExpr("struct(c AS v) AS orig", "struct(c + s AS v) AS prot")
    drift = divergence.numeric_drift(pairs, ["v"]).first()
    assert drift["mean_shift"] == float("inf") or drift["mean_shift"] == 0.0
    same = divergence.numeric_drift(df.selectExpr("struct(c AS v) AS orig", "struct(c AS v) AS prot"), ["v"]).first()
    assert same["mean_shift"] == 0.0


def test_keys_do_not_depend_on_the_time_zone(spark):
    df = spark.createDataFrame([(DAY, "a|b")], "t timestamp, s string")
    zone = spark.conf.get("spark.sql.session.timeZone")

    def digest(release="r", column="c"):
        return df.select(keyed.cell_digest(F.lit("secret"), release, column, keyed.key_columns(df, ["t", "s"]))).first()[0]

    first = digest()
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
        assert digest() == first
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert digest("r|x", "y") != digest("r", "x|y")


def test_csv_keeps_any_text(spark, tmp_path):
    texts = ['a ""b"", c', "line\nbreak", " spaces ", "", None, 'quote"', "semi;colon,comma", "back\\slash", "\u00e9"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    done = writers.export_csv(df, str(tmp_path / "x.csv"))
    back = readers.load_csv(spark, str(tmp_path / "x.csv"), schema=df.schema).data
    assert done.row_count == len(texts)
    # CSV does not tell an empty text from a missing one
    assert {r.i: r.t for r in back.collect()} == {i: t or None for i, t in enumerate(texts)}
    path = tmp_path / "plain.csv"
    path.write_text('k,t\n1,"a ""b"", c"\n2,"x\ny"\n3,z\n')
    assert [r.t for r in readers.load_csv(spark, str(path)).data.orderBy("k").collect()] == ['a "b", c', "x\ny", "z"]


def test_exponential_mechanism_guards(spark):
    rows = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 2.0)], "g string, c string, s double")
    pick = lambda df, **k: sampling.select_per_group(df, ["g"], "c", "s", **{"epsilon": 1.0, "sensitivity": 1.0, "secret": "x", **k})
    assert pick(rows).count() == 1
    with pytest.raises(ValueError):
        pick(rows, epsilon=1e6)
    with pytest.raises(Exception, match="not a number"):
        pick(rows.withColumn("s", F.lit(float("nan")))).collect()
    with pytest.raises(Exception, match="one candidate"):
        pick(rows.limit(1)).collect()


def test_content_of_one_table_says_nothing_of_another(spark):
    numbers = spark.createDataFrame([(f"123-45-{i:04d}",) for i in range(20)], "code_x string")
    words = spark.createDataFrame([("word",)] * 20, "code_x string")
    both = {"t1": numbers, "t2": words}
    judged = catalog.classify(catalog.catalog_of(both))
    got = {r.table: r.level for r in catalog.refine_by_content(judged, catalog.content_scan_of(both)).collect()}
    assert got["t1"] == "high" and got["t2"] != "high"
    with pytest.raises(ValueError):
        catalog.refine_by_content(judged, catalog.content_scan(numbers))


def test_an_outlier_makes_few_automatic_bins(spark):
    values = spark.range(2000).selectExpr("CASE WHEN id = 0 THEN 1e9 ELSE id % 100 / 10D END AS v")
    pairs = values.selectExpr("struct(v) AS orig", "struct(v) AS prot")
    found = tables.histogram_auto(pairs, ["v"])
    assert found.count() <= 200 and found.agg(F.sum("n_o")).first()[0] == 2000
