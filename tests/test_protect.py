import datetime

import pytest
from pyspark.sql import functions as F

from hushframe.operators import compare, pairs
from hushframe.operators.ledger import release_entries
from hushframe.operators.protect import (
    EXCLUDE, PASSTHROUGH, ColumnRule, protect, protect_with_budget, resolve_modes, split_epsilon,
)


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (i, 20 + i % 50, None if i % 5 == 0 else 100.0 + i, "ABC"[i % 3] if i % 7 else None,
         datetime.datetime(2020, 1, 1) + datetime.timedelta(days=i) if i % 4 else None, float("nan") if i % 3 == 0 else 1.0 * i)
        for i in range(200)
    ]
    return spark.createDataFrame(
        rows, "id bigint, age int, weight double, team string, seen timestamp_ntz, score double")


RULES = {
    "id": ColumnRule(PASSTHROUGH), "age": ColumnRule(lower=0, upper=100),
    "team": ColumnRule(score_sensitivity=20.0), "score": ColumnRule(sensitivity=10.0),
}


def test_nulls_stay_and_values_move(people):
    out = {r["id"]: r for r in protect(people, RULES, ["id"], "s").data.collect()}
    source = {r["id"]: r for r in people.collect()}
    for key, row in source.items():
        for column in ("weight", "team", "seen"):
            assert (out[key][column] is None) == (row[column] is None)
        assert (out[key]["score"] is None) == (row["score"] != row["score"])
    assert sum(out[k]["age"] != source[k]["age"] for k in source) > 150
    assert all(r["team"] in ("A", "B", "C", None) for r in out.values())


def test_types_and_order(people):
    release = protect(people, {**RULES, "seen": ColumnRule(EXCLUDE)}, ["id"], "s")
    assert release.data.columns == ["age", "weight", "team", "score", "id"]
    assert dict(release.data.dtypes)["age"] == "bigint"
    kept = protect(people, RULES, ["id"], "s", preserve_order=True).data
    assert kept.columns == people.columns


def test_unprotectable_columns_never_leak(people):
    flat = people.select("id", F.lit(3.0).alias("flat"), F.array("age").alias("listed"))
    rules = {"id": ColumnRule(PASSTHROUGH)}
    with pytest.raises(ValueError):
        protect(flat, rules, ["id"], "s")
    release = protect(flat, rules, ["id"], "s", on_error="null")
    assert release.data.where("flat is not null or listed is not null").count() == 0
    errors = {o.column: o.error for o in release.outcomes if o.error}
    assert set(errors) == {"flat", "listed"} and release.total_epsilon == 0


def test_repeated_keys_are_refused(people):
    with pytest.raises(ValueError, match="not unique"):
        protect(people, RULES, ["age"], "s")


def test_mechanism_choice_is_honoured(people):
    rules = {**RULES, "weight": ColumnRule(mechanism="laplace"), "age": ColumnRule(mechanism="gaussian", sensitivity=5.0)}
    chosen = {o.column: o.mechanism for o in protect(people, rules, ["id"], "s").outcomes}
    assert chosen["weight"] == "laplace" and chosen["age"] == "gaussian"
    with pytest.raises(ValueError):
        protect(people, {**RULES, "team": ColumnRule(mechanism="laplace")}, ["id"], "s")


def test_totals_and_ledger(people):
    release = protect(people, RULES, ["id"], "s", epsilon=0.5)
    assert release.total_epsilon == pytest.approx(2.5)
    assert release.total_delta == pytest.approx(2e-6)
    entries = {r["column"]: r for r in release_entries(release, "people", "first").collect()}
    assert entries["team"]["metadata"]["draws"] == str(people.where("team is not null").count())
    assert entries["weight"]["metadata"]["data_dependent_params"] == "true"
    assert entries["age"]["metadata"]["data_dependent_params"] == "false"


def test_even_split_is_clamped(people):
    assert split_epsilon(3.0, 3) == 1.0
    assert split_epsilon(0.01, 10) == 0.01
    assert split_epsilon(100.0, 2) == 10.0
    release = protect_with_budget(people, 0.02, ["id"], "s", ["age", "weight", "team", "score"])
    assert release.requested_epsilon == 0.02 and release.total_epsilon == pytest.approx(0.04)


def test_modes_from_names(people):
    rules = resolve_modes(people, passthrough=["id"], exclude=["team", "unknown"])
    assert {c for c, r in rules.items() if r.mode == "protect"} == {"age", "weight", "seen", "score"}


def test_pair_by_key_refuses_misaligned_tables(people):
    noisy = protect(people, RULES, ["id"], "s").data
    paired = pairs.pair_by_key(people, noisy, ["id"])
    assert compare.compare_numeric(paired, ["age"]).first()["count"] == 200
    with pytest.raises(ValueError, match="same rows"):
        pairs.pair_by_key(people, noisy.where("id > 3"), ["id"])
    with pytest.raises(ValueError, match="same columns"):
        pairs.pair_by_key(people, noisy.drop("age"), ["id"])


def test_empty_and_all_null_comparison(spark):
    df = spark.createDataFrame([(1, (None, None), (2.0, "x"))],
                               "id int, orig struct<n:double,c:string>, prot struct<n:double,c:string>")
    numbers = compare.compare_numeric(df).first()
    assert numbers["count"] == 0 and numbers["mae"] == 0.0 and numbers["mape"] is None and numbers["median_original"] == 0.0
    words = compare.compare_categorical(df).first()
    assert words["mode_preserved"] and words["category_drift"] == 0.0


def test_empty_table(people):
    empty = people.where("id < 0")
    release = protect(empty, RULES, ["id"], "s", on_error="null")
    assert release.data.count() == 0
