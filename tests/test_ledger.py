import math
import random

import pytest

from hushframe.operators import ledger

PRIME = 1e-10


def cost(method, taken):
    if not taken:
        return 0.0, None
    eps, deltas = [e for e, _ in taken], [d for _, d in taken if d is not None]
    total = sum(deltas) if deltas else None
    if method == "parallel":
        return max(eps), (max(deltas) if deltas else None)
    basic = 0.0
    for e in eps:
        basic += e
    if method == "basic":
        return basic, total
    k, top = len(eps), max(eps)
    tight = math.sqrt(2 * k * math.log(1 / PRIME)) * top + k * top * (math.exp(top) - 1)
    if tight < basic:
        return tight, (total or 0.0) + PRIME
    return basic, (total if total else None)


def fits(spent, limit):
    if spent[0] > limit[0]:
        return False
    return spent[1] is None or (limit[1] is not None and spent[1] <= limit[1])


def plain(method, requests, limits):
    decided, state = {}, {}
    for rid, dataset, eps, delta, _ in sorted(requests, key=lambda r: (r[4], r[0])):
        taken = state.setdefault(dataset, [])
        limit = limits.get(dataset)
        ok = limit is None or limit[0] is None or fits(cost(method, taken + [(eps, delta)]), limit)
        if ok:
            taken.append((eps, delta))
        decided[rid] = ok
    return decided


@pytest.mark.parametrize("method", ["basic", "advanced", "parallel"])
@pytest.mark.parametrize("chunk", [7, 2000])
def test_admission_matches_one_by_one(spark, method, chunk):
    import datetime

    rng = random.Random(11)
    start = datetime.datetime(2024, 1, 1)
    requests = [
        (f"q{i:04d}", rng.choice("abcd"), rng.choice([0.011, 0.023, 0.0507, 0.31, 2.1]) / (20 if i % 2 else 1),
         rng.choice([None, None, 1e-8]), start + datetime.timedelta(seconds=rng.randint(0, 90)))
        for i in range(300)
    ]
    limits = {"a": (2.0, 1e-7), "b": (1.2345, None), "c": (None, None), "d": (0.02, 1.0)}
    frame = spark.createDataFrame(requests, "query_id string, dataset string, epsilon double, delta double, ts timestamp")
    totals = spark.createDataFrame(
        [(d, *v) for d, v in limits.items()], "dataset string, total_epsilon double, total_delta double")
    found = {r["query_id"]: r["admitted"] for r in ledger.admit(frame, totals, method, chunk=chunk).collect()}
    assert found == plain(method, requests, limits)


def test_many_small_requests_go_in_bulk(spark):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    requests = [(f"{i:05d}", "x", 0.25 if i % 3 else 5.0, None, start + datetime.timedelta(seconds=i // 4))
                for i in range(2000)]
    frame = spark.createDataFrame(requests, "query_id string, dataset string, epsilon double, delta double, ts timestamp")
    totals = spark.createDataFrame([("x", 701.0, None)], "dataset string, total_epsilon double, total_delta double")
    found = {r["query_id"]: r["admitted"] for r in ledger.admit(frame, totals, chunk=20).collect()}
    assert found == plain("basic", requests, {"x": (701.0, None)})


@pytest.mark.parametrize("method", ["basic", "advanced"])
def test_one_moment_of_many_requests_takes_few_rounds(spark, monkeypatch, method):
    """100,000 requests of one ts: rounds follow the refusals, not the requests."""
    rounds = []
    fold = ledger._fold
    monkeypatch.setattr(ledger, "_fold", lambda *a: rounds.append(1) or fold(*a))
    n = 100_000
    frame = spark.range(n).selectExpr(
        "lpad(id, 6, '0') AS query_id", "'x' AS dataset", "CAST(0.25 AS double) AS epsilon", "CAST(NULL AS double) AS delta",
        "TIMESTAMP '2024-01-01' AS ts")
    total = 15_000.125 if method == "basic" else 900.0
    totals = spark.createDataFrame([("x", total, 1.0)], "dataset string, total_epsilon double, total_delta double")
    found = ledger.admit(frame, totals, method).groupBy("admitted").agg({"query_id": "max", "*": "count"}).collect()
    got = {r["admitted"]: (r["count(1)"], r["max(query_id)"]) for r in found}
    if method == "basic":
        admitted = 60_000
    else:
        spent = lambda k: min(k * 0.25, math.sqrt(2 * k * math.log(1 / PRIME)) * 0.25 + k * 0.25 * (math.exp(0.25) - 1))
        admitted = max(k for k in range(n + 1) if spent(k) <= total)
    assert got[True] == (admitted, f"{admitted - 1:06d}") and got[False][0] == n - admitted
    assert len(rounds) <= 3


def test_requests_without_room_for_the_slack_drop_out(spark, monkeypatch):
    """Every third request has a delta that fits the total only where plain composition is
    taken: once it no longer can be, those requests are refused for good."""
    import datetime

    rounds = []
    fold = ledger._fold
    monkeypatch.setattr(ledger, "_fold", lambda *a: rounds.append(1) or fold(*a))
    start = datetime.datetime(2024, 1, 1)
    requests = [(f"{i:05d}", "x", (i % 5 + 1.01) / 1000, 1e-9 if i % 3 == 0 else None, start + datetime.timedelta(seconds=i // 4))
                for i in range(3000)]
    frame = spark.createDataFrame(requests, "query_id string, dataset string, epsilon double, delta double, ts timestamp")
    limits = {"x": (1.5, 1e-7)}
    totals = spark.createDataFrame([("x", *limits["x"])], "dataset string, total_epsilon double, total_delta double")
    found = {r["query_id"]: r["admitted"] for r in ledger.admit(frame, totals, "advanced", chunk=200).collect()}
    assert found == plain("advanced", requests, limits)
    assert len(rounds) <= 8


def test_tenths_add_up_in_order(spark):
    import datetime

    requests = [(str(i), "x", 0.1, None, datetime.datetime(2024, 1, 1 + i)) for i in range(12)]
    frame = spark.createDataFrame(requests, "query_id string, dataset string, epsilon double, delta double, ts timestamp")
    totals = spark.createDataFrame([("x", 1.0, None)], "dataset string, total_epsilon double, total_delta double")
    assert sum(r["admitted"] for r in ledger.admit(frame, totals).collect()) == 10


def test_advanced_composition_is_tighter_for_many_queries(spark):
    rows = [(str(i), "x", 0.01, None) for i in range(10_000)]
    frame = spark.createDataFrame(rows, "query_id string, dataset string, epsilon double, delta double")
    row = ledger.compose_advanced(frame).first()
    assert row["epsilon"] < 100 * 0.2 and row["delta"] == PRIME


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        ledger.compose(spark.createDataFrame([], "dataset string, epsilon double, delta double"), "magic")
