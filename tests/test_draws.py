"""Many draws per group, far categories, scores that are no numbers, types that stay."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F, types as T

from hushframe.functions import noise
from hushframe.operators import sampling
from hushframe.operators.protect import ColumnRule, protect

SECRET = "s"


def scores(spark, groups):
    rows = [(g, f"c{k}", float(s)) for g, ss in groups.items() for k, s in enumerate(ss)]
    return spark.createDataFrame(rows, "grp string, cand string, score double")


def law(values, epsilon, sensitivity):
    weights = [math.exp((v - max(values)) * epsilon / (2 * sensitivity)) for v in values]
    return [w / sum(weights) for w in weights]


@pytest.mark.parametrize("per_slice", [1, 3, 1000])
def test_draws_follow_the_law(spark, monkeypatch, per_slice):
    monkeypatch.setattr(sampling, "PER_BUCKET", 50)
    monkeypatch.setattr(sampling, "DRAWS_AT_ONCE", 700)
    groups = {"even": [1, 1, 1, 1, 1, 1, 1], "steep": [0, 5, 10, 3, 9, 10], "two": [4, 0], "alone": [1000, 0, 0, 0, 0], None: [2, 3]}
    df, draws = scores(spark, groups), 4000
    found = sampling.draw_per_group(df, ["grp"], "cand", "score", 1.0, 2.0, SECRET, draws, per_slice=per_slice)
    rows = found.collect()
    again = sampling.draw_per_group(df.repartition(7), ["grp"], "cand", "score", 1.0, 2.0, SECRET, draws, per_slice=per_slice).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    for group, values in groups.items():
        mine = [r for r in rows if r.grp == group]
        assert sorted(r.draw for r in mine) == list(range(1, draws + 1)) and {r.candidates for r in mine} == {len(values)}
        seen = Counter(r.selected for r in mine)
        for k, p in enumerate(law(values, 1.0, 2.0)):
            assert abs(seen[f"c{k}"] - draws * p) <= 5 * math.sqrt(draws * p * (1 - p)) + 1e-6, (group, k)


def test_one_slice_draws_in_candidate_order(spark):
    """The inverse distribution function over candidates in order, uniform by uniform."""
    from hushframe.functions import keyed

    values = [0.5, 2.0, 1.0, 0.0]
    df = scores(spark, {"g": values})
    got = {r.draw: r.selected for r in sampling.draw_per_group(df, ["grp"], "cand", "score", 2.0, 1.0, SECRET, 50).collect()}
    points = spark.range(1, 51).withColumn("grp", F.lit("g"))
    digest = keyed.cell_digest(F.lit(SECRET), "release", "cand", [*keyed.key_columns(points, ["grp"]), F.col("id").cast("string")])
    shares = law(values, 2.0, 1.0)
    for r in points.select("id", keyed.uniform(digest).alias("u")).collect():
        k, total = 0, shares[0]
        while total <= r.u:
            k += 1
            total += shares[k]
        assert got[r.id] == f"c{k}"


@pytest.mark.parametrize("bad", [float("inf"), float("-inf"), float("nan"), None])
@pytest.mark.parametrize("draw", [sampling.select_per_group, sampling.draw_per_group])
def test_scores_must_be_finite(spark, bad, draw):
    df = spark.createDataFrame([("g", "a", 1.0), ("g", "b", bad)], "grp string, cand string, score double")
    options = {"draws": 1} if draw is sampling.draw_per_group else {}
    with pytest.raises(Exception, match="not a number or not finite"):
        draw(df, ["grp"], "cand", "score", 1.0, 1.0, SECRET, **options).collect()


def test_one_candidate_is_no_choice(spark):
    df = scores(spark, {"g": [1.0]})
    with pytest.raises(Exception, match="one candidate"):
        sampling.draw_per_group(df, ["grp"], "cand", "score", 1.0, 1.0, SECRET, 3).collect()
    with pytest.raises(ValueError):
        sampling.draw_per_group(df, ["grp"], "cand", "score", 1.0, 1.0, SECRET, 0)


def test_tails_are_summed_in_log_space():
    logs = [0.0, -1.0, -50.0, -900.0, -901.0]
    tails = sampling._log_tails(logs)
    total = math.log(math.fsum(math.exp(x) for x in logs))
    assert tails[0] == 0.0 and math.isclose(tails[3], -900 + math.log(1 + math.exp(-1)) - total)
    assert math.isclose(tails[2], -50 - total, rel_tol=1e-12) and tails == sorted(tails, reverse=True)


@pytest.mark.parametrize("head", [2000, 1])
def test_far_categories_can_be_drawn(spark, head):
    """A category some e^-40 as likely as the first is out of reach of one uniform, not of the law."""
    rows = [("often",)] * 90 + [("less",)] * 50 + [("far",)] * 10
    df = spark.createDataFrame(rows, "c string")
    laws = sampling.category_laws(df, {"c": (1.0, 1.0)}, head=head)
    last = "f" * 13

    def drawn(digest):
        frame = spark.createDataFrame([("often", digest)], "c string, d string")
        frame, cell = laws["c"].draw(frame, "c", F.col("d"))
        return frame.select(cell.alias("x")).first()[0]

    assert drawn("0" * 64) == "often"
    # ln of what is left: -36 - 0.7 with a half, about -36 - 4.2 with 1/64, -36 - 22 with 2^-32
    assert drawn(last + "0" * 13 + "8" + "0" * 12 + "0" * 25) == "less"
    assert drawn(last + "0" * 13 + "04" + "0" * 11 + "0" * 25) == "far"
    assert drawn(last + "0" * 13 + "0" * 8 + "10000" + "0" * 25) == "far"


def test_floats_stay_floats(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.FloatType())]))
    rule = {"k": ColumnRule("passthrough"), "v": ColumnRule(epsilon=1.0, lower=0.0, upper=50.0)}
    assert protect(df, rule, ["k"], SECRET).data.schema["v"].dataType == T.FloatType()
    loose = {**rule, "v": ColumnRule(epsilon=1.0, lower=0.0, upper=50.0, preserve_type=False)}
    assert protect(df, loose, ["k"], SECRET).data.schema["v"].dataType == T.DoubleType()


def test_cost_of_a_mechanism(spark):
    df = spark.createDataFrame([("laplace", 1e-6), ("gaussian", 1e-6), ("gaussian", 0.0), ("gaussian", None)], "m string, d double")
    cost = df.select(noise.mechanism_cost(F.col("m"), F.lit(0.5), F.col("d")).alias("c")).select("c.*").collect()
    assert [(r.delta, r.is_pure) for r in cost] == [(None, True), (1e-6, False), (0.0, True), (None, True)]
