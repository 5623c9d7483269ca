"""Independent draws from the category law of a column.

Every cell is replaced by a draw with Pr(category) proportional to
exp(count * epsilon / (2 * sensitivity)), independent of the cell itself.

The categories fall into two parts. The likeliest ones, at most HEAD of them,
travel as an array inside the plan. The others are grouped into levels of
equal count, hence of equal probability: a level is drawn from an array too,
and a position inside the level by a second uniform; the category at that
position is then looked up with an equi-join. A category of the second part has
a probability of at most 1/HEAD, so no join key is hot.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from hushframe.functions import keyed
from hushframe.functions.noise import check_epsilon, check_sensitivity, gumbel
from hushframe.functions.search import count_where_prefix, plan_array
from hushframe.operators.ordered import value_counts
from hushframe.session import materialize

HEAD = 2_000
LEVEL_SLICES = 4096
INLINE = 2_000
# a uniform steps by 2^-STEP_BITS; two more tell apart what lies in its last step
STEP_BITS = 52


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
        for c in columns
    ])
    return value_counts(df.select(F.inline(cells)), ["column"])


def constant_array(df: DataFrame, values: list, element: str) -> Column:
    """A constant array: inside the plan while short, else read from a
    one-row table by a scalar subquery so that plans stay readable."""
    if len(values) <= INLINE:
        return plan_array(values, element)
    line = df.sparkSession.createDataFrame([(json.dumps(values),)], "value string")
    return line.select(F.from_json("value", f"array<{element}>")).scalar()


@dataclass
class CategoryLaw:
    """How to draw one column.

    ``borders`` cumulates the slots (head categories, then levels) from the likeliest on;
    ``tails`` holds for each slot the logarithm of its and all later slots' share,
    summed in log space, so that no weight is too small for it.
    """

    data_type: T.DataType
    draws: int
    head: list[str]
    borders: list[float]
    tails: list[float]
    levels: list[tuple[int, int]]
    tail: DataFrame | None

    def _far(self, frame: DataFrame, digest: Column) -> Column:
        """The slot of a draw in the last step of its uniform, where doubles near one cannot tell
        slots apart: the step's own uniforms say how little is left, down to 2^-156."""
        step = 2.0**-STEP_BITS
        second, third = keyed.uniform(digest, 2), keyed.uniform(digest, 3)
        left = F.ln(F.when(second > step, second).otherwise(third * step)) - F.lit(STEP_BITS * math.log(2))
        held = count_where_prefix(constant_array(frame, self.tails, "double"), lambda t: t >= left, len(self.tails))
        return F.greatest(held - 1, F.lit(0))

    @property
    def single(self) -> bool:
        return self.tail is None and len(self.head) == 1

    def draw(self, frame: DataFrame, name: str, digest: Column) -> tuple[DataFrame, Column]:
        present = F.col(f"`{name}`").isNotNull()
        if not self.head and not self.levels:
            return frame, F.lit(None).cast(self.data_type)
        if self.single:
            return frame, F.when(present, F.lit(self.head[0])).cast(self.data_type)
        u = keyed.uniform(digest)
        slots = len(self.head) + len(self.levels)
        found = count_where_prefix(
            constant_array(frame, self.borders, "double"), lambda b: b <= u, slots
        )
        # rounding may leave the last border below one
        slot = F.least(F.when(u > 1 - 2.0**-STEP_BITS, self._far(frame, digest)).otherwise(found), F.lit(slots - 1))
        from_head = F.get(constant_array(frame, self.head, "string"), slot)
        if self.tail is None:
            return frame, F.when(present, from_head).cast(self.data_type)

        level = slot - len(self.head)
        size = F.get(constant_array(frame, [m for _, m in self.levels], "bigint"), level)
        count = F.get(constant_array(frame, [n for n, _ in self.levels], "bigint"), level)
        in_tail = present & (slot >= len(self.head))
        position = F.least(F.floor(keyed.uniform(digest, 1) * size), size - 1)
        # cells that need no lookup get spread keys that match nothing
        spread = -1 - F.pmod(F.xxhash64(digest), F.lit(1 << 20))
        tagged = frame.withColumns({
            f"_{name}_slot": F.when(present, slot),
            f"_{name}_level": F.when(in_tail, count).otherwise(spread),
            f"_{name}_position": F.when(in_tail, position).otherwise(F.lit(0)),
        })
        lookup = self.tail.select(
            F.col("n").alias(f"_{name}_level"),
            F.col("position").alias(f"_{name}_position"),
            F.col("value").alias(f"_{name}_drawn"),
        )
        joined = tagged.join(lookup, [f"_{name}_level", f"_{name}_position"], "left")
        cell = F.coalesce(
            F.col(f"`_{name}_drawn`"),
            F.get(constant_array(frame, self.head, "string"), F.col(f"`_{name}_slot`")),
        ) if self.head else F.col(f"`_{name}_drawn`")
        return joined, F.when(F.col(f"`{name}`").isNotNull(), cell).cast(self.data_type)


def _log_tails(logs: list[float]) -> list[float]:
    """For each position the logarithm of the share of it and all later ones."""
    sums, held = [], -math.inf
    for value in reversed(logs):
        high, low = max(held, value), min(held, value)
        held = high + math.log1p(math.exp(low - high)) if high > -math.inf else high
        sums.append(held)
    return [x - held for x in reversed(sums)]


def category_laws(
    df: DataFrame, columns: Mapping[str, tuple[float, float]], head: int = HEAD
) -> dict[str, CategoryLaw]:
    """``columns`` maps names to (epsilon, score sensitivity).

    What reaches the driver is bounded: per column at most ``head`` categories
    and the levels. Levels differ in their counts, so n rows have at most
    sqrt(2 n) of them. Every category is part of the law, however unlikely; what
    a draw can reach ends where the tail weighs less than 2^-156. The law does not
    depend on ``head``, but which category a uniform stands for does: it is part
    of a release, like the secret, and a release that is to be repeated cell by
    cell must be made with the same value.
    """
    spark = df.sparkSession
    # read several times below and again by the draws: one pass over the table
    counts = materialize(category_counts(df, list(columns)))
    levels = counts.groupBy("column", "n").agg(F.count(F.lit(1)).alias("size"))
    totals = {r["column"]: r["rows"] for r in counts.groupBy("column").agg(F.sum("n").alias("rows")).collect()}
    sizes: dict[str, list[tuple[int, int]]] = {c: [] for c in columns}
    for row in levels.collect():
        sizes[row["column"]].append((row["n"], row["size"]))

    cut: dict[str, int] = {}
    for name, found in sizes.items():
        found.sort(reverse=True)
        used = 0
        for n, size in found:
            if used + size > head:
                break
            used += size
            cut[name] = n
    wanted = spark.createDataFrame(list(cut.items()) or [("", 0)], "column string, cut bigint")
    heads: dict[str, list[tuple[int, str]]] = {c: [] for c in columns}
    for row in (
        counts.join(F.broadcast(wanted), "column").where("n >= cut").select("column", "n", "value").collect()
    ):
        heads[row["column"]].append((-row["n"], row["value"]))

    laws = {}
    for name, (eps, sens) in columns.items():
        rate = eps / (2 * sens)
        first = sorted(heads[name])
        rest = [level for level in sizes[name] if level[0] < cut.get(name, math.inf)]
        peak = sizes[name][0][0] if sizes[name] else 0
        logs = [(-n - peak) * rate for n, _ in first] + [math.log(m) + (n - peak) * rate for n, m in rest]
        weights = [math.exp((-n - peak) * rate) for n, _ in first]
        weights += [m * math.exp((n - peak) * rate) for n, m in rest]
        total, running, borders = sum(weights), 0.0, []
        for weight in weights:
            running += weight
            borders.append(running / total)
        tail = _positions(counts, name, cut.get(name), rest) if rest else None
        laws[name] = CategoryLaw(
            df.schema[name].dataType, totals.get(name, 0), [v for _, v in first], borders, _log_tails(logs), rest, tail
        )
    return laws


def _positions(counts: DataFrame, name: str, cut: int | None, levels: list[tuple[int, int]]) -> DataFrame:
    """Numbers 0..size-1 for the categories of each level. A level may hold
    most categories, so it is numbered in hash slices and the sizes of the
    earlier slices are added."""
    lowest = min(n for n, _ in levels)
    rows = counts.where((F.col("column") == name) & (F.col("n") >= lowest))
    if cut is not None:
        rows = rows.where(F.col("n") < cut)
    rows = rows.select("n", "value", F.pmod(F.xxhash64("value"), F.lit(LEVEL_SLICES)).alias("slice"))
    slices = rows.groupBy("n", "slice").agg(F.count(F.lit(1)).alias("size"))
    earlier = W.partitionBy("n").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = slices.select("n", "slice", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    inside = W.partitionBy("n", "slice").orderBy("value")
    return (
        rows.withColumn("place", F.row_number().over(inside) - 1)
        .join(starts, ["n", "slice"])
        .select("n", "value", (F.col("start") + F.col("place")).alias("position"))
    )


def select_per_group(
    scores: DataFrame,
    by: list[str],
    candidate: str,
    score: str,
    epsilon: float,
    sensitivity: float,
    secret: str | DataFrame,
    release: str = "release",
    draws: int = 1,
) -> DataFrame:
    """Private argmax per group (exponential mechanism, Gumbel form). With
    several draws every draw has its own noise and its own cost; each draw
    reads every candidate, so many draws are better left to ``draw_per_group``.
    A null, NaN or infinite score and a group of one candidate are errors."""
    check_epsilon(epsilon)
    check_sensitivity(sensitivity)
    key = keyed.key_columns(scores, [*by, candidate])
    secret_value = keyed.secret_column(secret)
    rows = scores.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    digest = keyed.cell_digest(secret_value, release, candidate, [*key, F.col("draw").cast("string")])
    noisy = _finite(score) * F.lit(epsilon / (2 * sensitivity)) + gumbel(keyed.uniform(digest))
    chosen = (
        rows.withColumn("_noisy", noisy)
        .groupBy(*by, "draw")
        .agg(F.max_by(candidate, "_noisy").alias("selected"), F.count(F.lit(1)).alias("candidates"))
    )
    return chosen.withColumn("candidates", _at_least_two(F.col("candidates")))


def _finite(score: str) -> Column:
    value = F.col(score).cast("double")
    sound = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(sound, value).otherwise(F.raise_error(F.lit("a score is not a number or not finite")).cast("double"))


def _at_least_two(candidates: Column) -> Column:
    return F.when(candidates < 2, F.raise_error(F.lit("a group has one candidate only")).cast("bigint")).otherwise(candidates)


PER_SLICE = 1_000
PER_BUCKET = 1_000
DRAWS_AT_ONCE = 10_000


def _bucket(value: Column, mass: Column, buckets: Column) -> Column:
    """The bucket of equal mass a point of [0, mass) lies in. The same rising
    function serves points and borders, so a point meets its interval."""
    return F.least(F.floor(value / mass * buckets), buckets - 1)


def _all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions)


def draw_per_group(
    scores: DataFrame,
    by: list[str],
    candidate: str,
    score: str,
    epsilon: float,
    sensitivity: float,
    secret: str | DataFrame,
    draws: int,
    release: str = "release",
    per_slice: int = PER_SLICE,
) -> DataFrame:
    """``draws`` independent private selections per group: by, draw, selected, candidates.

    The exponential mechanism by inverse distribution function: candidates of a
    group stand in a fixed order with their weights cumulated, and a draw is the
    candidate at its uniform point. Rows grow as groups x (draws + candidates), not
    as their product: candidates fall into hash slices of about ``per_slice``, a draw
    finds its slice and then its candidate, each time by an equi-join on buckets of
    equal mass. Draws spread evenly over buckets, so neither a group with most
    candidates nor a candidate with most of the weight is one task's work.

    Candidates of a group must differ. Each draw costs ``epsilon``. A null, NaN or infinite
    score and a group of one candidate are errors. A uniform has 52 bits: candidates
    together less likely than 2^-52 of their group are in effect never drawn.
    """
    check_epsilon(epsilon)
    check_sensitivity(sensitivity)
    if draws < 1 or not by:
        raise ValueError(f"draws must be at least 1 and groups named, got {draws} and {by}")
    # the caller's columns under names of our own
    keys = [f"_key{i}" for i in range(len(by))]
    named = scores.select(
        *[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys)], F.col(f"`{candidate}`").alias("_candidate"),
        (_finite(f"`{score}`") * F.lit(epsilon / (2 * sensitivity))).alias("_logit"),
    )
    tops = named.groupBy(*keys).agg(F.max("_logit").alias("_top"), F.count(F.lit(1)).alias("_n")).withColumn("_n", _at_least_two(F.col("_n")))
    match = lambda other: [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys]

    def prefixed(df: DataFrame, other: str, *columns: str) -> DataFrame:
        return df.select(*[F.col(k).alias(f"{other}{k}") for k in keys], *columns)

    slices = F.ceil(F.col("_n") / per_slice)
    weighted = named.join(prefixed(tops, "t", "_top", "_n"), _all_of(match("t"))).select(
        *keys, "_candidate", F.exp(F.col("_logit") - F.col("_top")).alias("_w"),
        F.pmod(F.xxhash64(F.col("_candidate").cast("string")), slices).alias("_slice"),
    ).where("_w > 0")
    inside = W.partitionBy(*keys, "_slice").orderBy("_candidate")
    cumulated = weighted.withColumn("_upto", F.sum("_w").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    # sums in a fixed order: the borders are the same in every run
    cells = materialize(cumulated.withColumns({
        "_low": F.coalesce(F.lag("_upto").over(inside), F.lit(0.0)),
        "_last": F.lead("_upto").over(inside).isNull(),
    }))
    parts = cells.groupBy(*keys, "_slice").agg(F.max("_upto").alias("_mass"), F.count(F.lit(1)).alias("_held"))
    line = W.partitionBy(*keys).orderBy("_slice")
    parts = parts.withColumn("_end", F.sum("_mass").over(line.rowsBetween(W.unboundedPreceding, 0)))
    parts = materialize(parts.withColumns({
        "_begin": F.coalesce(F.lag("_end").over(line), F.lit(0.0)),
        "_final": F.lead("_end").over(line).isNull(),
        "_total": F.max("_end").over(W.partitionBy(*keys)), "_slices": F.count(F.lit(1)).over(W.partitionBy(*keys)),
    }))
    totals = parts.where("_final").select(*keys, "_total", "_slices")

    chunk = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // DRAWS_AT_ONCE))).alias("_chunk")
    first = F.col("_chunk") * DRAWS_AT_ONCE + 1
    asked = totals.select("*", chunk)
    if draws > DRAWS_AT_ONCE:
        asked = asked.repartition(*keys, "_chunk")
    asked = asked.select("*", F.explode(F.sequence(first, F.least(first + (DRAWS_AT_ONCE - 1), F.lit(draws)))).alias("draw"))
    renamed = asked.withColumnsRenamed(dict(zip(keys, by)))
    parts_of_key = keyed.key_columns(renamed, by)
    digest = keyed.cell_digest(keyed.secret_column(secret), release, candidate, [*parts_of_key, F.col("draw").cast("string")])
    points = renamed.withColumn("_x", keyed.uniform(digest) * F.col("_total")).withColumnsRenamed(dict(zip(by, keys)))
    buckets = F.col("_slices") + math.ceil(draws / PER_BUCKET)
    points = points.select(*keys, "draw", "_x", _bucket(F.col("_x"), F.col("_total"), buckets).alias("_bucket"))
    stretch = lambda low, high, mass, n: F.explode(F.sequence(_bucket(low, mass, n), _bucket(high, mass, n)))
    targets = parts.select(
        "*", stretch(F.col("_begin"), F.when(F.col("_final"), F.col("_total")).otherwise(F.col("_end")), F.col("_total"), buckets).alias("_cell"),
    )
    targets = prefixed(targets, "p", "_cell", "_slice", "_begin", "_end", "_final", "_mass", "_held", "_total")
    here = (F.col("_x") >= F.col("_begin")) & (F.col("_final") | (F.col("_x") < F.col("_end")))
    sliced = points.join(targets, _all_of([*match("p"), F.col("_bucket") == F.col("_cell"), here])).select(
        *keys, "draw", "_slice", (F.col("_x") - F.col("_begin")).alias("_rest"), "_mass", "_held", "_total",
    )
    finer = F.col("_held") + F.ceil(F.lit(draws / PER_BUCKET) * F.col("_mass") / F.col("_total"))
    sliced = sliced.withColumn("_bucket", _bucket(F.col("_rest"), F.col("_mass"), finer)).drop("_mass", "_held", "_total")
    sizes = prefixed(parts, "s", F.col("_slice").alias("s_slice"), "_mass", "_held", "_total")
    met = cells.join(sizes, _all_of([*match("s"), F.col("_slice") == F.col("s_slice")]))
    met = met.select("*", stretch(F.col("_low"), F.when(F.col("_last"), F.col("_mass")).otherwise(F.col("_upto")), F.col("_mass"), finer).alias("_cell"))
    met = prefixed(met, "c", F.col("_slice").alias("c_slice"), "_cell", "_candidate", "_low", "_upto", "_last")
    there = (F.col("_rest") >= F.col("_low")) & (F.col("_last") | (F.col("_rest") < F.col("_upto")))
    drawn = sliced.join(met, _all_of([*match("c"), F.col("_slice") == F.col("c_slice"), F.col("_bucket") == F.col("_cell"), there]))
    return drawn.join(prefixed(tops, "n", F.col("_n").alias("candidates")), _all_of(match("n"))).select(
        *[F.col(k).alias(b) for k, b in zip(keys, by)], "draw", F.col("_candidate").alias("selected"), "candidates",
    )
