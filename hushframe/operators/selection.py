"""Exact quantiles without a sort or a shuffle of the column.

A wanted rank is bracketed: a sketch proposes two values around it, one pass of
plain sums counts the rows below and inside, and the bracket is kept if the rank
is in it. Brackets narrow until few rows are left inside; only those are shuffled
and ordered. The sketch saves work and has no say in the result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rows a bracket may hold when its values are ordered, in one task.
FEW = 100_000
#: Share of the rows by which a bracket reaches beyond its rank, and the sketch's accuracy.
SLACK = 1 / 512
ACCURACY = 4096
#: Sums that share a pass over the table (more than 100 fields would not be compiled into
#: one loop), and brackets that are ordered together.
SUMS = 96
TOGETHER = 128


@dataclass
class _Bracket:
    column: int
    share: str
    first: int  # ranks from 0: the values interpolated between
    second: int
    low: float
    high: float
    before: int
    within: int
    slack: float = SLACK
    settled: bool = False

    @property
    def open(self) -> bool:
        return not self.settled and self.within > FEW and self.low < self.high


def _value(column: int) -> Column:
    return F.col(f"v{column}")


def _inside(bracket: _Bracket) -> Column:
    return (_value(bracket.column) >= bracket.low) & (_value(bracket.column) <= bracket.high)


def _one_row(table: DataFrame, columns: list[Column]) -> list:
    """Values of one aggregation over the table, a bounded number of columns a pass."""
    out: list = []
    for start in range(0, len(columns), SUMS):
        part = columns[start:start + SUMS]
        out += list(table.agg(*[c.alias(f"a{i}") for i, c in enumerate(part)]).first())
    return out


def _narrow(table: DataFrame, brackets: list[_Bracket]) -> None:
    """One round: values proposed by sketches inside the brackets, kept where the counts agree."""
    spans: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        spans.setdefault((b.column, b.low, b.high, b.before, b.within), []).append(b)
    asked = []
    for held in spans.values():
        shares = []
        for b in held:
            shares += [max((b.first - b.before) / b.within - b.slack, 0.0), min((b.second - b.before + 1) / b.within + b.slack, 1.0)]
        asked.append(F.approx_percentile(F.when(_inside(held[0]), _value(held[0].column)), shares, ACCURACY))
    proposed = _one_row(table, asked)
    trials = []
    for held, values in zip(spans.values(), proposed):
        trials += [(b, values[2 * i], values[2 * i + 1]) for i, b in enumerate(held)]
    counted = _one_row(table, [
        c for b, low, high in trials
        for c in (F.count_if(_value(b.column) < low), F.count_if(_value(b.column) <= high))
    ])
    for (b, low, high), before, upto in zip(trials, counted[::2], counted[1::2]):
        if before <= b.first and b.second < upto:
            b.settled = upto - before >= b.within  # nothing left to cut off
            b.low, b.high, b.before, b.within, b.slack = low, high, before, upto - before, SLACK
        elif b.slack >= 1:
            b.settled = True
        else:
            b.slack *= 8


def _ordered(table: DataFrame, brackets: list[_Bracket]) -> dict[int, tuple[float, float]]:
    """The values at both ranks of each bracket, from its value counts."""
    cells = F.array_compact(F.array(*[
        F.when(_inside(b), F.struct(F.lit(i).alias("bracket"), _value(b.column).alias("value"))) for i, b in enumerate(brackets)
    ]))
    counts = table.select(F.inline(cells)).groupBy("bracket", "value").agg(F.count(F.lit(1)).alias("n"))
    ranks = [(i, b.first - b.before, b.second - b.before) for i, b in enumerate(brackets)]
    wanted = F.from_json(F.lit(str([list(r[1:]) for r in ranks])), "array<array<bigint>>")
    line = W.partitionBy("bracket").orderBy("value")
    upto = F.sum("n").over(line.rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumn("_upto", upto).withColumn("_rank", F.get(wanted, F.col("bracket")))

    def at(k: int) -> Column:
        rank = F.get("_rank", F.lit(k))
        return F.min(F.when(rank < F.col("_upto"), F.col("value")))

    return {r["bracket"]: (r["a"], r["b"]) for r in ranked.groupBy("bracket").agg(at(0).alias("a"), at(1).alias("b")).collect()}


def exact_quantiles(df: DataFrame, values: Mapping[str, Column], shares: Mapping[str, float]) -> list[dict]:
    """Per entry of ``values`` a dict of ``column``, ``count`` (known values) and the linearly
    interpolated quantile of each share, None without a value. NaN counts as missing.

    Runs now: one pass for counts and extremes, two for each round of narrowing (one
    round up to some 20 million rows, one more for each further factor of a few
    hundred), one that orders what is left. Only a few numbers per quantile reach the driver.
    """
    names = list(values)
    doubles = [values[n].cast("double") for n in names]
    table = df.select(*[F.when(~F.isnan(v), v).alias(f"v{i}") for i, v in enumerate(doubles)])
    found = _one_row(table, [f(_value(i)) for i in range(len(names)) for f in (F.count, F.min, F.max)])
    brackets, counts = [], found[::3]
    for i, n in enumerate(counts):
        for share, p in shares.items():
            if n:
                position = p * (n - 1)
                brackets.append(_Bracket(i, share, math.floor(position), math.ceil(position), found[3 * i + 1], found[3 * i + 2], 0, n))
    while active := [b for b in brackets if b.open]:
        _narrow(table, active)
    left = [b for b in brackets if b.low < b.high]
    picked: dict[int, tuple[float, float]] = {}
    for start in range(0, len(left), TOGETHER):
        part = left[start:start + TOGETHER]
        picked |= {id(part[i]): pair for i, pair in _ordered(table, part).items()}
    out = [{"column": name, "count": n, **dict.fromkeys(shares)} for name, n in zip(names, counts)]
    for b in brackets:
        low, high = picked.get(id(b), (b.low, b.high))
        position = shares[b.share] * (counts[b.column] - 1)
        out[b.column][b.share] = low + (high - low) * (position - math.floor(position))
    return out


def quantile_table(df: DataFrame, values: Mapping[str, Column], shares: Mapping[str, float]) -> DataFrame:
    """``exact_quantiles`` as a table of one row per column: column, count, and each share.
    Columns without a value are left out."""
    rows = [tuple(r.values()) for r in exact_quantiles(df, values, shares) if r["count"]]
    schema = ", ".join(["`column` string", "`count` bigint", *[f"`{s}` double" for s in shares]])
    return df.sparkSession.createDataFrame(rows, schema)
