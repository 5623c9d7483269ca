"""Original and protected values side by side: key, ``orig`` and ``prot``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from hushframe.operators.ordered import no_nan
from hushframe.operators.protect import PROTECT, ColumnRule, check_key, present


def pair_by_key(original: DataFrame, protected: DataFrame, key: Sequence[str]) -> DataFrame:
    """Both tables matched on a unique key. Different columns, a repeated key
    or a row without a partner is an error, as a misaligned comparison would
    look like noise."""
    if set(original.columns) != set(protected.columns):
        raise ValueError("both tables need the same columns")
    names = [c for c in original.columns if c not in key]
    check_key(original, key)
    check_key(protected, key)
    left = original.select(*key, F.struct(*[present(original, c).alias(c) for c in names]).alias("orig"))
    right = protected.select(*key, F.struct(*[present(protected, c).alias(c) for c in names]).alias("prot"))
    joined = left.join(right, list(key), "full_outer")
    alone = joined.where("orig is null or prot is null").limit(1)
    if not alone.isEmpty():
        raise ValueError("both tables need the same rows")
    return joined


def released_columns(rules: Mapping[str, ColumnRule]) -> list[str]:
    """The columns worth comparing: excluded ones are gone, passed ones equal."""
    return [c for c, rule in rules.items() if rule.mode == PROTECT]


def side_columns(paired: DataFrame, kind: str) -> list[str]:
    """Columns of the original side by kind: numeric, categorical or date.
    Booleans belong to none, they are compared only when named."""
    kinds = {
        "numeric": T.NumericType,
        "categorical": T.StringType,
        "date": (T.DateType, T.TimestampType, T.TimestampNTZType),
    }
    return [
        f.name for f in paired.schema["orig"].dataType.fields if isinstance(f.dataType, kinds[kind])
    ]


def pair_cells(paired: DataFrame, columns: Sequence[str], cast) -> DataFrame:
    """(column, o, p), one row per cell; ``cast`` maps a Column to the compared type."""
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            cast(F.col("orig")[c]).alias("o"),
            cast(F.col("prot")[c]).alias("p"),
        )
        for c in columns
    ])
    return paired.select(F.inline(cells))


def number(value: Column) -> Column:
    return no_nan(value.cast("double"))


def text(value: Column) -> Column:
    return value.cast("string")


def stamp(value: Column) -> Column:
    return value.cast("timestamp_ntz")


def complete(cells: DataFrame) -> DataFrame:
    return cells.where("o is not null and p is not null")


def side_counts(cells: DataFrame, by: Sequence[str] = ("column",), masked: bool = True) -> DataFrame:
    """(by..., value, n_o, n_p): how often each value occurs on either side.
    One shuffle instead of an outer join of two counts."""
    sides = (complete(cells) if masked else cells).select(
        *by,
        F.inline(F.array(
            F.struct(F.col("o").alias("value"), F.lit(1).alias("_o"), F.lit(0).alias("_p")),
            F.struct(F.col("p").alias("value"), F.lit(0).alias("_o"), F.lit(1).alias("_p")),
        )),
    )
    return (
        sides.where(F.col("value").isNotNull())
        .groupBy(*by, "value")
        .agg(F.sum("_o").alias("n_o"), F.sum("_p").alias("n_p"))
    )
