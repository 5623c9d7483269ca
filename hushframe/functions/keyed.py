"""Uniform draws that are a pure function of (secret, release, column, row key).

``rand()`` draws again on every action, retry or repartition, and every such
draw would be one more release of the same cell. Hashing the row key gives the
same draw wherever and however often the row is evaluated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

DRAWS_PER_CELL = 4
_HEX_DIGITS = 13  # 52 bits per draw: the half-step below still fits a double
_STEPS = float(2**52)


def secret_column(secret: str | DataFrame) -> Column:
    """The secret as a Column.

    A literal is visible in plans and event logs and is meant for tests. A
    one-row, one-column DataFrame becomes a scalar subquery: plans then show
    where the secret is read, not what it says.
    """
    return secret.scalar() if isinstance(secret, DataFrame) else F.lit(secret)


def key_columns(df: DataFrame, key: Sequence[str]) -> list[Column]:
    """Row-key parts as text. Strings carry their length so that no two
    different keys can spell the same text; instants are counted in
    microseconds, which no session time zone changes."""
    parts = []
    for name in key:
        kind = df.schema[name].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            raise ValueError(f"row key {name}: floating point has no stable text form")
        value = F.col(f"`{name}`")
        text = (F.unix_micros(value) if isinstance(kind, T.TimestampType) else value).cast("string")
        if isinstance(kind, T.StringType):
            text = F.concat(F.length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(text, F.lit("null")))
    return parts


def cell_digest(secret: Column, release: str, column: str, key: Sequence[Column]) -> Column:
    secret = F.concat(F.length(secret).cast("string"), F.lit(":"), secret)
    named = [F.lit(f"{len(part)}:{part}") for part in (release, column)]
    return F.sha2(F.concat_ws("|", secret, *named, *key), 256)


def uniform(digest: Column, draw: int = 0) -> Column:
    """The ``draw``-th of four independent uniforms in (0, 1) held by a digest."""
    if not 0 <= draw < DRAWS_PER_CELL:
        raise ValueError(f"a digest holds {DRAWS_PER_CELL} draws, asked for {draw}")
    digits = F.substring(digest, 1 + _HEX_DIGITS * draw, _HEX_DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(_STEPS)
