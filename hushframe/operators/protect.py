"""Row-aligned noisy copies of a table.

All protected columns are expressions of one ``select``. What must be known
beforehand (bounds, sensitivities, category counts that the caller did not
give) is read by one aggregation and one value count for the whole table.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F, types as T

from hushframe.functions import keyed, noise
from hushframe.operators import sampling

PROTECT, PASSTHROUGH, EXCLUDE = "protect", "passthrough", "exclude"
LAPLACE, GAUSSIAN, EXPONENTIAL = "laplace", "gaussian", "exponential"
# days and seconds of the years 1 to 9999
_DAY_RANGE = (-719_162, 2_932_896)
_SECOND_RANGE = (-62_135_596_800, 253_402_300_799)
_BIGINT_MAX = float(2**63 - 1024)
_FLOAT_MAX = (2 - 2.0**-23) * 2.0**127


@dataclass(frozen=True)
class ColumnRule:
    """How one column leaves the house. Unset values fall back to the release."""

    mode: str = PROTECT
    epsilon: float | None = None
    lower: object = None
    upper: object = None
    sensitivity: float | None = None
    delta: float | None = None
    mechanism: str | None = None
    preserve_type: bool = True
    unit: str = "D"
    score_sensitivity: float = 1.0


@dataclass(frozen=True)
class Outcome:
    """One line of the release summary."""

    column: str
    mode: str
    mechanism: str | None = None
    epsilon: float | None = None
    delta: float | None = None
    draws: int | None = None
    data_dependent: bool = False
    error: str | None = None


@dataclass
class Release:
    """``data`` is lazy; the outcomes are known once the plan is built."""

    data: DataFrame
    source: DataFrame
    outcomes: list[Outcome]
    protected: list[str]
    passthrough: list[str]
    excluded: list[str]
    requested_epsilon: float | None = None
    notes: dict[str, str] = field(default_factory=dict)

    @property
    def total_epsilon(self) -> float:
        return sum(o.epsilon for o in self.outcomes if o.epsilon is not None)

    @property
    def total_delta(self) -> float | None:
        deltas = [o.delta for o in self.outcomes if o.delta is not None]
        return sum(deltas) if deltas else None

    def summary(self) -> DataFrame:
        """One row per source column, null counts included."""
        spark = self.source.sparkSession
        rows = [
            (i, o.column, o.mode, o.mechanism, o.epsilon, o.delta, o.data_dependent, o.error)
            for i, o in enumerate(self.outcomes)
        ]
        schema = (
            "position int, column string, mode string, mechanism string, epsilon double, "
            "delta double, data_dependent boolean, error string"
        )
        outcomes = spark.createDataFrame(rows, schema)
        kept = [*self.protected, *self.passthrough]
        if not kept:
            return outcomes.withColumn("null_count", F.lit(0).cast("bigint"))
        nulls = self.source.agg(F.array(*[
            F.struct(F.lit(c).alias("column"), F.count_if(missing(self.source, c)).alias("null_count"))
            for c in kept
        ]).alias("cells")).select(F.inline("cells"))
        return outcomes.join(F.broadcast(nulls), "column", "left").withColumn(
            "null_count", F.coalesce("null_count", F.lit(0))
        )

    def totals(self) -> DataFrame:
        """One row: sums over the protected columns and the protection rate."""
        kept = len(self.protected) + len(self.passthrough)
        return self.source.agg(F.count(F.lit(1)).alias("row_count")).select(
            "row_count",
            F.lit(kept).cast("bigint").alias("column_count"),
            F.lit(self.total_epsilon).alias("total_epsilon"),
            F.lit(self.total_delta).cast("double").alias("total_delta"),
            F.lit(len(self.protected) / kept if kept else 0.0).alias("protection_rate"),
        )


def kind_of(data_type: T.DataType, bounded: bool = False) -> str:
    """date, numeric_bounded, numeric_unbounded or categorical."""
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(data_type, T.NumericType):
        return "numeric_bounded" if bounded else "numeric_unbounded"
    if isinstance(data_type, (T.StringType, T.BooleanType)):
        return "categorical"
    raise TypeError(f"{data_type.simpleString()} can be passed through or excluded, not protected")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null."""
    value = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value)
    return value


def missing(df: DataFrame, name: str) -> Column:
    return present(df, name).isNull()


def resolve_modes(
    df: DataFrame,
    protect: Iterable[str] | None = None,
    passthrough: Iterable[str] = (),
    exclude: Iterable[str] = (),
) -> dict[str, ColumnRule]:
    """Rules from plain name lists; unknown names are ignored. Without a
    ``protect`` list everything not named elsewhere is protected."""
    passthrough, exclude = set(passthrough), set(exclude)
    rules = {}
    for name in df.columns:
        if name in exclude:
            mode = EXCLUDE
        elif name in passthrough or (protect is not None and name not in set(protect)):
            mode = PASSTHROUGH
        else:
            mode = PROTECT
        rules[name] = ColumnRule(mode=mode)
    return rules


def check_key(df: DataFrame, key: Sequence[str]) -> None:
    """Rows that share a key would share their noise."""
    if not key:
        raise ValueError("a release needs a row key")
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    if not repeated.isEmpty():
        raise ValueError(f"row key {list(key)} is not unique; see sources.with_row_key")


def _epoch(df: DataFrame, name: str, unit: str) -> Column:
    value = F.col(f"`{name}`")
    if unit == "D":
        return F.unix_date(value.cast("date")).cast("double")
    return F.unix_micros(value.cast("timestamp")) / F.lit(1e6)


def _epoch_literal(bound: object, unit: str) -> Column:
    stamp = F.lit(bound).cast("timestamp_ntz")
    if unit == "D":
        return F.unix_date(stamp.cast("date")).cast("double")
    return F.unix_micros(stamp.cast("timestamp")) / F.lit(1e6)


def protect(
    df: DataFrame,
    rules: Mapping[str, ColumnRule],
    key: Sequence[str],
    secret: str | DataFrame,
    release: str = "release",
    epsilon: float = 1.0,
    delta: float = noise.DEFAULT_DELTA,
    on_error: str = "fail",
    keep_original: bool = False,
    preserve_order: bool = False,
    unique_key: bool = False,
) -> Release:
    """A release of ``df``.

    A column that cannot be protected stops the release, or with
    ``on_error="null"`` leaves as typed nulls with the reason in the summary.
    Raw values never stand in. ``keep_original`` returns ``key``, ``orig`` and
    ``prot`` structs side by side for comparison without a join.
    ``unique_key`` states that the key is known to be unique.
    """
    if on_error not in ("fail", "null"):
        raise ValueError("on_error is 'fail' or 'null'")
    noise.check_epsilon(epsilon)
    if not unique_key:
        check_key(df, key)
    full = {c: rules.get(c, ColumnRule()) for c in df.columns}
    protected = [c for c in df.columns if full[c].mode == PROTECT]
    passthrough = [c for c in df.columns if full[c].mode == PASSTHROUGH]
    excluded = [c for c in df.columns if full[c].mode == EXCLUDE]

    plans: dict[str, dict] = {}
    refusals: dict[str, str] = {}
    for name in protected:
        try:
            plans[name] = _plan_column(df, name, full[name], epsilon, delta)
        except (ValueError, TypeError) as problem:
            refusals[name] = str(problem)
    _stop_on(refusals, on_error)

    _read_parameters(df, plans)
    secret_value = keyed.secret_column(secret)
    key_parts = keyed.key_columns(df, key)
    frame = df
    cells: dict[str, Column] = {}
    for name, plan in plans.items():
        try:
            digest = keyed.cell_digest(secret_value, release, name, key_parts)
            frame, cells[name] = _noisy_cell(frame, df, name, plan, digest)
        except ValueError as problem:
            refusals[name] = str(problem)
    _stop_on(refusals, on_error)
    for name in refusals:
        cells[name] = F.lit(None).cast(df.schema[name].dataType)

    order = [*protected, *passthrough]
    if preserve_order:
        order = [c for c in df.columns if full[c].mode != EXCLUDE]
    outputs = [cells.get(c, F.col(f"`{c}`")).alias(c) for c in order]
    if keep_original:
        data = frame.select(
            *[F.col(f"`{k}`") for k in key],
            F.struct(*[present(df, c).alias(c) for c in order]).alias("orig"),
            F.struct(*outputs).alias("prot"),
        )
    else:
        data = frame.select(*outputs)

    outcomes = []
    for name in df.columns:
        rule = full[name]
        if rule.mode != PROTECT:
            outcomes.append(Outcome(name, rule.mode))
        elif name in refusals:
            outcomes.append(Outcome(name, PROTECT, error=refusals[name]))
        else:
            plan = plans[name]
            outcomes.append(Outcome(
                name, PROTECT, plan["mechanism"], plan["epsilon"], plan.get("delta"),
                plan.get("draws", 1), plan["data_dependent"],
            ))
    return Release(data, df, outcomes, protected, passthrough, excluded)


def _stop_on(refusals: Mapping[str, str], on_error: str) -> None:
    if refusals and on_error == "fail":
        raise ValueError("; ".join(f"{c}: {why}" for c, why in refusals.items()))


def _plan_column(df: DataFrame, name: str, rule: ColumnRule, epsilon: float, delta: float) -> dict:
    """Everything about a column that needs no data."""
    bounded = rule.lower is not None and rule.upper is not None
    kind = kind_of(df.schema[name].dataType, bounded)
    usual = {
        "date": LAPLACE, "numeric_bounded": LAPLACE,
        "numeric_unbounded": GAUSSIAN, "categorical": EXPONENTIAL,
    }[kind]
    mechanism = rule.mechanism or usual
    if (mechanism == EXPONENTIAL) != (kind == "categorical") or (
        kind == "date" and mechanism != LAPLACE
    ):
        raise ValueError(f"{mechanism} does not apply to a {kind} column")
    if rule.unit not in ("D", "s"):
        raise ValueError(f"unit must be 'D' or 's', got {rule.unit}")
    plan = {
        "rule": rule, "kind": kind, "mechanism": mechanism, "data_dependent": False,
        "epsilon": noise.check_epsilon(rule.epsilon or epsilon),
    }
    if mechanism == GAUSSIAN:
        plan["delta"] = noise.check_delta(rule.delta or delta)
    if kind == "categorical":
        noise.check_sensitivity(rule.score_sensitivity)
    if kind == "numeric_bounded" and mechanism == LAPLACE:
        plan["bounds"] = noise.check_bounds(float(rule.lower), float(rule.upper))
    if rule.sensitivity is not None and mechanism == GAUSSIAN:
        plan["sensitivity"] = noise.check_sensitivity(rule.sensitivity)
    elif kind == "numeric_bounded" and mechanism == GAUSSIAN:
        lower, upper = noise.check_bounds(float(rule.lower), float(rule.upper))
        plan["sensitivity"] = noise.bounded_sensitivity(lower, upper)
    return plan


def _read_parameters(df: DataFrame, plans: dict[str, dict]) -> None:
    """One aggregation for all bounds and ranges, one value count for all
    categorical columns."""
    wanted, slots = [], []
    for name, plan in plans.items():
        rule = plan["rule"]
        if plan["kind"] == "date":
            bounds = [
                F.first(_epoch_literal(rule.lower, rule.unit)) if rule.lower is not None
                else F.min(_epoch(df, name, rule.unit)),
                F.first(_epoch_literal(rule.upper, rule.unit)) if rule.upper is not None
                else F.max(_epoch(df, name, rule.unit)),
            ]
            plan["data_dependent"] = rule.lower is None or rule.upper is None
        elif plan["kind"] != "categorical" and "bounds" not in plan and "sensitivity" not in plan:
            value = present(df, name).cast("double")
            bounds = [F.min(value), F.max(value)]
            plan["data_dependent"] = True
        else:
            continue
        slots.append(name)
        wanted += bounds
    if wanted:
        row = df.agg(*wanted).first()
        for i, name in enumerate(slots):
            plan = plans[name]
            plan["measured"] = (row[2 * i], row[2 * i + 1])
    categorical = [c for c, plan in plans.items() if plan["kind"] == "categorical"]
    if categorical:
        laws = sampling.category_laws(
            df, {c: (plans[c]["epsilon"], plans[c]["rule"].score_sensitivity) for c in categorical}
        )
        for name in categorical:
            plans[name]["law"] = laws[name]
            plans[name]["draws"] = laws[name].draws
            plans[name]["data_dependent"] = True


def _noisy_cell(
    frame: DataFrame, df: DataFrame, name: str, plan: dict, digest: Column
) -> tuple[DataFrame, Column]:
    rule, kind = plan["rule"], plan["kind"]
    if kind == "categorical":
        return plan["law"].draw(frame, name, digest)
    if kind == "date":
        return frame, _noisy_date(df, name, plan, digest)
    value = present(df, name).cast("double")
    if plan["mechanism"] == LAPLACE:
        if "bounds" not in plan:
            low, high = plan["measured"]
            if low is None:
                return frame, F.lit(None).cast(df.schema[name].dataType)
            plan["bounds"] = noise.check_bounds(low, high)
        lower, upper = plan["bounds"]
        scale = noise.laplace_scale(noise.bounded_sensitivity(lower, upper), plan["epsilon"])
        noisy = noise.clamp(value, lower, upper) + noise.laplace(scale, keyed.uniform(digest))
    else:
        if "sensitivity" not in plan:
            low, high = plan["measured"]
            plan["sensitivity"] = noise.check_sensitivity(1.0 if low is None else high - low)
        sigma = noise.gaussian_scale(plan["sensitivity"], plan["epsilon"], plan["delta"])
        noisy = value + noise.gaussian(sigma, keyed.uniform(digest, 0), keyed.uniform(digest, 1))
    if isinstance(df.schema[name].dataType, T.IntegralType) and rule.preserve_type:
        noisy = noise.clamp(F.rint(noisy), -_BIGINT_MAX, _BIGINT_MAX).cast("bigint")
    elif isinstance(df.schema[name].dataType, T.FloatType) and rule.preserve_type:
        noisy = noise.clamp(noisy, -_FLOAT_MAX, _FLOAT_MAX).cast("float")
    return frame, noisy


def _noisy_date(df: DataFrame, name: str, plan: dict, digest: Column) -> Column:
    rule, source = plan["rule"], df.schema[name].dataType
    lower, upper = plan["measured"]
    if lower is None or upper is None:
        return F.lit(None).cast(source)
    lower, upper = noise.check_bounds(lower, upper)
    scale = noise.laplace_scale(upper - lower, plan["epsilon"])
    value = noise.clamp(_epoch(df, name, rule.unit), lower, upper)
    noisy = F.rint(value + noise.laplace(scale, keyed.uniform(digest)))
    if rule.unit == "D":
        days = noise.clamp(noisy, *map(float, _DAY_RANGE)).cast("int")
        return F.date_from_unix_date(days).cast(source)
    seconds = noise.clamp(noisy, *map(float, _SECOND_RANGE)).cast("bigint")
    return F.timestamp_seconds(seconds).cast(source)


def split_epsilon(total: float, columns: int) -> float:
    """Even share, moved into the accepted range; the real total may differ
    from the request and is what the summary reports."""
    share = total / columns if columns else total
    return max(noise.EPSILON_MIN, min(noise.EPSILON_MAX, share))


def protect_with_budget(
    df: DataFrame,
    total_epsilon: float,
    key: Sequence[str],
    secret: str | DataFrame,
    protect_columns: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    rules: Mapping[str, ColumnRule] | None = None,
    **options,
) -> Release:
    """The total epsilon in even shares over the protected columns. ``rules``
    may add bounds; modes and epsilons come from the arguments."""
    modes = resolve_modes(df, protect_columns, (), exclude)
    given = rules or {}
    share = split_epsilon(total_epsilon, sum(r.mode == PROTECT for r in modes.values()))
    merged = {
        c: replace(given.get(c, ColumnRule()), mode=r.mode, epsilon=share)
        for c, r in modes.items()
    }
    result = protect(df, merged, key, secret, epsilon=share, **options)
    result.requested_epsilon = total_epsilon
    return result
