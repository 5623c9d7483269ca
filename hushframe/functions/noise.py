"""Noise laws and their parameters, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Accepted parameter ranges and defaults.
EPSILON_MIN = 0.01
EPSILON_MAX = 10.0
DELTA_MIN = 1e-10
DELTA_MAX = 1e-3
DEFAULT_DELTA = 1e-6

Number = float | Column


def check_epsilon(epsilon: float) -> float:
    if not (math.isfinite(epsilon) and EPSILON_MIN <= epsilon <= EPSILON_MAX):
        raise ValueError(f"epsilon must be in [{EPSILON_MIN}, {EPSILON_MAX}], got {epsilon}")
    return float(epsilon)


def check_delta(delta: float) -> float:
    if not (math.isfinite(delta) and DELTA_MIN <= delta <= DELTA_MAX):
        raise ValueError(f"delta must be in [{DELTA_MIN}, {DELTA_MAX}], got {delta}")
    return float(delta)


def check_sensitivity(sensitivity: float) -> float:
    if not (math.isfinite(sensitivity) and sensitivity > 0):
        raise ValueError(f"sensitivity must be finite and positive, got {sensitivity}")
    return float(sensitivity)


def check_bounds(lower: float, upper: float) -> tuple[float, float]:
    if not (math.isfinite(lower) and math.isfinite(upper) and lower < upper):
        raise ValueError(f"bounds must be finite with lower < upper, got [{lower}, {upper}]")
    return float(lower), float(upper)


def parameter_problem(epsilon: Column, delta: Column, sensitivity: Column) -> Column:
    """The same guards over a table of parameters: first broken rule or null."""
    def outside(value: Column, low: float, high: float) -> Column:
        return F.isnan(value) | (value < low) | (value > high)

    return (
        F.when(epsilon.isNull() | outside(epsilon, EPSILON_MIN, EPSILON_MAX), "epsilon")
        .when(delta.isNotNull() & outside(delta, DELTA_MIN, DELTA_MAX), "delta")
        .when(
            sensitivity.isNull() | F.isnan(sensitivity) | (sensitivity <= 0)
            | (sensitivity == float("inf")),
            "sensitivity",
        )
    )


def bounded_sensitivity(lower: Number, upper: Number) -> Number:
    return upper - lower


def laplace_scale(sensitivity: Number, epsilon: Number) -> Number:
    return sensitivity / epsilon


def exponential_scale(sensitivity: Number, epsilon: Number) -> Number:
    return 2 * sensitivity / epsilon


def rho(epsilon: Number, delta: Number) -> Number:
    """Zero-concentrated budget that (epsilon, delta) buys."""
    if isinstance(epsilon, Column) or isinstance(delta, Column):
        log_term = -F.ln(delta if isinstance(delta, Column) else F.lit(delta))
        root = F.sqrt(log_term + epsilon) - F.sqrt(log_term)
        return root * root
    log_term = -math.log(delta)
    return (math.sqrt(log_term + epsilon) - math.sqrt(log_term)) ** 2


def gaussian_scale(sensitivity: Number, epsilon: Number, delta: Number) -> Number:
    budget = rho(epsilon, delta)
    if isinstance(budget, Column):
        return sensitivity / F.sqrt(2 * budget)
    return sensitivity / math.sqrt(2 * budget)


def achieved_epsilon(budget: Number, delta: Number) -> Number:
    """Epsilon that a concentrated budget gives at any target delta."""
    if isinstance(budget, Column) or isinstance(delta, Column):
        delta = delta if isinstance(delta, Column) else F.lit(delta)
        return budget + 2 * F.sqrt(-budget * F.ln(delta))
    return budget + 2 * math.sqrt(-budget * math.log(delta))


def mechanism_cost(mechanism: Column, epsilon: Column, delta: Column) -> Column:
    """What one use of a mechanism costs: struct of epsilon, delta and is_pure. Only the
    Gaussian mechanism spends a delta; a cost without one, or with zero, is pure."""
    spent = F.when(mechanism == "gaussian", delta)
    return F.struct(epsilon.alias("epsilon"), spent.alias("delta"), (F.coalesce(spent, F.lit(0.0)) == 0).alias("is_pure"))


def clamp(value: Column, lower: Number, upper: Number) -> Column:
    """Null stays null: ``least`` and ``greatest`` alone would skip it."""
    low = lower if isinstance(lower, Column) else F.lit(float(lower))
    high = upper if isinstance(upper, Column) else F.lit(float(upper))
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))


def laplace(scale: Number, u: Column) -> Column:
    centred = u - F.lit(0.5)
    return -scale * F.signum(centred) * F.ln(1 - 2 * F.abs(centred))


def gaussian(sigma: Number, u1: Column, u2: Column) -> Column:
    return sigma * F.sqrt(-2 * F.ln(u1)) * F.cos(2 * math.pi * u2)


def gumbel(u: Column) -> Column:
    return -F.ln(-F.ln(u))
