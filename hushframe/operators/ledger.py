"""The privacy budget ledger: what was spent, what is left, what may be asked.

A ledger row is ``query_id, dataset, name, epsilon, delta, mechanism, column,
ts, metadata``; totals are ``dataset, total_epsilon, total_delta``. Every
operator works on all datasets at once. Appending needs a single writer:
Parquet has no atomic append, so two drivers could both be admitted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hushframe.operators.protect import PROTECT, Release
from hushframe.session import materialize

BASIC, ADVANCED, PARALLEL = "basic", "advanced", "parallel"
METHODS = (BASIC, ADVANCED, PARALLEL)
DELTA_PRIME = 1e-10  # fixed value: the slack advanced composition pays for

LEDGER_SCHEMA = (
    "query_id string, dataset string, name string, epsilon double, delta double, "
    "mechanism string, column string, ts timestamp, metadata map<string,string>"
)


def advanced_epsilon(k: Column, max_epsilon: Column, delta_prime: float = DELTA_PRIME) -> Column:
    spread = F.sqrt(2 * k * math.log(1 / delta_prime)) * max_epsilon
    return spread + k * max_epsilon * (F.exp(max_epsilon) - 1)


def _composed(
    method: Column, k: Column, sum_eps: Column, max_eps: Column, sum_delta: Column, max_delta: Column,
    delta_prime: float,
) -> tuple[Column, Column]:
    """Epsilon and delta (null when pure) of a set of queries given its sums."""
    tight = advanced_epsilon(k, max_eps, delta_prime)
    better = (method == ADVANCED) & (tight < sum_eps)
    spent = F.coalesce(sum_delta, F.lit(0.0))
    epsilon = F.when(method == PARALLEL, max_eps).when(better, tight).otherwise(sum_eps)
    delta = (
        F.when(method == PARALLEL, max_delta)
        .when(better, spent + delta_prime)
        .when((method == ADVANCED) & (spent == 0), F.lit(None))
        .otherwise(sum_delta)
    )
    return epsilon, delta


def compose(
    ledger: DataFrame,
    method: str | None = None,
    by: Sequence[str] = ("dataset",),
    delta_prime: float = DELTA_PRIME,
) -> DataFrame:
    """Consumed (epsilon, delta) per group. Without ``method`` rows are composed
    per group and value of the ledger's own ``method`` column."""
    if method is not None and method not in METHODS:
        raise ValueError(f"unknown composition {method}, use one of {METHODS}")
    rows = ledger if method is None else ledger.withColumn("method", F.lit(method))
    sums = rows.groupBy(*by, "method").agg(
        F.count(F.lit(1)).alias("query_count"),
        F.sum("epsilon").alias("_se"), F.max("epsilon").alias("_me"),
        F.sum("delta").alias("_sd"), F.max("delta").alias("_md"),
    )
    epsilon, delta = _composed(
        F.col("method"), F.col("query_count"), F.col("_se"), F.col("_me"), F.col("_sd"), F.col("_md"),
        delta_prime,
    )
    return sums.select(*by, "query_count", "method", epsilon.alias("epsilon"), delta.alias("delta"))


def compose_basic(ledger: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    return compose(ledger, BASIC, by)


def compose_advanced(
    ledger: DataFrame, by: Sequence[str] = ("dataset",), delta_prime: float = DELTA_PRIME
) -> DataFrame:
    return compose(ledger, ADVANCED, by, delta_prime)


def compose_parallel(ledger: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    return compose(ledger, PARALLEL, by)


def add_budgets(eps_a: Column, delta_a: Column, eps_b: Column, delta_b: Column) -> tuple[Column, Column]:
    """Sum of two budgets; delta is null only when both are pure."""
    known = F.coalesce(delta_a, F.lit(0.0)) + F.coalesce(delta_b, F.lit(0.0))
    return eps_a + eps_b, F.when(delta_a.isNotNull() | delta_b.isNotNull(), known)


def fits(epsilon: Column, delta: Column, total_epsilon: Column, total_delta: Column) -> Column:
    """A cost with a delta never fits a total without one."""
    within = F.coalesce(delta <= total_delta, F.lit(False))
    return (epsilon <= total_epsilon) & (delta.isNull() | within)


def strictly_less(epsilon: Column, delta: Column, other_epsilon: Column, other_delta: Column) -> Column:
    smaller = (epsilon < other_epsilon) | F.coalesce(delta < other_delta, F.lit(False))
    return fits(epsilon, delta, other_epsilon, other_delta) & smaller


def is_pure(delta: Column) -> Column:
    return F.coalesce(delta, F.lit(0.0)) == 0


def budget_text(epsilon: Column, delta: Column) -> Column:
    pure = F.format_string("ε=%.4f", epsilon)
    return F.when(is_pure(delta), pure).otherwise(F.format_string("ε=%.4f, δ=%.2e", epsilon, delta))


def status(ledger: DataFrame, totals: DataFrame, method: str = BASIC) -> DataFrame:
    """Consumed, remaining, utilisation and excess per dataset. Datasets
    without a ledger row have spent nothing; a null total is unlimited."""
    used = compose(ledger, method).withColumnsRenamed({"epsilon": "consumed_epsilon", "delta": "consumed_delta"})
    joined = totals.select("dataset", "total_epsilon", "total_delta").join(used, "dataset", "left")
    eps, delta = F.col("consumed_epsilon"), F.col("consumed_delta")
    total, total_delta = F.col("total_epsilon"), F.col("total_delta")
    return joined.withColumns({
        "query_count": F.coalesce("query_count", F.lit(0)),
        "method": F.lit(method),
        "consumed_epsilon": F.coalesce(eps, F.lit(0.0)),
    }).withColumns({
        "remaining_epsilon": F.when(total.isNotNull(), F.greatest(F.lit(0.0), total - eps)),
        "remaining_delta": F.when(
            total_delta.isNotNull(),
            F.greatest(F.lit(0.0), total_delta - F.coalesce(delta, F.lit(0.0))),
        ),
        "utilization": F.when(total.isNull() | (total == 0), 0.0).otherwise(F.try_divide(eps, total)),
        "exceeded": F.when(total.isNull(), F.lit(False)).otherwise(~fits(eps, delta, total, total_delta)),
    })


def summary(ledger: DataFrame, totals: DataFrame, method: str = BASIC) -> DataFrame:
    """The status as display text."""
    unlimited = F.lit("unlimited")
    known = F.col("total_epsilon").isNotNull()
    return status(ledger, totals, method).select(
        "dataset",
        F.when(known, budget_text(F.col("total_epsilon"), F.col("total_delta"))).otherwise(unlimited)
        .alias("total_budget"),
        budget_text(F.col("consumed_epsilon"), F.col("consumed_delta")).alias("consumed_budget"),
        F.when(known, budget_text(F.col("remaining_epsilon"), F.col("remaining_delta")))
        .otherwise(unlimited).alias("remaining_budget"),
        F.col("method").alias("composition_method"),
        "query_count",
        F.format_string("%.1f%%", F.col("utilization") * 100).alias("budget_utilization"),
        F.col("exceeded").alias("is_exceeded"),
    )


def can_afford(
    ledger: DataFrame, totals: DataFrame, requests: DataFrame, method: str = BASIC,
    delta_prime: float = DELTA_PRIME,
) -> DataFrame:
    """Whether each request alone would still fit: requests plus ``affordable``."""
    sums = ledger.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("_k"), F.sum("epsilon").alias("_se"), F.max("epsilon").alias("_me"),
        F.sum("delta").alias("_sd"), F.max("delta").alias("_md"),
    )
    eps, delta = F.col("epsilon"), F.col("delta")
    zero = F.lit(0.0)
    epsilon, composed = _composed(
        F.lit(method),
        F.coalesce("_k", F.lit(0)) + 1,
        F.coalesce("_se", zero) + eps,
        F.greatest("_me", eps),
        add_budgets(eps, F.col("_sd"), eps, delta)[1],
        F.greatest("_md", delta),
        delta_prime,
    )
    limits = totals.select("dataset", "total_epsilon", "total_delta")
    return (
        requests.join(limits, "dataset", "left").join(sums, "dataset", "left")
        .withColumn(
            "affordable",
            F.when(F.col("total_epsilon").isNull(), F.lit(True))
            .otherwise(fits(epsilon, composed, F.col("total_epsilon"), F.col("total_delta"))),
        )
        .select(*requests.columns, "affordable")
    )


CHUNK = 2_000
#: Sums of a queue are decimals: adding in another order gives the same sum, so no
#: decision depends on whether a request was admitted in bulk or one by one.
EXACT = "decimal(28,18)"
_SUMS = ("k", "se", "me", "sd", "md")
#: Stretches admitted in bulk: places from ``start`` up to before ``until``, of the
#: requests that could still fit with the sums held then.
SPANS = f"array<struct<start:bigint,until:bigint,k:bigint,se:{EXACT},me:double,sd:{EXACT},slack:boolean>>"


def admit(
    requests: DataFrame,
    totals: DataFrame,
    method: str = BASIC,
    delta_prime: float = DELTA_PRIME,
    chunk: int = CHUNK,
) -> DataFrame:
    """Requests in the order of (ts, query_id), each admitted when the composed
    cost of the admitted ones and itself fits; refused ones cost nothing. Adds
    ``admitted``. Datasets without a total admit all.

    Every decision depends on all earlier ones, yet no dataset is gathered in
    one task. One range sort gives each request its place. A round adds up the
    parts of that order, finds the first part in which the budget cannot hold
    every request, scans that part for the first misfit, and admits all before
    it; the next ``chunk`` requests are then folded one by one. Composed epsilon
    never falls, so a request larger than what is left is refused for good and
    drops out of the next round; so does one whose delta leaves no room for the slack of
    advanced composition, once no order of the waiting requests can do without it. Rounds
    follow the refusals that leave room for others, not the requests. What a round
    leaves behind is a few numbers per dataset.

    A request is known by (dataset, query_id); a repeated pair is an error.
    Costs are summed as decimals with 18 places. A null ts comes first.
    """
    if method not in METHODS:
        raise ValueError(f"unknown composition {method}, use one of {METHODS}")
    if not requests.groupBy("dataset", "query_id").count().where("count > 1").isEmpty():
        raise ValueError("a (dataset, query_id) occurs more than once")
    limits = totals.where("total_epsilon is not null").select("dataset", "total_epsilon", "total_delta")
    columns = requests.columns
    if method == PARALLEL:
        # the largest admitted cost fits by itself, so order does not matter
        ok = fits(F.col("epsilon"), F.col("delta"), F.col("total_epsilon"), F.col("total_delta"))
        return requests.join(limits, "dataset", "left").withColumn(
            "admitted", F.col("total_epsilon").isNull() | ok
        ).select(*columns, "admitted")

    order = ["dataset", "ts", "query_id"]
    limited = requests.join(limits.select("dataset"), "dataset", "left_semi")
    placed = materialize(
        limited.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    queue = placed.select("dataset", "epsilon", "delta", "_at")
    none = F.lit(None).cast("double")
    states = materialize(limits.withColumns({
        "k": F.lit(0).cast("bigint"), "se": F.lit(0).cast(EXACT), "me": F.lit(0.0), "sd": none.cast(EXACT), "md": none,
        "done": F.lit(-1).cast("bigint"), "slack": F.lit(False), "spans": F.array().cast(SPANS),
    }))
    taken, in_bulk = None, False
    while True:
        waiting = materialize(_waiting(queue, states, method, delta_prime))
        most = waiting.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most == 0:
            break
        if most > chunk and not in_bulk:
            states, in_bulk = materialize(_admit_in_bulk(waiting, states, method, delta_prime)), True
            continue
        folded, in_bulk = materialize(_fold(waiting, states, method, delta_prime, chunk)), False
        found = folded.select("dataset", F.explode("taken").alias("_at"))
        taken = found if taken is None else taken.unionByName(found)
        states = folded.drop("taken")
    spans = states.select("dataset", "spans", "total_epsilon", "total_delta")
    in_span = F.exists(
        "spans",
        lambda s: (F.col("_at") >= s["start"]) & (F.col("_at") < s["until"])
        & _may_fit(s["k"], s["se"], s["me"], s["sd"], s["slack"], method, delta_prime),
    )
    marked = placed.join(spans, "dataset")
    accepted = in_span
    if taken is not None:
        marked = marked.join(taken.withColumn("_taken", F.lit(True)), ["dataset", "_at"], "left")
        accepted = in_span | F.col("_taken").isNotNull()
    free = requests.join(limits.select("dataset"), "dataset", "left_anti").select(*columns, F.lit(True).alias("admitted"))
    return marked.select(*columns, accepted.alias("admitted")).unionByName(free)


def _plus(total: Column, cost: Column) -> Column:
    """Decimal sum; null only if both are."""
    none = F.lit(0).cast(EXACT)
    added = F.coalesce(total.cast(EXACT), none) + F.coalesce(cost.cast(EXACT), none)
    return F.when(total.isNotNull() | cost.isNotNull(), added.cast(EXACT))


def _may_fit(
    k: Column, se: Column, me: Column, sd: Column, slack: Column, method: str, delta_prime: float
) -> Column:
    """Whether a request could still be admitted, now or after others. Both
    sums only grow, so what fails here is refused for good."""
    epsilon, delta = F.col("epsilon"), F.col("delta")
    cost, spent = _plus(se, epsilon).cast("double"), _plus(sd, delta).cast("double")
    if method == ADVANCED:
        cost = F.least(cost, advanced_epsilon(k + 1, F.greatest(me, epsilon), delta_prime))
        spent = F.when(slack, F.coalesce(spent, F.lit(0.0)) + delta_prime).otherwise(spent)
    return fits(cost, spent, F.col("total_epsilon"), F.col("total_delta"))


def _bounds() -> list[Column]:
    """What ``_slack`` asks of the requests that wait."""
    return [F.min("epsilon").alias("_least"), F.max("epsilon").alias("_most"), F.count(F.lit(1)).alias("_n")]


def _slack(k: Column, se: Column, me: Column, method: str, delta_prime: float) -> Column:
    """Whether the tighter epsilon, and with it ``delta_prime``, is taken at every request
    to come, whichever of the waiting ones are admitted.

    After j more of them the plain sum is at least se + j * least, the tighter epsilon at most
    that of k + j requests of the largest epsilon, of those admitted too. Their distance is concave in j.
    """
    if method != ADVANCED:
        return F.lit(False)
    least, most = F.col("_least"), F.greatest(F.col("_most"), me)
    slope = least - most * (F.exp(most) - 1)
    turn = F.pow(F.try_divide(most * math.sqrt(2 * math.log(1 / delta_prime)), 2 * slope), 2)
    last = k + F.col("_n")
    at = F.when(slope > 0, F.greatest(F.least(turn, last), k + 1)).otherwise(last)
    gain = advanced_epsilon(at, most, delta_prime) * (1 + 1e-9) - (at - k) * least
    return F.coalesce(gain < se.cast("double") * (1 - 1e-9), F.lit(False))


def _waiting(queue: DataFrame, states: DataFrame, method: str, delta_prime: float) -> DataFrame:
    """Undecided requests that may still be admitted, with ``start``: the place of
    the first that fits right now. A refusal changes nothing, so all before it are refused."""
    sums = [F.col(c) for c in _SUMS]
    pending = queue.join(states.drop("spans"), "dataset").where(
        (F.col("_at") > F.col("done")) & _may_fit(*sums[:4], F.col("slack"), method, delta_prime)
    )
    k, se, me, sd, md = sums
    eps, delta = F.col("epsilon"), F.col("delta")
    cost, cost_delta = _composed(
        F.lit(method), k + 1, _plus(se, eps).cast("double"), F.greatest(me, eps),
        _plus(sd, delta).cast("double"), F.greatest(md, delta), delta_prime,
    )
    ok = fits(cost, cost_delta, F.col("total_epsilon"), F.col("total_delta"))
    firsts = pending.where(ok).groupBy("dataset").agg(F.min("_at").alias("start"))
    return pending.select("dataset", "epsilon", "delta", "_at").join(firsts, "dataset").where("_at >= start")


def _costs() -> dict[str, Column]:
    """What requests add to the sums: the composition monoid."""
    return {
        "k": F.lit(1).cast("bigint"), "se": F.col("epsilon").cast(EXACT), "me": F.col("epsilon"),
        "sd": F.col("delta").cast(EXACT), "md": F.col("delta"),
    }


_MERGE = {"k": F.sum, "se": F.sum, "me": F.max, "sd": F.sum, "md": F.max}


def _merged(rows: DataFrame, by: list[str]) -> DataFrame:
    """The sums of the requests of each group."""
    kinds = {"k": "bigint", "se": EXACT, "me": "double", "sd": EXACT, "md": "double"}
    return rows.groupBy(*by).agg(*[_MERGE[c](cost).cast(kinds[c]).alias(c) for c, cost in _costs().items()])


def _joined(*parts: dict[str, Column]) -> dict[str, Column]:
    """Sums over disjoint stretches of requests; a missing stretch is null."""
    out = {}
    for name in _SUMS:
        values = [p[name] for p in parts]
        if name in ("me", "md"):
            out[name] = F.greatest(*values)
        elif name == "k":
            out[name] = sum((F.coalesce(v, F.lit(0)) for v in values[1:]), F.coalesce(values[0], F.lit(0)))
        else:
            total = values[0]
            for value in values[1:]:
                total = _plus(total, value)
            out[name] = total
    return out


def _admit_in_bulk(waiting: DataFrame, states: DataFrame, method: str, delta_prime: float) -> DataFrame:
    """States after admitting, per dataset, all waiting requests before the first
    that does not fit with all before it."""
    part = F.shiftright("_at", 33).alias("part")
    rows = waiting.select("dataset", "epsilon", "delta", "_at", "start", part)
    now = states.select("dataset", "total_epsilon", "total_delta", *[F.col(c).alias(f"now_{c}") for c in _SUMS])
    mine = {c: F.col(f"now_{c}") for c in _SUMS}
    earlier = W.partitionBy("dataset").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # one row per dataset and part of the order
    parts = _merged(rows, ["dataset", "part"]).select("*", *[f(c).over(earlier).alias(f"_{c}") for c, f in _MERGE.items()])
    before = {c: F.col(f"_{c}") for c in _SUMS}
    ends = _joined(mine, before, {c: F.col(c) for c in _SUMS})
    safe = _holds(ends, method, delta_prime, whole=True)
    unsafe = parts.join(now, "dataset").where(~safe).select("dataset", "part", *before.values())
    first = W.partitionBy("dataset").orderBy("part")
    if method == BASIC:
        # costs only grow: the first misfit is in the first such part
        unsafe = unsafe.withColumn("_turn", F.row_number().over(first)).where("_turn = 1").drop("_turn")
    suspects = materialize(unsafe)
    inside = W.partitionBy("dataset", "part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    costs = _costs()
    scanned = rows.join(suspects, ["dataset", "part"]).withColumns({f"in_{c}": f(costs[c]).over(inside) for c, f in _MERGE.items()})
    reached = _joined(mine, before, {c: F.col(f"in_{c}") for c in _SUMS})
    misfits = scanned.join(now, "dataset").where(~_holds(reached, method, delta_prime))
    stops = materialize(misfits.groupBy("dataset").agg(F.min("_at").alias("stop")))
    admitted = rows.join(stops, "dataset", "left").where("stop is null or _at < stop").drop("stop")
    gained = _merged(admitted, ["dataset"]).withColumnsRenamed({c: f"new_{c}" for c in _SUMS})
    starts = rows.groupBy("dataset").agg(F.first("start").alias("start"), *_bounds())
    joined = states.join(starts, "dataset", "left").join(gained, "dataset", "left").join(stops, "dataset", "left")
    total = _joined({c: F.col(c) for c in _SUMS}, {c: F.col(f"new_{c}") for c in _SUMS})
    until = F.coalesce("stop", F.lit((1 << 63) - 1))
    moved = F.col("start").isNotNull()
    span = F.struct("start", until.alias("until"), "k", "se", "me", "sd", "slack")
    return joined.select(
        "dataset", "total_epsilon", "total_delta",
        *[F.when(moved, total[c]).otherwise(F.col(c)).alias(c) for c in _SUMS],
        F.when(moved, until).otherwise(F.col("done")).alias("done"),
        (F.col("slack") | _slack(total["k"], total["se"], total["me"], method, delta_prime)).alias("slack"),
        F.when(moved, F.concat("spans", F.array(span).cast(SPANS))).otherwise(F.col("spans")).alias("spans"),
    )


def _holds(sums: dict[str, Column], method: str, delta_prime: float, whole: bool = False) -> Column:
    """Whether the budget holds the sums; ``whole``: them and those of every shorter
    stretch. Epsilon only grows, but delta falls where the tighter epsilon is not taken."""
    spent = sums["sd"].cast("double")
    epsilon, delta = _composed(F.lit(method), sums["k"], sums["se"].cast("double"), sums["me"], spent, sums["md"], delta_prime)
    if whole and method == ADVANCED:
        delta = F.coalesce(spent, F.lit(0.0)) + delta_prime
    return fits(epsilon, delta, F.col("total_epsilon"), F.col("total_delta"))


def _fold(waiting: DataFrame, states: DataFrame, method: str, delta_prime: float, chunk: int) -> DataFrame:
    """States after deciding the next ``chunk`` requests of every dataset one
    by one, with the places ``taken``."""
    line = W.partitionBy("dataset").orderBy("_at")
    nearest = waiting.withColumn("_line", F.row_number().over(line)).where(F.col("_line") <= chunk)
    queues = nearest.groupBy("dataset").agg(
        F.sort_array(F.collect_list(F.struct("_at", "epsilon", "delta"))).alias("queue")
    )
    start = F.struct(*_SUMS, F.array().cast("array<bigint>").alias("taken"))
    kind = f"struct<k:bigint,se:{EXACT},me:double,sd:{EXACT},md:double,taken:array<bigint>>"

    def step(state: Column, query: Column) -> Column:
        eps, delta = query["epsilon"], query["delta"]
        after = {
            "k": state["k"] + 1,
            "se": _plus(state["se"], eps),
            "me": F.greatest(state["me"], eps),
            "sd": _plus(state["sd"], delta),
            "md": F.greatest(state["md"], delta),
        }
        ok = _holds(after, method, delta_prime)
        taken = F.concat(state["taken"], F.array(query["_at"]))
        moved = F.struct(*[v.alias(c) for c, v in after.items()], taken.alias("taken")).cast(kind)
        return F.when(ok, moved).otherwise(state)

    bounds = waiting.groupBy("dataset").agg(*_bounds())
    decided = states.join(queues, "dataset", "left").join(bounds, "dataset", "left").withColumn(
        "_end", F.when(F.col("queue").isNotNull(), F.aggregate("queue", start.cast(kind), step))
    )
    moved = F.col("_end").isNotNull()
    held = {c: F.when(moved, F.col("_end")[c]).otherwise(F.col(c)) for c in _SUMS}
    return decided.select(
        "dataset", "total_epsilon", "total_delta",
        *[held[c].alias(c) for c in _SUMS],
        F.when(moved, F.element_at("queue", -1)["_at"]).otherwise(F.col("done")).alias("done"),
        (F.col("slack") | _slack(held["k"], held["se"], held["me"], method, delta_prime)).alias("slack"),
        "spans",
        F.coalesce(F.col("_end")["taken"], F.array().cast("array<bigint>")).alias("taken"),
    )


def allocate(ledger: DataFrame, totals: DataFrame, queries: int, equal: bool = True, method: str = BASIC) -> DataFrame:
    """What is left, for ``queries`` future queries: even shares, or all of it
    each (for disjoint parts). Exhausted datasets get zeros."""
    if queries < 1:
        raise ValueError(f"queries must be at least 1, got {queries}")
    share = queries if equal else 1
    exhausted = F.col("remaining_epsilon") <= 0
    return (
        status(ledger, totals, method).where("total_epsilon is not null")
        .select(
            "dataset",
            F.explode(F.sequence(F.lit(1), F.lit(queries))).alias("query_number"),
            F.when(exhausted, 0.0).otherwise(F.col("remaining_epsilon") / share).alias("epsilon"),
            F.when(~exhausted, F.col("remaining_delta") / share).alias("delta"),
        )
    )


def by_column(ledger: DataFrame) -> DataFrame:
    """Basic composition per (dataset, column)."""
    named = ledger.where("column is not null and column <> ''")
    return compose(named, BASIC, ("dataset", "column")).drop("method")


def queries_of(ledger: DataFrame, column: str | None = None, mechanism: str | None = None) -> DataFrame:
    found = ledger
    if column is not None:
        found = found.where(F.col("column") == column)
    if mechanism is not None:
        found = found.where(F.col("mechanism") == mechanism)
    return found


def annul(ledger: DataFrame, query_ids: DataFrame) -> DataFrame:
    """The ledger without the named queries (a table with ``dataset`` and
    ``query_id``): an id of one dataset says nothing about another's."""
    named = query_ids.select("dataset", "query_id").distinct()
    return ledger.join(named, ["dataset", "query_id"], "left_anti")


def release_entries(release: Release, dataset: str, name: str) -> DataFrame:
    """Ledger rows of a release. ``epsilon`` is what one draw costs; where
    every cell is a draw of its own, ``epsilon_composed`` is the honest total
    and ``metadata`` says so."""
    spark = release.source.sparkSession
    rows = [
        (
            f"{dataset}/{name}/{o.column}", dataset, name, o.epsilon, o.delta, o.mechanism, o.column,
            {
                "draws": str(o.draws),
                "epsilon_composed": repr(o.epsilon * (o.draws or 0)),
                "data_dependent_params": str(o.data_dependent).lower(),
            },
        )
        for o in release.outcomes if o.mode == PROTECT and o.epsilon is not None
    ]
    schema = LEDGER_SCHEMA.replace("ts timestamp, ", "")
    return spark.createDataFrame(rows, schema).withColumn("ts", F.current_timestamp()).select(
        "query_id", "dataset", "name", "epsilon", "delta", "mechanism", "column", "ts", "metadata"
    )


def append(ledger_path: str, entries: DataFrame) -> None:
    """Adds rows to the ledger table. One writer at a time."""
    entries.write.mode("append").parquet(ledger_path)
