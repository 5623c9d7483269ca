"""The privacy budget ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.operators import ledger
from hushframe.plans.common import r, rounded, table

QUERIES, SQL = {}, {}


def entries(spark, sf):
    """A ledger with one row per order: priorities are datasets."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.cast("string").alias("query_id"), F.col("o_orderpriority").alias("dataset"),
        F.lit("release").alias("name"),
        ((key % 5 + 1) / 100).alias("epsilon"),
        F.when(key % 3 == 0, F.lit(1e-9)).alias("delta"),
        F.when(key % 3 == 0, "gaussian").when(key % 3 == 1, "laplace").otherwise("exponential").alias("mechanism"),
        F.when(key % 4 != 0, F.concat(F.lit("column_"), (key % 4).cast("string"))).alias("column"),
        F.col("o_orderdate").alias("ts"),
    )


ENTRIES = """entries AS (SELECT o_orderkey::VARCHAR AS query_id, o_orderpriority AS dataset, 'release' AS name,
 (o_orderkey % 5 + 1) / 100 AS epsilon, CASE WHEN o_orderkey % 3 = 0 THEN 1e-9::DOUBLE END AS delta,
 CASE o_orderkey % 3 WHEN 0 THEN 'gaussian' WHEN 1 THEN 'laplace' ELSE 'exponential' END AS mechanism,
 CASE WHEN o_orderkey % 4 <> 0 THEN 'column_' || (o_orderkey % 4) END AS "column", o_orderdate AS ts FROM orders)"""


def budgets(spark, sf):
    """Totals per dataset: one pure, one with delta, one unlimited, one tiny."""
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("dataset")).agg(
        F.max("o_orderkey").alias("_m")
    ).select(
        "dataset",
        F.when(F.col("dataset") == "1-URGENT", 20.0).when(F.col("dataset") == "2-HIGH", 1e7)
        .when(F.col("dataset") == "3-MEDIUM", F.lit(None)).when(F.col("dataset") == "4-NOT SPECIFIED", 5.0)
        .otherwise(0.015).alias("total_epsilon"),
        F.when(F.col("dataset") == "1-URGENT", 1e-7).when(F.col("dataset") == "2-HIGH", 1e-2).alias("total_delta"),
    )


BUDGETS = """budgets AS (SELECT DISTINCT o_orderpriority AS dataset,
 CASE o_orderpriority WHEN '1-URGENT' THEN 20.0::DOUBLE WHEN '2-HIGH' THEN 1e7::DOUBLE WHEN '3-MEDIUM' THEN NULL
  WHEN '4-NOT SPECIFIED' THEN 5.0::DOUBLE ELSE 0.015::DOUBLE END AS total_epsilon,
 CASE o_orderpriority WHEN '1-URGENT' THEN 1e-7::DOUBLE WHEN '2-HIGH' THEN 1e-2::DOUBLE END AS total_delta FROM orders)"""

_BASIC = """basic AS (SELECT dataset, count(*) AS query_count, 'basic' AS method, sum(epsilon) AS e, sum(delta) AS d
 FROM entries GROUP BY 1)"""

QUERIES["compose_basic"] = lambda spark, sf: rounded(ledger.compose_basic(entries(spark, sf)), 9)
SQL["compose_basic"] = f"WITH {ENTRIES}, {_BASIC} SELECT dataset, query_count, method, {r('e', 9)} AS epsilon, {r('d', 9)} AS delta FROM basic"

# single requests compose loosely, hundreds of small ones tightly
QUERIES["compose_advanced"] = lambda spark, sf: rounded(ledger.compose_advanced(
    entries(spark, sf).withColumn("epsilon", F.col("epsilon") / 10)).unionByName(ledger.compose_advanced(
        entries(spark, sf).withColumns({"dataset": F.col("column"), "epsilon": F.col("epsilon") * 100})
        .where("dataset is not null"))), 9)
_ADV = """SELECT dataset, count(*) AS k, sum(e) AS s, coalesce(sum(delta), 0) AS d,
 sqrt(2 * count(*) * ln(1e10)) * max(e) + count(*) * max(e) * (exp(max(e)) - 1) AS a FROM"""
SQL["compose_advanced"] = f"""WITH {ENTRIES}, sums AS (
 {_ADV} (SELECT *, epsilon / 10 AS e FROM entries) GROUP BY 1 UNION ALL
 {_ADV} (SELECT * REPLACE ("column" AS dataset), epsilon * 100 AS e FROM entries WHERE "column" IS NOT NULL) GROUP BY 1)
SELECT dataset, k AS query_count, 'advanced' AS method, {r('least(a, s)', 9)} AS epsilon,
 {r('CASE WHEN a < s THEN d + 1e-10 WHEN d > 0 THEN d END', 9)} AS delta FROM sums"""

QUERIES["compose_parallel"] = lambda spark, sf: rounded(ledger.compose_parallel(entries(spark, sf)), 12)
SQL["compose_parallel"] = f"""WITH {ENTRIES} SELECT dataset, count(*) AS query_count, 'parallel' AS method,
 {r('max(epsilon)', 12)} AS epsilon, {r('max(delta)', 12)} AS delta FROM entries GROUP BY 1"""

QUERIES["compose_by_method"] = lambda spark, sf: rounded(ledger.compose(entries(spark, sf).withColumn(
    "method", F.when(F.col("dataset") < "2", "basic").when(F.col("dataset") < "4", "parallel").otherwise("advanced"))), 9)
SQL["compose_by_method"] = f"""WITH {ENTRIES}, s AS (SELECT dataset, count(*) AS k, sum(epsilon) AS s, max(epsilon) AS m,
 sum(delta) AS d, max(delta) AS md, sqrt(2 * count(*) * ln(1e10)) * max(epsilon) + count(*) * max(epsilon) * (exp(max(epsilon)) - 1) AS a
 FROM entries GROUP BY 1)
SELECT dataset, k AS query_count, CASE WHEN dataset < '2' THEN 'basic' WHEN dataset < '4' THEN 'parallel' ELSE 'advanced' END AS method,
 {r("CASE WHEN dataset < '2' THEN s WHEN dataset < '4' THEN m ELSE least(a, s) END", 9)} AS epsilon,
 {r("CASE WHEN dataset < '2' THEN d WHEN dataset < '4' THEN md WHEN a < s THEN d + 1e-10 ELSE d END", 9)} AS delta FROM s"""

QUERIES["ledger_status"] = lambda spark, sf: rounded(ledger.status(entries(spark, sf), budgets(spark, sf)), 9)
_STATUS = """status AS (SELECT b.dataset, total_epsilon, total_delta, query_count, method, e, d,
 greatest(0, total_epsilon - e) AS re, greatest(0, total_delta - coalesce(d, 0)) AS rd FROM budgets b JOIN basic USING (dataset))"""
SQL["ledger_status"] = f"""WITH {ENTRIES}, {BUDGETS}, {_BASIC}, {_STATUS}
SELECT dataset, {r('total_epsilon', 9)} AS total_epsilon, {r('total_delta', 9)} AS total_delta, query_count, method,
 {r('e', 9)} AS consumed_epsilon, {r('d', 9)} AS consumed_delta,
 CASE WHEN total_epsilon IS NOT NULL THEN {r('re', 9)} END AS remaining_epsilon,
 CASE WHEN total_delta IS NOT NULL THEN {r('rd', 9)} END AS remaining_delta,
 {r('CASE WHEN total_epsilon IS NULL OR total_epsilon = 0 THEN 0 ELSE e / total_epsilon END', 9)} AS utilization,
 CASE WHEN total_epsilon IS NULL THEN false ELSE NOT (e <= total_epsilon AND (d IS NULL OR coalesce(d <= total_delta, false))) END AS exceeded
FROM status"""

QUERIES["ledger_summary"] = lambda spark, sf: ledger.summary(entries(spark, sf), budgets(spark, sf))
_TEXT = "CASE WHEN coalesce({d}, 0) = 0 THEN format('ε={{:.4f}}', {e}) ELSE format('ε={{:.4f}}, δ={{:.2e}}', {e}, {d}) END"
SQL["ledger_summary"] = f"""WITH {ENTRIES}, {BUDGETS}, {_BASIC}, {_STATUS}
SELECT dataset, CASE WHEN total_epsilon IS NULL THEN 'unlimited' ELSE {_TEXT.format(e='total_epsilon', d='total_delta')} END AS total_budget,
 {_TEXT.format(e='e', d='d')} AS consumed_budget,
 CASE WHEN total_epsilon IS NULL THEN 'unlimited' ELSE {_TEXT.format(e='re', d='CASE WHEN total_delta IS NOT NULL THEN rd END')} END AS remaining_budget,
 method AS composition_method, query_count,
 format('{{:.1f}}%', CASE WHEN total_epsilon IS NULL THEN 0 ELSE e / total_epsilon * 100 END) AS budget_utilization,
 CASE WHEN total_epsilon IS NULL THEN false ELSE NOT (e <= total_epsilon AND (d IS NULL OR coalesce(d <= total_delta, false))) END AS is_exceeded
FROM status"""


def requests(spark, sf):
    """Requests in date order; epsilons sit between the budget's steps so
    that no decision hangs on the last bit of a sum."""
    return entries(spark, sf).withColumn("epsilon", F.col("epsilon") + 0.0001)


_REQUESTS = "requests AS (SELECT * REPLACE (epsilon + 0.0001 AS epsilon), row_number() OVER (PARTITION BY dataset ORDER BY ts, query_id) AS rn FROM entries)"

QUERIES["ledger_admission"] = lambda spark, sf: ledger.admit(
    requests(spark, sf), budgets(spark, sf), "basic").select("query_id", "dataset", "admitted")
SQL["ledger_admission"] = f"""WITH {ENTRIES}, {BUDGETS}, {_REQUESTS},
queues AS (SELECT dataset, total_epsilon, total_delta,
  list({{'e': epsilon, 'd': delta, 'ids': [query_id]}} ORDER BY rn) AS queue
  FROM requests JOIN budgets USING (dataset) WHERE total_epsilon IS NOT NULL GROUP BY dataset, total_epsilon, total_delta),
folded AS (SELECT dataset, list_reduce(queue, lambda s, q:
  CASE WHEN s.e + q.e <= total_epsilon AND ((s.d IS NULL AND q.d IS NULL)
    OR coalesce(coalesce(s.d, 0) + coalesce(q.d, 0) <= total_delta, false))
  THEN {{'e': s.e + q.e, 'd': CASE WHEN s.d IS NULL AND q.d IS NULL THEN NULL ELSE coalesce(s.d, 0) + coalesce(q.d, 0) END,
         'ids': list_concat(s.ids, q.ids)}}
  ELSE s END, {{'e': 0.0::DOUBLE, 'd': NULL::DOUBLE, 'ids': []::VARCHAR[]}}) AS state FROM queues),
taken AS (SELECT dataset, unnest(state.ids) AS query_id FROM folded)
SELECT r.query_id, r.dataset, total_epsilon IS NULL OR t.query_id IS NOT NULL AS admitted
FROM requests r JOIN budgets USING (dataset) LEFT JOIN taken t ON t.query_id = r.query_id AND t.dataset = r.dataset"""

# all requests of a year at one moment: the order within it is that of their ids
QUERIES["ledger_admission_moments"] = lambda spark, sf: ledger.admit(
    requests(spark, sf).withColumn("ts", F.date_trunc("year", "ts")), budgets(spark, sf), "basic").select("query_id", "dataset", "admitted")
SQL["ledger_admission_moments"] = SQL["ledger_admission"].replace("ORDER BY ts, query_id", "ORDER BY date_trunc('year', ts), query_id")

QUERIES["ledger_admission_parallel"] = lambda spark, sf: ledger.admit(
    requests(spark, sf), budgets(spark, sf), "parallel").select("query_id", "dataset", "admitted")
SQL["ledger_admission_parallel"] = f"""WITH {ENTRIES}, {BUDGETS}, {_REQUESTS}
SELECT query_id, dataset, total_epsilon IS NULL OR (epsilon <= total_epsilon AND (delta IS NULL OR coalesce(delta <= total_delta, false))) AS admitted
FROM requests JOIN budgets USING (dataset)"""

QUERIES["ledger_admission_advanced"] = lambda spark, sf: ledger.admit(
    requests(spark, sf).withColumn("epsilon", F.col("epsilon") / 10), budgets(spark, sf), "advanced"
).groupBy("dataset", "admitted").agg(F.count(F.lit(1)).alias("n"))
_K, _M, _S, _D = "(s.k + 1)", "greatest(s.m, q.m)", "(s.e + q.e)", "(coalesce(s.d, 0) + coalesce(q.d, 0))"
_TIGHT = f"(sqrt(2 * {_K} * ln(1e10)) * {_M} + {_K} * {_M} * (exp({_M}) - 1))"
_DELTA = f"(CASE WHEN {_TIGHT} < {_S} THEN {_D} + 1e-10 WHEN {_D} = 0 THEN NULL ELSE {_D} END)"
SQL["ledger_admission_advanced"] = f"""WITH {ENTRIES}, {BUDGETS},
requests AS (SELECT * REPLACE ((epsilon + 0.0001) / 10 AS epsilon), row_number() OVER (PARTITION BY dataset ORDER BY ts, query_id) AS rn FROM entries),
queues AS (SELECT dataset, total_epsilon, total_delta,
  list({{'k': 1::BIGINT, 'e': epsilon::DOUBLE, 'm': epsilon::DOUBLE, 'd': delta::DOUBLE, 'ids': [query_id]}} ORDER BY rn) AS queue
  FROM requests JOIN budgets USING (dataset) WHERE total_epsilon IS NOT NULL GROUP BY dataset, total_epsilon, total_delta),
folded AS (SELECT dataset, list_reduce(queue, lambda s, q:
  CASE WHEN least({_TIGHT}, {_S}) <= total_epsilon AND ({_DELTA} IS NULL OR coalesce({_DELTA} <= total_delta, false))
  THEN {{'k': {_K}, 'e': {_S}, 'm': {_M}, 'd': CASE WHEN s.d IS NULL AND q.d IS NULL THEN NULL ELSE {_D} END, 'ids': list_concat(s.ids, q.ids)}}
  ELSE s END, {{'k': 0::BIGINT, 'e': 0.0::DOUBLE, 'm': 0.0::DOUBLE, 'd': NULL::DOUBLE, 'ids': []::VARCHAR[]}}) AS state FROM queues),
taken AS (SELECT dataset, unnest(state.ids) AS query_id FROM folded)
SELECT r.dataset, total_epsilon IS NULL OR t.query_id IS NOT NULL AS admitted, count(*) AS n
FROM requests r JOIN budgets USING (dataset) LEFT JOIN taken t ON t.query_id = r.query_id AND t.dataset = r.dataset GROUP BY 1, 2"""

QUERIES["ledger_afford"] = lambda spark, sf: ledger.can_afford(
    entries(spark, sf), budgets(spark, sf),
    table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request"), F.col("o_orderpriority").alias("dataset"),
        (F.col("o_totalprice") * 50).alias("epsilon"), F.lit(None).cast("double").alias("delta")),
).select("request", "dataset", "affordable")
SQL["ledger_afford"] = f"""WITH {ENTRIES}, {BUDGETS}, {_BASIC}
SELECT o_orderkey AS request, o_orderpriority AS dataset, total_epsilon IS NULL OR
 (e + o_totalprice * 50 <= total_epsilon AND (d IS NULL OR coalesce(d <= total_delta, false))) AS affordable
FROM orders JOIN budgets b ON b.dataset = o_orderpriority JOIN basic c ON c.dataset = o_orderpriority"""

QUERIES["ledger_allocation"] = lambda spark, sf: rounded(ledger.allocate(
    entries(spark, sf), budgets(spark, sf), 4), 9)
SQL["ledger_allocation"] = f"""WITH {ENTRIES}, {BUDGETS}, {_BASIC}, {_STATUS}
SELECT dataset, i::INTEGER AS query_number, {r('CASE WHEN re <= 0 THEN 0 ELSE re / 4 END', 9)} AS epsilon,
 CASE WHEN re > 0 AND total_delta IS NOT NULL THEN {r('rd / 4', 9)} END AS delta
FROM status, range(1, 5) t(i) WHERE total_epsilon IS NOT NULL"""

QUERIES["ledger_by_column"] = lambda spark, sf: rounded(ledger.by_column(entries(spark, sf)), 9)
SQL["ledger_by_column"] = f"""WITH {ENTRIES} SELECT dataset, "column", count(*) AS query_count, {r('sum(epsilon)', 9)} AS epsilon,
 {r('sum(delta)', 9)} AS delta FROM entries WHERE "column" IS NOT NULL GROUP BY 1, 2"""

QUERIES["ledger_filter"] = lambda spark, sf: rounded(ledger.queries_of(
    entries(spark, sf), "column_1", "laplace").select("query_id", "dataset", "epsilon"), 9)
SQL["ledger_filter"] = f"""WITH {ENTRIES} SELECT query_id, dataset, {r('epsilon', 9)} AS epsilon FROM entries
 WHERE "column" = 'column_1' AND mechanism = 'laplace'"""


def annulled(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").cast("string").alias("query_id"))
    cancelled = entries(spark, sf).join(returned, "query_id", "left_semi")
    return rounded(ledger.compose_basic(ledger.annul(entries(spark, sf), cancelled)), 9)


QUERIES["ledger_annul"] = annulled
SQL["ledger_annul"] = f"""WITH {ENTRIES} SELECT dataset, count(*) AS query_count, 'basic' AS method, {r('sum(epsilon)', 9)} AS epsilon,
 {r('sum(delta)', 9)} AS delta FROM entries WHERE query_id NOT IN (SELECT l_orderkey::VARCHAR FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1"""


def algebra(spark, sf):
    """Budget arithmetic on pairs: each ledger row against its successor rule."""
    rows = entries(spark, sf).withColumns({
        "other_epsilon": F.col("epsilon") * 1.5 - 0.01,
        "other_delta": F.when(F.col("query_id").cast("bigint") % 2 == 0, F.lit(5e-10)),
    })
    e, d, oe, od = (F.col(c) for c in ("epsilon", "delta", "other_epsilon", "other_delta"))
    added = ledger.add_budgets(e, d, oe, od)
    return rounded(rows.select(
        "query_id", added[0].alias("sum_epsilon"), added[1].alias("sum_delta"),
        ledger.fits(oe, od, e, d).alias("other_fits"),
        ledger.strictly_less(oe, od, e, d).alias("other_less"),
        ledger.is_pure(d).alias("is_pure"), ledger.budget_text(e, d).alias("as_text"),
    ), 10)


QUERIES["budget_algebra"] = algebra
SQL["budget_algebra"] = f"""WITH {ENTRIES}, pairs AS (SELECT *, epsilon * 1.5 - 0.01 AS oe,
 CASE WHEN query_id::BIGINT % 2 = 0 THEN 5e-10::DOUBLE END AS od FROM entries)
SELECT query_id, {r('epsilon + oe', 10)} AS sum_epsilon,
 CASE WHEN delta IS NOT NULL OR od IS NOT NULL THEN {r('coalesce(delta, 0) + coalesce(od, 0)', 10)} END AS sum_delta,
 oe <= epsilon AND (od IS NULL OR coalesce(od <= delta, false)) AS other_fits,
 oe <= epsilon AND (od IS NULL OR coalesce(od <= delta, false)) AND (oe < epsilon OR coalesce(od < delta, false)) AS other_less,
 delta IS NULL OR delta = 0 AS is_pure, {_TEXT.format(e='epsilon', d='delta')} AS as_text FROM pairs"""
