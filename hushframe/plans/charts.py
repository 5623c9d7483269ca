"""The tables behind charts and reports."""

from __future__ import annotations

from hushframe.operators import compare, tables
from hushframe.plans.common import RELEASED, orders_pairs, orders_release, r, rounded, table
from hushframe.plans.comparing import CF, GAPPY, LINES, NUMBERS, SHIFT, _gappy, _returned, lineitem_pairs
from hushframe.plans.distances import METRICS, MOVED, TOP_CHANGES, _quantities
from hushframe.sources.readers import preview

QUERIES, SQL = {}, {}

# both sides on their own: nulls are dropped per side
SIDES = f"""{RELEASED},
side_o AS (SELECT price_o AS v, prio_o AS cat FROM released WHERE o_orderkey % 11 <> 0),
side_p AS (SELECT price_p AS v, prio_p AS cat FROM released WHERE o_orderkey % 13 <> 0)"""


def overlay_sql(bins: str, low: str = "(SELECT least((SELECT min(v) FROM side_o), (SELECT min(v) FROM side_p)))",
                high: str = "(SELECT greatest((SELECT max(v) FROM side_o), (SELECT max(v) FROM side_p)))") -> str:
    return f"""b AS (SELECT {low} AS lo, {high} AS hi, {bins} AS k),
v AS (SELECT least(floor((v - lo) / ((hi - lo) / k))::BIGINT + 1, k) AS bin, 1 AS a, 0 AS z FROM side_o, b
 UNION ALL SELECT least(floor((v - lo) / ((hi - lo) / k))::BIGINT + 1, k), 0, 1 FROM side_p, b),
h AS (SELECT i AS bin, lo + (i - 1) * (hi - lo) / k AS bin_low, lo + i * (hi - lo) / k AS bin_high, coalesce(sum(a), 0)::BIGINT AS n_o, coalesce(sum(z), 0)::BIGINT AS n_p
 FROM b CROSS JOIN LATERAL (SELECT unnest(range(1, k::BIGINT + 1)) AS i) LEFT JOIN v ON v.bin = i GROUP BY i, lo, hi, k)
SELECT 'o_totalprice' AS "column", bin, {r('bin_low', 3)} AS bin_low, {r('bin_high', 3)} AS bin_high, n_o, n_p,
 {r('n_o / (sum(n_o) OVER () * (bin_high - bin_low))', 12)} AS density_o, {r('n_p / (sum(n_p) OVER () * (bin_high - bin_low))', 12)} AS density_p FROM h"""


QUERIES["hist_table"] = lambda spark, sf: rounded(tables.histogram_overlay(
    _gappy(spark, sf), ["o_totalprice"]), 12, bin_low=3, bin_high=3)
SQL["hist_table"] = f"WITH {SIDES}, {overlay_sql('50')}"

QUERIES["hist_auto"] = lambda spark, sf: rounded(tables.histogram_auto(
    _gappy(spark, sf), ["o_totalprice"]), 12, bin_low=3, bin_high=3)
SQL["hist_auto"] = f"""WITH {SIDES}, u AS (SELECT v FROM side_o UNION ALL SELECT v FROM side_p),
auto AS (SELECT ceil((max(v) - min(v)) / least(2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / pow(count(*), 1 / 3.0),
 (max(v) - min(v)) / (log2(count(*)) + 1)))::BIGINT AS k FROM u), {overlay_sql('(SELECT k FROM auto)')} QUALIFY n_o + n_p > 0"""

QUERIES["corr_diff_table"] = lambda spark, sf: rounded(tables.correlation_table(
    lineitem_pairs(spark, sf), NUMBERS, threshold=0.005))
SQL["corr_diff_table"] = f"""WITH {LINES}, {SHIFT} SELECT column1, column2, {r('original')} AS original, {r('protected')} AS protected,
 {r('protected - original')} AS difference, abs(protected - original) <= 0.005 AS preserved FROM shift"""

QUERIES["category_bars"] = lambda spark, sf: rounded(tables.category_bars(_returned(spark, sf), top_n=12))
BARS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n_o DESC, value) AS ro,
 row_number() OVER (PARTITION BY "column" ORDER BY n_p DESC, value) AS rp FROM cf),
listed AS (SELECT *, (ro <= {n} AND n_o > 0) AS first FROM ranked WHERE (ro <= {n} AND n_o > 0) OR (rp <= {n} AND n_p > 0)),
placed AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY NOT first, CASE WHEN first THEN ro ELSE rp END) AS place FROM listed)"""
SQL["category_bars"] = f"""WITH {CF}, {BARS.format(n=12)} SELECT "column", place, value, {r('p_o')} AS original, {r('p_p')} AS protected FROM placed WHERE place <= 12"""

QUERIES["category_dashboard"] = lambda spark, sf: rounded(tables.category_dashboard(_returned(spark, sf)))
SQL["category_dashboard"] = f"""WITH {CF}, {BARS.format(n=10)} SELECT "column", place, value, {r('p_o')} AS original, {r('p_p')} AS protected,
 {r('p_p - p_o')} AS difference FROM placed WHERE place <= 10"""

QUERIES["category_shift"] = lambda spark, sf: rounded(tables.category_shift(_returned(spark, sf)))
SQL["category_shift"] = f"""WITH {CF} SELECT "column", rank, value, {r('p_p - p_o')} AS difference FROM ({TOP_CHANGES}) WHERE rank <= 15"""

QUERIES["box_table"] = lambda spark, sf: rounded(tables.box_table(_gappy(spark, sf)), 3)


def _box(side: str) -> str:
    q1, q3 = "quantile_cont(v, 0.25)", "quantile_cont(v, 0.75)"
    return f"""SELECT 'o_totalprice' AS "column", '{'original' if side == 'o' else 'protected'}' AS side, count(*) AS count, {r('min(v)', 3)} AS min, {r(q1, 3)} AS q1, {r('median(v)', 3)} AS median,
 {r(q3, 3)} AS q3, {r('max(v)', 3)} AS max, {r('avg(v)', 3)} AS mean,
 (SELECT {r('min(v)', 3)} FROM side_{side}, (SELECT {q1} AS a, {q3} AS b FROM side_{side}) WHERE v >= a - 1.5 * (b - a)) AS whisker_low,
 (SELECT {r('max(v)', 3)} FROM side_{side}, (SELECT {q1} AS a, {q3} AS b FROM side_{side}) WHERE v <= b + 1.5 * (b - a)) AS whisker_high FROM side_{side}"""


SQL["box_table"] = f"WITH {SIDES} {_box('o')} UNION ALL {_box('p')}"

QUERIES["qq_table"] = lambda spark, sf: rounded(tables.qq_table(_gappy(spark, sf), "o_totalprice"), 3)
SQL["qq_table"] = f"""WITH {SIDES}, m AS (SELECT least((SELECT count(*) FROM side_o), (SELECT count(*) FROM side_p), 1000) AS k),
so AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM side_o),
sp AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM side_p),
points AS (SELECT unnest(range(0, 1000)) AS point),
pos AS (SELECT point, point * ((SELECT max(n) FROM so) - 1.0::DOUBLE) / (k - 1) AS po, point * ((SELECT max(n) FROM sp) - 1.0::DOUBLE) / (k - 1) AS pp FROM points, m WHERE point < k)
SELECT point, {r('a.v + (b.v - a.v) * (po - floor(po))', 3)} AS original, {r('c.v + (d.v - c.v) * (pp - floor(pp))', 3)} AS protected
FROM pos JOIN so a ON a.i = floor(po) JOIN so b ON b.i = least(ceil(po), (SELECT max(i) FROM so))
 JOIN sp c ON c.i = floor(pp) JOIN sp d ON d.i = least(ceil(pp), (SELECT max(i) FROM sp))"""

QUERIES["metric_table"] = lambda spark, sf: rounded(tables.metric_table(
    _gappy(spark, sf), ["o_totalprice"], ["o_orderpriority"]), 3)
SQL["metric_table"] = f"""WITH {METRICS} SELECT "column", metric, {r('value', 3)} AS value FROM metrics
UNION ALL SELECT 'o_totalprice', unnest(['mae', 'rmse']), unnest([{r('avg(abs(price_p - price_o))', 3)}, {r('sqrt(avg(pow(price_p - price_o, 2)))', 3)}]) FROM known"""

QUERIES["scatter_bins"] = lambda spark, sf: tables.scatter_bins(_quantities(spark, sf), "l_quantity", "l_extendedprice", 20)
_BIN = "least(floor(({v} - {v}_lo) / (({v}_hi - {v}_lo) / 20))::BIGINT + 1, 20)"
SQL["scatter_bins"] = f"""WITH {MOVED}, both_sides AS (SELECT 'original' AS side, quantity_o AS x, extendedprice_o AS y FROM moved
 UNION ALL SELECT 'protected', quantity_p, extendedprice_p FROM moved),
rng AS (SELECT min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi FROM both_sides)
SELECT side, {_BIN.format(v='x')} AS x_bin, {_BIN.format(v='y')} AS y_bin, count(*) AS n FROM both_sides, rng GROUP BY 1, 2, 3"""

QUERIES["numeric_dashboard"] = lambda spark, sf: rounded(tables.numeric_dashboard(_gappy(spark, sf)), 3)
_STATS = {"mean": "avg({})", "std": "stddev_samp({})", "median": "median({})", "min": "min({})", "max": "max({})"}
SQL["numeric_dashboard"] = f"WITH {GAPPY} " + "\nUNION ALL\n".join(
    f"""SELECT 'o_totalprice' AS "column", '{s}' AS statistic, {r(e.format('price_o'), 3)} AS original, {r(e.format('price_p'), 3)} AS protected,
 {r(e.format('price_p') + ' - ' + e.format('price_o'), 3)} AS difference FROM known""" for s, e in _STATS.items())


def report(spark, sf):
    release = orders_release(spark, sf, unique_key=True)
    return rounded(tables.report_summary(release, compare.compare_columns(orders_pairs(spark, sf))), 3)


QUERIES["report_summary"] = report
SQL["report_summary"] = f"""WITH {RELEASED} SELECT count(*) AS row_count, 6::BIGINT AS column_count, 3::BIGINT AS protect_columns, 2::BIGINT AS passthrough_columns,
 1::BIGINT AS exclude_columns, 3.0::DOUBLE AS total_epsilon, 'Moderate privacy protection' AS privacy_level,
 {r('avg(abs(price_p - price_o))', 3)} AS mean_mae, {r('avg((prio_o <> prio_p)::INT)', 3)} AS mean_drift FROM released"""

QUERIES["report_configuration"] = lambda spark, sf: tables.report_configuration(orders_release(spark, sf, unique_key=True))
SQL["report_configuration"] = """SELECT * FROM (VALUES ('o_orderkey', 'Passthrough', '—', '—'), ('o_custkey', 'Excluded', '—', '—'),
 ('o_orderstatus', 'Passthrough', '—', '—'), ('o_totalprice', 'Protected', '1.00', 'laplace'), ('o_orderdate', 'Protected', '1.00', 'laplace'),
 ('o_orderpriority', 'Protected', '1.00', 'exponential')) t("column", mode, epsilon, mechanism) WHERE EXISTS (SELECT 1 FROM orders)"""

QUERIES["budget_by_column"] = lambda spark, sf: tables.budget_by_column(orders_release(spark, sf, unique_key=True))
SQL["budget_by_column"] = """SELECT unnest(['o_totalprice', 'o_orderdate', 'o_orderpriority']) AS "column", 1.0::DOUBLE AS epsilon
 FROM (SELECT count(*) AS n FROM orders) WHERE n > 0"""

QUERIES["preview"] = lambda spark, sf: preview(table(spark, sf, "orders"), ["o_orderkey"])
SQL["preview"] = "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100"
