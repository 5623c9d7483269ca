"""Sensitivity of names and contents, recommendations, configuration checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe.operators import advise, catalog
from hushframe.operators.name_rules import HIGH_RULES, LOW_RULES, MEDIUM_RULES
from hushframe.plans.common import lineitem_with_gaps, r, rounded, table
from hushframe.sources import readers

QUERIES, SQL = {}, {}

STEMS = ("patient", "First", "visit", "record", "bank-account", "event", "salary", "ZIP", "random", "home", "created")
TAILS = ("name", "id", "num", "date", "type", "score", "result", "value", "code", "flag", "sum", "note", "unit")


def names(spark, sf):
    """A catalog derived from customer: one column name per customer, the
    nation is the table."""
    key = F.col("c_custkey")
    pick = lambda words, at: F.get(F.array(*[F.lit(w) for w in words]), (at % len(words)).cast("int"))
    return table(spark, sf, "customer").select(
        F.concat(F.lit("nation_"), F.col("c_nationkey")).alias("table"),
        F.concat(
            pick(STEMS, key), F.lit("_"), pick(TAILS, F.floor(key / 3)),
            F.when(key % 4 == 0, F.concat(F.lit("_"), key % 50)).otherwise(""),
        ).alias("column"),
        key.alias("entry"),
    )


def _words(words, at: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][({at}) % {len(words)} + 1]"


NAMES = f"""names AS (SELECT 'nation_' || c_nationkey AS "table", {_words(STEMS, 'c_custkey')} || '_' || {_words(TAILS, 'c_custkey // 3')}
 || CASE WHEN c_custkey % 4 = 0 THEN '_' || (c_custkey % 50) ELSE '' END AS "column", c_custkey AS entry FROM customer)"""


def _rule_rows(extra=()) -> str:
    rules = [("high", p, d) for p, d in HIGH_RULES] + [("medium", p, d) for p, d in MEDIUM_RULES]
    rules += [("low", p, d) for p, d in LOW_RULES]
    order = {"high": 0, "medium": 1, "low": 2}
    rules = sorted([*rules, *extra], key=lambda x: order[x[0]])
    text = ", ".join(
        "({}, '{}', '{}', '{}')".format(i, level, p.replace("'", "''"), d.replace("'", "''"))
        for i, (level, p, d) in enumerate(rules))
    return f"rules AS (SELECT * FROM (VALUES {text}) t(place, level, pattern, description))"


def _judged(default: str = "medium", extra=()) -> str:
    return f"""{_rule_rows(extra)},
distinct_names AS (SELECT DISTINCT "column" AS name, replace(replace(lower("column"), '_', ' '), '-', ' ') AS norm FROM names),
hits AS (SELECT name, norm, arg_min(struct_pack(level := level, pattern := pattern, description := description, len := length(regexp_extract(norm, '(?i)' || pattern))), place) AS hit
 FROM distinct_names JOIN rules ON regexp_matches(norm, '(?i)' || pattern) OR regexp_matches(name, '(?i)' || pattern) GROUP BY 1, 2),
judged AS (SELECT n."table", n."column", n.entry, coalesce(hit.level, '{default}') AS level,
 CASE WHEN hit IS NULL THEN 0.5 WHEN hit.len > 0 THEN least(0.9, 0.6 + hit.len / length(h.norm)::DOUBLE * 0.3) ELSE 0.7 END AS confidence,
 hit.pattern AS pattern, coalesce(hit.description, 'No pattern match - using default') AS description
 FROM names n LEFT JOIN hits h ON h.name = n."column")"""


QUERIES["classify_columns"] = lambda spark, sf: rounded(catalog.classify(names(spark, sf)))
SQL["classify_columns"] = f"""WITH {NAMES}, {_judged()} SELECT "table", "column", entry, level, {r('confidence')} AS confidence, pattern,
 description, false AS is_override, NULL::VARCHAR AS override_reason FROM judged"""

RULES = catalog.NameRules(
    high=((r"\bhome\b", "Home"),), low=((r"\brandom", "Random value"),), default="unknown",
).with_override("VISIT_TYPE", "high", "asked for").with_override("record_id", "low").with_override(
    "event_sum", "low").without_override("Event_Sum")

QUERIES["classify_overrides"] = lambda spark, sf: rounded(catalog.classify(names(spark, sf), RULES))
_MANUAL = """CASE lower("column") WHEN 'visit_type' THEN 'high' WHEN 'record_id' THEN 'low' END"""
SQL["classify_overrides"] = f"""WITH {NAMES}, {_judged('unknown', [('high', r'\\bhome\\b'.replace(chr(92) * 2, chr(92)), 'Home'), ('low', chr(92) + 'brandom', 'Random value')])}
SELECT "table", "column", entry, coalesce({_MANUAL}, level) AS level, {r(f'CASE WHEN {_MANUAL} IS NOT NULL THEN 1 ELSE confidence END')} AS confidence,
 CASE WHEN {_MANUAL} IS NULL THEN pattern END AS pattern, CASE WHEN {_MANUAL} IS NULL THEN description END AS description,
 {_MANUAL} IS NOT NULL AS is_override, CASE lower("column") WHEN 'visit_type' THEN 'asked for' WHEN 'record_id' THEN 'Manual override' END AS override_reason FROM judged"""

QUERIES["columns_by_level"] = lambda spark, sf: catalog.columns_by_level(catalog.classify(names(spark, sf))).select(
    "table", "level", "n", F.array_join("columns", ",").alias("columns"))
SQL["columns_by_level"] = f"""WITH {NAMES}, {_judged()} SELECT "table", level, count(*) AS n,
 array_to_string(list_sort(list(DISTINCT "column")), ',') AS columns FROM judged GROUP BY 1, 2"""

QUERIES["sensitive_columns"] = lambda spark, sf: catalog.at_least(
    catalog.classify(names(spark, sf), RULES), "medium").select("table", "column", "entry", "level")
SQL["sensitive_columns"] = SQL["classify_overrides"].replace(
    "SELECT \"table\", \"column\", entry, coalesce", "SELECT \"table\", \"column\", entry, level FROM (SELECT \"table\", \"column\", entry, coalesce", 1
) + ") WHERE level IN ('medium', 'unknown', 'high')"

QUERIES["classification_display"] = lambda spark, sf: catalog.display(
    catalog.classify(names(spark, sf), RULES)).groupBy("column", "sensitivity", "description", "override").agg(
    F.count(F.lit(1)).alias("n"))
SQL["classification_display"] = f"""SELECT "column", upper(level) AS sensitivity, coalesce(description, '-') AS description,
 CASE WHEN is_override THEN 'Yes' ELSE 'No' END AS override, count(*) AS n FROM ({SQL['classify_overrides']}) GROUP BY 1, 2, 3, 4"""


def contacts(spark, sf):
    """Columns of personal data made from customer, each with some other text."""
    key = F.col("c_custkey")
    digits = lambda n, m: F.lpad((key * m % 10**n).cast("string"), n, "0")
    other = F.col("c_name")
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.when(key % 10 < 6, F.concat_ws("-", digits(3, 7), digits(2, 3), digits(4, 11))).otherwise(other).alias("col_a"),
        F.when(key % 2 == 0, F.concat(F.lit("("), digits(3, 7), F.lit(") "), digits(3, 3), F.lit("-"), digits(4, 11)))
        .when(key % 5 == 0, F.lit(None)).otherwise(other).alias("col_b"),
        F.concat(F.lower(F.translate("c_name", "#", ".")), F.lit("@mail"), key % 7, F.lit(".example.com")).alias("col_c"),
        F.when(key % 3 > 0, F.concat(digits(5, 13), F.when(key % 4 == 0, F.concat(F.lit("-"), digits(4, 5))).otherwise("")))
        .otherwise(other).alias("col_d"),
        F.concat_ws(" ", digits(4, 3), digits(4, 7), digits(4, 9), digits(4, 11)).alias("col_e"),
        F.when(key % 10 < 4, F.concat_ws("-", digits(3, 7), digits(2, 3), digits(4, 11))).otherwise(other).alias("col_f"),
    )


def _digits(n: int, m: int) -> str:
    return f"lpad((c_custkey * {m} % {10**n})::VARCHAR, {n}, '0')"


_SSN = f"{_digits(3, 7)} || '-' || {_digits(2, 3)} || '-' || {_digits(4, 11)}"
CONTACTS = f"""contacts AS (SELECT c_custkey, CASE WHEN c_custkey % 10 < 6 THEN {_SSN} ELSE c_name END AS col_a,
 CASE WHEN c_custkey % 2 = 0 THEN '(' || {_digits(3, 7)} || ') ' || {_digits(3, 3)} || '-' || {_digits(4, 11)} WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS col_b,
 lower(replace(c_name, '#', '.')) || '@mail' || (c_custkey % 7) || '.example.com' AS col_c,
 CASE WHEN c_custkey % 3 > 0 THEN {_digits(5, 13)} || CASE WHEN c_custkey % 4 = 0 THEN '-' || {_digits(4, 5)} ELSE '' END ELSE c_name END AS col_d,
 {_digits(4, 3)} || ' ' || {_digits(4, 7)} || ' ' || {_digits(4, 9)} || ' ' || {_digits(4, 11)} AS col_e,
 CASE WHEN c_custkey % 10 < 4 THEN {_SSN} ELSE c_name END AS col_f FROM customer)"""
_KIND = "CASE " + " ".join(
    f"WHEN regexp_matches(v, '{p}') THEN '{n}'" for n, p in catalog.CONTENT_PATTERNS) + " END"


def scan_sql(column: str, source: str, expression: str) -> str:
    counts = ", ".join(f"count(*) FILTER (k = '{n}') AS {n.lower().replace(' ', '_')}" for n, _ in catalog.CONTENT_PATTERNS)
    first = "CASE " + " ".join(
        f"WHEN count(*) FILTER (k = '{n}') >= count(*) * 0.5 THEN '{n}'" for n, _ in catalog.CONTENT_PATTERNS) + " END"
    return f"""SELECT '{column}' AS "column", count(*) AS values, {counts}, {first} AS detected
 FROM (SELECT {_KIND} AS k FROM (SELECT {expression} AS v FROM {source}) WHERE v IS NOT NULL)"""


_SCANNED = ["col_a", "col_b", "col_c", "col_d", "col_e", "col_f"]
QUERIES["content_scan"] = lambda spark, sf: catalog.content_scan(contacts(spark, sf), _SCANNED)
SQL["content_scan"] = f"WITH {CONTACTS} " + "\nUNION ALL\n".join(scan_sql(c, "contacts", c) for c in _SCANNED)


def tokens(spark, sf):
    """Every word of every document."""
    return table(spark, sf, "documents").select(F.explode(F.split("text", r"[ \n]+")).alias("token"))


QUERIES["content_scan_tokens"] = lambda spark, sf: catalog.content_scan(tokens(spark, sf))
SQL["content_scan_tokens"] = scan_sql(
    "token", "documents", r"unnest(string_split_regex(text, '[ \n]+'))".replace("\\n", "\n"))


def refined(spark, sf):
    """Two tables with a column of the same name; one of them holds personal data."""
    tables = {"contacts": contacts(spark, sf), "plain": table(spark, sf, "customer").select(F.col("c_name").alias("col_a"))}
    judged = catalog.classify(catalog.catalog_of(tables), catalog.NameRules().with_override("col_e", "low"))
    return catalog.refine_by_content(judged, catalog.content_scan_of(tables)).select(
        "table", "column", "level", "confidence", "pattern", "is_override")


QUERIES["refine_by_content"] = refined
SQL["refine_by_content"] = f"""WITH {CONTACTS}, scan AS ({SQL['content_scan'].split(' ', 1)[1].replace(CONTACTS, '', 1)})
SELECT 'contacts' AS "table", "column", CASE WHEN "column" = 'col_e' THEN 'low' WHEN detected IS NOT NULL THEN 'high' ELSE 'medium' END AS level,
 CASE WHEN "column" = 'col_e' THEN 1.0 WHEN detected IS NOT NULL THEN 0.85 ELSE 0.5 END::DOUBLE AS confidence,
 CASE WHEN "column" <> 'col_e' THEN 'content:' || detected END AS pattern, "column" = 'col_e' AS is_override FROM scan
UNION ALL SELECT 'contacts', 'c_custkey', 'medium', 0.5, NULL, false FROM customer GROUP BY 1
UNION ALL SELECT 'plain', 'col_a', 'medium', 0.5, NULL, false FROM customer GROUP BY 1"""

# --- epsilon ------------------------------------------------------------------

_RANGE = """CASE level WHEN 'high' THEN {h} WHEN 'low' THEN {l} ELSE {m} END::DOUBLE"""
_LOWEST = _RANGE.format(h=0.1, l=2.0, m=0.5)
_HIGHEST = _RANGE.format(h=0.5, l=5.0, m=2.0)
_DEFAULT = _RANGE.format(h=0.3, l=3.0, m=1.0)
_UTILITY = "CASE WHEN (epsilon - epsilon_min) / (epsilon_max - epsilon_min) < 0.33 THEN 'low' WHEN (epsilon - epsilon_min) / (epsilon_max - epsilon_min) > 0.66 THEN 'high' ELSE 'medium' END"


def epsilons(spark, sf):
    judged = catalog.classify(names(spark, sf)).select("entry", "column", "level")
    usual = advise.recommend_epsilon(judged).withColumn("preference", F.lit("none"))
    for prefer in ("privacy", "utility"):
        usual = usual.unionByName(advise.recommend_epsilon(judged, prefer).withColumn("preference", F.lit(prefer)))
    custom = advise.recommend_epsilon(judged, ranges={"low": (4.0, 8.0)}, defaults={"low": 5.0})
    return usual.unionByName(custom.withColumn("preference", F.lit("custom"))).drop("column")


QUERIES["recommend_epsilon"] = epsilons
_EPS = f"""eps AS (SELECT entry, level, {_DEFAULT} AS epsilon, {_LOWEST} AS epsilon_min, {_HIGHEST} AS epsilon_max, 0.8::DOUBLE AS epsilon_confidence, 'none' AS preference FROM judged
UNION ALL SELECT entry, level, {_LOWEST}, {_LOWEST}, {_HIGHEST}, 0.9, 'privacy' FROM judged
UNION ALL SELECT entry, level, {_HIGHEST}, {_LOWEST}, {_HIGHEST}, 0.9, 'utility' FROM judged
UNION ALL SELECT entry, level, CASE WHEN level = 'low' THEN 5.0 ELSE {_DEFAULT} END, CASE WHEN level = 'low' THEN 4.0 ELSE {_LOWEST} END,
 CASE WHEN level = 'low' THEN 8.0 ELSE {_HIGHEST} END, 0.8, 'custom' FROM judged)"""
SQL["recommend_epsilon"] = f"WITH {NAMES}, {_judged()}, {_EPS} SELECT *, {_UTILITY} AS utility FROM eps"


def checked(spark, sf):
    """Proposed epsilons from 0 to 12, one per customer, against the level."""
    judged = catalog.classify(names(spark, sf)).select("entry", "level")
    return advise.check_epsilon(judged.withColumn("epsilon", (F.col("entry") % 97) / 8))


QUERIES["check_epsilon"] = checked
_EFF = "'Warning: Epsilon ' || epsilon::VARCHAR || ' is {side} the recommended range (' || lo::VARCHAR || '–' || hi::VARCHAR || ') for ' || level || ' sensitivity. {effect}'"
SQL["check_epsilon"] = f"""WITH {NAMES}, {_judged()}, asked AS (SELECT entry, level, (entry % 97) / 8.0::DOUBLE AS epsilon, {_LOWEST} AS lo, {_HIGHEST} AS hi FROM judged)
SELECT entry, level, epsilon, epsilon >= 0.01 AND epsilon <= 10 AS is_valid,
 CASE WHEN epsilon < 0.01 THEN 'Epsilon must be at least 0.01' WHEN epsilon > 10 THEN 'Epsilon should not exceed 10.0'
 WHEN epsilon < lo THEN {_EFF.format(side='below', effect='This will add more noise than typical for this sensitivity level.')}
 WHEN epsilon > hi THEN {_EFF.format(side='above', effect='This may not provide adequate privacy protection.')}
 ELSE 'Epsilon is within the recommended range.' END AS message FROM asked"""

# --- mechanisms and whole tables ---------------------------------------------------


def mixed(spark, sf):
    """Columns of every kind, one with many extremes, one all missing."""
    events = table(spark, sf, "events")
    return events.select(
        "event_id", "event_type", F.col("ts").alias("event_time"), F.col("value").alias("income"),
        (F.col("user_id") % 2 == 0).alias("is_even"),
        F.when(F.col("event_id") % 10 == 0, F.col("value") * 1000).otherwise(F.lit(1.0) + F.col("event_id") % 3).alias("score"),
        F.lit(None).cast("double").alias("nothing"),
    )


def _wild(expression: str, source: str = "events") -> str:
    return f"""(SELECT count(*) FILTER (v < a - 3 * (b - a) OR v > b + 3 * (b - a)) > 0.05 * count(v) FROM (SELECT {expression} AS v FROM {source}),
  (SELECT quantile_cont({expression}, 0.25) AS a, quantile_cont({expression}, 0.75) AS b FROM {source}))"""


_SCORE = "CASE WHEN event_id % 10 = 0 THEN value * 1000 ELSE 1.0 + event_id % 3 END"
_NUM = "CASE WHEN {w} THEN 'numeric_unbounded' ELSE 'numeric_bounded' END"
KINDS = f"""kinds AS (SELECT unnest(['event_id', 'event_type', 'event_time', 'income', 'is_even', 'score', 'nothing']) AS "column",
 unnest([{_NUM.format(w=_wild('event_id'))}, 'categorical', 'date', {_NUM.format(w=_wild('value'))}, 'categorical', {_NUM.format(w=_wild(_SCORE))}, 'unknown']) AS kind)"""
_MECH = "CASE kind WHEN 'numeric_unbounded' THEN 'gaussian' WHEN 'categorical' THEN 'exponential' ELSE 'laplace' END"

QUERIES["recommend_mechanism"] = lambda spark, sf: advise.recommend_mechanism(advise.detect_kinds(mixed(spark, sf)))
SQL["recommend_mechanism"] = f"""WITH {KINDS} SELECT "column", kind, {_MECH} AS mechanism,
 CASE WHEN kind = 'numeric_unbounded' THEN 1e-5::DOUBLE END AS delta, CASE WHEN kind = 'unknown' THEN 0.5 ELSE 0.85 END::DOUBLE AS mechanism_confidence FROM kinds"""

_LEVELS = """levels AS (SELECT * FROM (VALUES ('event_id', 'low', 'Event ID'), ('event_type', 'low', 'Type'), ('event_time', 'medium', 'Time'),
 ('income', 'high', 'Income'), ('is_even', 'medium', 'No pattern match - using default'), ('score', 'medium', 'Score'),
 ('nothing', 'medium', 'No pattern match - using default')) t("column", level, description))"""
_ADVISED = f"""advised AS (SELECT "column", level, {_DEFAULT} AS epsilon, {_LOWEST} AS epsilon_min, {_HIGHEST} AS epsilon_max, kind, {_MECH} AS mechanism,
 description FROM kinds JOIN levels USING ("column"))"""

QUERIES["recommend_dataset"] = lambda spark, sf: advise.recommend_dataset(mixed(spark, sf)).select(
    "column", "level", "epsilon", "epsilon_min", "epsilon_max", "utility", "kind", "mechanism", "delta", "explanation")
_DELTA = "CASE WHEN mechanism = 'gaussian' THEN 1e-5::DOUBLE END"
_NL = "chr(10)"
SQL["recommend_dataset"] = f"""WITH {KINDS}, {_LEVELS}, {_ADVISED}
SELECT "column", level, epsilon, epsilon_min, epsilon_max, {_UTILITY} AS utility, kind, mechanism, {_DELTA} AS delta,
 '**Column: ' || "column" || '**' || {_NL} || '**Sensitivity:** ' || upper(level) || ' (detected as: ' || description || ')' || {_NL} ||
 '**Recommended Epsilon:** ' || format('{{:.2f}}', epsilon) || ' (range: ' || epsilon_min || '–' || epsilon_max || ')' || {_NL} ||
 '**Recommended Mechanism:** ' || upper(mechanism[1]) || mechanism[2:] || CASE WHEN mechanism = 'gaussian' THEN ' (δ = 1e-05)' ELSE '' END AS explanation FROM advised"""

QUERIES["recommend_overrides"] = lambda spark, sf: advise.recommend_dataset(mixed(spark, sf), bounded=["score"], overrides={
    "Income": {"epsilon": 0.7}, "EVENT_ID": {"mechanism": "gaussian"}, "is_even": {"level": "high"},
}).select("column", "level", "epsilon", "utility", "kind", "mechanism", "delta", "is_override")
SQL["recommend_overrides"] = f"""WITH {KINDS}, {_LEVELS}, {_ADVISED}
SELECT "column", CASE "column" WHEN 'income' THEN 'medium' WHEN 'event_id' THEN 'medium' WHEN 'is_even' THEN 'high' ELSE level END AS level,
 CASE "column" WHEN 'income' THEN 0.7 WHEN 'event_id' THEN 1.0 WHEN 'is_even' THEN 0.3 ELSE epsilon END::DOUBLE AS epsilon,
 CASE WHEN "column" IN ('income', 'event_id', 'is_even') THEN 'medium' ELSE {_UTILITY} END AS utility,
 CASE WHEN "column" IN ('income', 'event_id', 'is_even') THEN 'unknown' WHEN "column" = 'score' THEN 'numeric_bounded' ELSE kind END AS kind,
 CASE "column" WHEN 'income' THEN 'laplace' WHEN 'event_id' THEN 'gaussian' WHEN 'is_even' THEN 'laplace' WHEN 'score' THEN 'laplace' ELSE mechanism END AS mechanism,
 CASE WHEN "column" = 'event_id' THEN 1e-5::DOUBLE END AS delta, "column" IN ('income', 'event_id', 'is_even') AS is_override FROM advised"""

QUERIES["recommendation_totals"] = lambda spark, sf: rounded(advise.recommendation_totals(
    advise.recommend_dataset(mixed(spark, sf)))).select(
    "total_epsilon", "global_epsilon_suggestion",
    *[F.array_join(c, ",").alias(c) for c in ("high_columns", "laplace_columns", "gaussian_columns", "exponential_columns")])
_LISTED = "coalesce(string_agg(\"column\", ',' ORDER BY \"column\") FILTER ({}), '')"
SQL["recommendation_totals"] = f"""WITH {KINDS}, {_LEVELS}, {_ADVISED} SELECT {r('sum(epsilon)')} AS total_epsilon, {r('avg(epsilon)')} AS global_epsilon_suggestion,
 {_LISTED.format("level = 'high'")} AS high_columns, {_LISTED.format("mechanism = 'laplace'")} AS laplace_columns,
 {_LISTED.format("mechanism = 'gaussian'")} AS gaussian_columns, {_LISTED.format("mechanism = 'exponential'")} AS exponential_columns FROM advised"""

QUERIES["recommendation_display"] = lambda spark, sf: advise.display(advise.recommend_dataset(mixed(spark, sf)))
SQL["recommendation_display"] = f"""WITH {KINDS}, {_LEVELS}, {_ADVISED} SELECT "column", upper(level) AS sensitivity, format('{{:.2f}}', epsilon) AS epsilon,
 upper(mechanism[1]) || mechanism[2:] AS mechanism,
 CASE kind WHEN 'numeric_bounded' THEN 'Numeric Bounded' WHEN 'numeric_unbounded' THEN 'Numeric Unbounded' ELSE upper(kind[1]) || kind[2:] END AS data_type,
 upper({_UTILITY}) AS utility FROM advised"""

QUERIES["recommended_config"] = lambda spark, sf: advise.recommended_config(advise.recommend_dataset(mixed(spark, sf)))
SQL["recommended_config"] = f"""WITH {KINDS}, {_LEVELS}, {_ADVISED} SELECT "column", 'protect' AS mode, epsilon, mechanism, {_DELTA} AS delta, level AS sensitivity FROM advised"""


def configs(spark, sf):
    """One configuration per nation: its customers stand for columns."""
    key = F.col("c_custkey")
    nation = F.col("c_nationkey")
    return table(spark, sf, "customer").select(
        nation.alias("dataset"), F.col("c_name").alias("column"),
        F.when(nation == 3, "exclude").when(nation == 4, "passthrough")
        .when(key % 3 == 0, "passthrough").otherwise("protect").alias("mode"),
        F.when(key % 7 != 0, (key % 40 + 1) / 100 / (nation % 2 * 9 + 1)).alias("epsilon"),
    )


CONFIGS = """configs AS (SELECT c_nationkey AS dataset, c_name AS "column", CASE WHEN c_nationkey = 3 THEN 'exclude' WHEN c_nationkey = 4 THEN 'passthrough'
 WHEN c_custkey % 3 = 0 THEN 'passthrough' ELSE 'protect' END AS mode,
 CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 40 + 1) / 100 / (c_nationkey % 2 * 9 + 1) END AS epsilon FROM customer)"""

QUERIES["config_checks"] = lambda spark, sf: advise.config_checks(configs(spark, sf))
SQL["config_checks"] = f"""WITH {CONFIGS}, s AS (SELECT dataset, count(*) AS n, count(*) FILTER (mode = 'protect') AS p, count(*) FILTER (mode = 'exclude') AS x,
 sum(CASE WHEN mode = 'protect' THEN coalesce(epsilon, 1) END) AS t FROM configs GROUP BY 1)
SELECT dataset, 'warning' AS severity, NULL AS "column", 'no protected column' AS finding FROM s WHERE p = 0
UNION ALL SELECT dataset, 'warning', NULL, 'total epsilon is high' FROM s WHERE t > 10
UNION ALL SELECT dataset, 'error', NULL, 'all columns are excluded' FROM s WHERE n = x
UNION ALL SELECT dataset, 'warning', "column", 'epsilon is very low' FROM configs WHERE mode = 'protect' AND coalesce(epsilon, 1) < 0.1"""


def upload_findings(spark, sf):
    df = lineitem_with_gaps(spark, sf).select(
        "l_quantity", "l_tax", F.when(F.col("l_linenumber") == 7, F.col("l_discount")).alias("rare"),
        F.when(F.col("l_quantity") > 49, F.col("l_returnflag")).alias("sparse"), F.array("l_tax").alias("listed"),
    )
    plain = readers.column_kinds(df.drop("listed"))
    odd = df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("listed").alias("column"), F.lit("unknown").alias("kind"), "rows", F.lit(0).alias("null_count"))
    return advise.upload_checks(plain.select("column", "kind", "rows", "null_count").unionByName(odd))


QUERIES["upload_checks"] = upload_findings
SQL["upload_checks"] = """SELECT 'listed' AS "column", 'warning' AS severity, 'kind not detected' AS finding FROM lineitem GROUP BY 1
UNION ALL SELECT 'rare', 'warning', 'mostly missing' FROM lineitem HAVING count(*) FILTER (l_linenumber <> 7) > 0.9 * count(*)
UNION ALL SELECT 'sparse', 'warning', 'mostly missing' FROM lineitem HAVING count(*) FILTER (l_quantity <= 49 OR l_linenumber = 3) > 0.9 * count(*)
UNION ALL SELECT 'l_tax', 'warning', 'mostly missing' FROM lineitem HAVING count(*) FILTER (l_linenumber = 7) > 0.9 * count(*)"""

QUERIES["recommendation_reasons"] = lambda spark, sf: advise.with_reasons(
    advise.recommend_dataset(mixed(spark, sf))).select("column", "level", "kind", "level_reason", "kind_reason")


def _reasons(reasons, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reasons.items()) + " END"


SQL["recommendation_reasons"] = f"""WITH {KINDS}, {_LEVELS}, {_ADVISED} SELECT "column", level, kind,
 {_reasons(advise.LEVEL_REASONS, 'level')} AS level_reason, {_reasons(advise.KIND_REASONS, 'kind')} AS kind_reason FROM advised"""


def _unnamed(spark, sf):
    """Customers under names that say nothing: mail addresses, phone numbers, a third of them, market segments."""
    key = F.col("c_custkey")
    digits = lambda n: F.lpad((key % 10**n).cast("string"), n, "0")
    return table(spark, sf, "customer").select(
        F.concat(F.regexp_replace(F.lower("c_name"), "[^a-z0-9]", ""), F.lit("@mail.org")).alias("blob_a"),
        F.concat(digits(3), F.lit("-"), digits(3), F.lit("-"), digits(4)).alias("blob_b"),
        F.when(key % 3 == 0, F.concat(digits(3), F.lit("-"), digits(2), F.lit("-"), digits(4))).otherwise(F.col("c_mktsegment")).alias("blob_c"),
        F.col("c_mktsegment").alias("blob_d"), F.col("c_acctbal").alias("blob_e"),
    )


QUERIES["recommend_by_content"] = lambda spark, sf: advise.recommend_dataset(_unnamed(spark, sf), bounded=["blob_e"], analyze_content=True).select(
    "column", "level", "epsilon", "kind", "mechanism", "description", "confidence")
_CONTENT = {"blob_a": ("regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') || '@mail.org'", "Email", r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+$"),
            "blob_b": ("lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')",
                       "Phone", r"^\d{3}-\d{3}-\d{4}$"),
            "blob_c": ("CASE WHEN c_custkey % 3 = 0 THEN lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || '-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') ELSE c_mktsegment END",
                       "SSN", r"^\d{3}-\d{2}-\d{4}$"),
            "blob_d": ("c_mktsegment", "Email", "@"), "blob_e": ("'x'", "Email", "@")}
SQL["recommend_by_content"] = "WITH seen AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{kind}' AS type, avg(regexp_matches({value}, '{pattern}')::INT) >= 0.5 AS hit FROM customer""" for c, (value, kind, pattern) in _CONTENT.items()
) + """) SELECT "column", CASE WHEN hit THEN 'high' ELSE 'medium' END AS level, CASE WHEN hit THEN 0.3 ELSE 1.0 END::DOUBLE AS epsilon,
 CASE "column" WHEN 'blob_e' THEN 'numeric_bounded' ELSE 'categorical' END AS kind, CASE "column" WHEN 'blob_e' THEN 'laplace' ELSE 'exponential' END AS mechanism,
 CASE WHEN hit THEN 'Content analysis detected: ' || type ELSE 'No pattern match - using default' END AS description,
 CASE WHEN hit THEN 0.85 ELSE 0.5 END::DOUBLE AS confidence FROM seen"""
