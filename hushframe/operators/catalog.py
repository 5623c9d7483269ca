"""Sensitivity of columns, judged by name and by content.

Input is a table of names, so one job judges a whole lake.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hushframe.functions.search import plan_array
from hushframe.operators.name_rules import HIGH_RULES, LOW_RULES, MEDIUM_RULES
from hushframe.operators.ordered import unpivot
from hushframe.operators.profile import text_columns

HIGH, MEDIUM, LOW, UNKNOWN = "high", "medium", "low", "unknown"
LEVEL_ORDER = {LOW: 1, UNKNOWN: 2, MEDIUM: 2, HIGH: 3}


@dataclass(frozen=True)
class NameRules:
    """The rule lists in force; extra rules come after the built-in ones."""

    high: tuple = ()
    medium: tuple = ()
    low: tuple = ()
    default: str = MEDIUM
    overrides: Mapping[str, tuple[str, str]] = field(default_factory=dict)

    def levels(self) -> list[tuple[str, list[tuple[str, str]]]]:
        return [
            (HIGH, [*HIGH_RULES, *self.high]),
            (MEDIUM, [*MEDIUM_RULES, *self.medium]),
            (LOW, [*LOW_RULES, *self.low]),
        ]

    def counts(self) -> dict[str, int]:
        return {level: len(rules) for level, rules in self.levels()}

    def with_override(self, column: str, level: str, reason: str = "Manual override") -> NameRules:
        changed = {**self.overrides, column.lower(): (level, reason)}
        return NameRules(self.high, self.medium, self.low, self.default, changed)

    def without_override(self, column: str) -> NameRules:
        changed = {k: v for k, v in self.overrides.items() if k != column.lower()}
        return NameRules(self.high, self.medium, self.low, self.default, changed)

    def without_overrides(self) -> NameRules:
        return NameRules(self.high, self.medium, self.low, self.default)


def normalized(name: Column) -> Column:
    return F.translate(F.lower(name), "_-", "  ")


def classify(catalog: DataFrame, rules: NameRules = NameRules(), name: str = "column") -> DataFrame:
    """Adds level, confidence, pattern, description, is_override and
    override_reason to a table of names.

    The first rule that matches decides. A level is first tried as one
    alternation, so most names test three patterns; only names that hit walk
    the list. Nothing is shuffled.
    """
    judged = catalog.withColumns({"_norm": normalized(F.col(name)), "_raw": F.col(name)})
    norm, raw = F.col("_norm"), F.col("_raw")
    listed = [(level, p, d) for level, entries in rules.levels() for p, d in entries]
    chosen, start = None, 0
    for _, entries in rules.levels():
        inner = None
        for offset, (pattern, _) in enumerate(entries):
            hit = norm.rlike(f"(?i){pattern}") | raw.rlike(f"(?i){pattern}")
            place = F.lit(start + offset)
            inner = F.when(hit, place) if inner is None else inner.when(hit, place)
        start += len(entries)
        if inner is not None:
            any_rule = "(?i)" + "|".join(f"(?:{pattern})" for pattern, _ in entries)
            some = norm.rlike(any_rule) | raw.rlike(any_rule)
            chosen = F.when(some, inner) if chosen is None else chosen.when(some, inner)
    rule = F.col("_rule")
    pattern = F.get(plan_array([p for _, p, _ in listed], "string"), rule)
    text = F.concat(F.lit("(?i)"), pattern)
    close = F.lit(0.6) + F.length(F.regexp_substr(norm, text)) / F.length(norm) * 0.3
    result = judged.withColumn("_rule", chosen).withColumn("_rule", F.struct(
        F.coalesce(F.get(plan_array([lv for lv, _, _ in listed], "string"), rule), F.lit(rules.default)).alias("level"),
        pattern.alias("pattern"),
        F.coalesce(
            F.get(plan_array([d for _, _, d in listed], "string"), rule),
            F.lit(NO_MATCH),
        ).alias("description"),
        F.when(rule.isNull(), 0.5).when(F.rlike(norm, text), F.least(F.lit(0.9), close))
        .otherwise(0.7).alias("confidence"),
    ))
    override = F.lit(None).cast("struct<level:string,reason:string>")
    if rules.overrides:
        entries = F.create_map(*[
            x for column, (level, reason) in rules.overrides.items()
            for x in (F.lit(column), F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason")))
        ])
        override = entries[F.lower(name)]
    manual = F.col("_override").isNotNull()
    return result.withColumn("_override", override).select(
        *catalog.columns,
        F.when(manual, F.col("_override.level")).otherwise(F.col("_rule.level")).alias("level"),
        F.when(manual, 1.0).otherwise(F.col("_rule.confidence")).alias("confidence"),
        F.when(~manual, F.col("_rule.pattern")).alias("pattern"),
        F.when(~manual, F.col("_rule.description")).alias("description"),
        manual.alias("is_override"),
        F.col("_override.reason").alias("override_reason"),
    )


def catalog_of(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, column, dtype) of some tables."""
    rows = [
        (table, f.name, f.dataType.simpleString()) for table, df in tables.items() for f in df.schema
    ]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table string, column string, dtype string")


def columns_by_level(classified: DataFrame, by: Sequence[str] = ("table",)) -> DataFrame:
    """Columns of each table and level, sorted. A table has few columns."""
    return classified.groupBy(*by, "level").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("column")).alias("columns")
    )


def at_least(classified: DataFrame, level: str) -> DataFrame:
    """The columns at or above a level."""
    rank = F.create_map(*[F.lit(x) for pair in LEVEL_ORDER.items() for x in pair])
    return classified.where(rank[F.col("level")] >= LEVEL_ORDER[level])


# Descriptions, as users' own tools read them.
NO_MATCH = "No pattern match - using default"
CONTENT_FOUND = "Content analysis detected: "

# Whole-value patterns of personal data, in the order tried.
CONTENT_PATTERNS = (
    ("SSN", r"^\d{3}-\d{2}-\d{4}$"),
    ("Phone", r"^\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}$"),
    ("Email", r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"),
    ("ZIP Code", r"^\d{5}(-\d{4})?$"),
    ("Credit Card", r"^\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}$"),
)
CONTENT_SHARE = 0.5
CONTENT_CONFIDENCE = 0.85


def content_type(value: Column) -> Column:
    """The first pattern a value matches, or null."""
    found = None
    for name, pattern in CONTENT_PATTERNS:
        hit = value.rlike(pattern)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found


def content_scan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per text column the share of values of each type over all rows, and the
    detected type: the first that at least half of the values match."""
    columns = list(columns or text_columns(df))
    kind = content_type(F.col("value"))
    seen = (
        unpivot(df, columns, "string").where(F.col("value").isNotNull())
        .select("column", kind.alias("kind"))
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("values"),
            *[F.count_if(F.col("kind") == name).alias(name) for name, _ in CONTENT_PATTERNS],
        )
    )
    detected = None
    for name, _ in CONTENT_PATTERNS:
        hit = F.col(f"`{name}`") >= F.col("values") * CONTENT_SHARE
        detected = F.when(hit, name) if detected is None else detected.when(hit, name)
    return seen.select(
        "column", "values",
        *[F.col(f"`{n}`").alias(n.lower().replace(" ", "_")) for n, _ in CONTENT_PATTERNS],
        detected.alias("detected"),
    )


def content_scan_of(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The scans of several tables, with their name in ``table``."""
    parts = [content_scan(df).select(F.lit(name).alias("table"), "*") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def refine_by_content(classified: DataFrame, scan: DataFrame) -> DataFrame:
    """Raises columns whose content was recognised to HIGH; columns already
    HIGH or set by hand stay as they are. A catalog of several tables (with a
    column ``table``) takes a scan that names its table too."""
    place = [c for c in ("table", "column") if c in classified.columns]
    if missing := set(place) - set(scan.columns):
        raise ValueError(f"the scan lacks {sorted(missing)}")
    hit = (F.col("level") != HIGH) & ~F.col("is_override") & F.col("detected").isNotNull()
    return (
        classified.join(F.broadcast(scan.select(*place, "detected")), place, "left")
        .withColumns({
            "confidence": F.when(hit, CONTENT_CONFIDENCE).otherwise(F.col("confidence")),
            "pattern": F.when(hit, F.concat(F.lit("content:"), "detected")).otherwise(F.col("pattern")),
            "description": F.when(hit, F.concat(F.lit(CONTENT_FOUND), "detected"))
            .otherwise(F.col("description")),
            "level": F.when(hit, HIGH).otherwise(F.col("level")),
        })
        .select(*classified.columns)
    )


def display(classified: DataFrame) -> DataFrame:
    return classified.select(
        "column",
        F.upper("level").alias("sensitivity"),
        F.concat(F.round(F.col("confidence") * 100, 0).cast("int").cast("string"), F.lit("%")).alias("confidence"),
        F.coalesce("description", F.lit("-")).alias("description"),
        F.when(F.col("is_override"), "Yes").otherwise("No").alias("override"),
    )
