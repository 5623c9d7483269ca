"""Quality rules per document, and verdicts over hosts from shrunk failure rates."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from hushframe.llm.frames import materialize

#: Space and 09-0D separate words.
GAP = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: A host goes if more than this share of its documents, after shrinking, fails one rule.
HOST_SHARE = 0.5
#: Correlation of documents within a host: the prior weighs (1 - r) / r documents, so 4 to 49.
LEAST_CORRELATION, MOST_CORRELATION = 0.02, 0.2


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(words: Column, hashes: Column) -> Column:
    """Words in the 3-word windows that occur twice or more, from the words and the windows' hashes.

    Windows are sorted by hash and then by their words, so equal ones are neighbours
    whatever hashes collide; the starts of those, in order, cover up to three words each.
    """
    window = lambda h, i: F.struct(
        h.alias("h"), F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"),
    )

    def same(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def repeated(windows: Column) -> Column:
        twice = F.filter(windows, lambda x, k: F.coalesce(same(x, F.get(windows, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(windows, k + 1)), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def length(starts: Column) -> Column:
        return F.aggregate(
            F.transform(starts, lambda p, k: F.coalesce(F.least(F.lit(3), F.get(starts, k + 1) - p), F.lit(3))),
            F.lit(0).cast("long"), lambda total, n: total + n,
        )

    return _let(F.sort_array(F.transform(hashes, window)), lambda windows: _let(repeated(windows), length))


def _repeat_words(words: Column) -> Column:
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    none = F.lit(0).cast("long")
    # windows with as many hashes as there are windows are all different
    counted = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(_covered(words, h)))
    return F.when(n < 3, none).otherwise(counted)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text and with n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words, all from the whole text; a null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counts = _let(F.array_remove(F.split(text, GAP + "+"), ""), lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"),
        _repeat_words(words).alias("n_repeat_words"),
    ))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    line_counts = _let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ))
    return docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != text_col],
        counts.alias("_words"), line_counts.alias("_lines"),
        (F.char_length(text) - F.regexp_count(text, F.lit(GAP))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    ).select("*", "_words.n_words", "_words.n_repeat_words", "_lines.n_lines", "_lines.n_dup_lines").drop("_words", "_lines")


def rules() -> dict[str, Column]:
    """The rules as conditions on the measures; the BASE ones also fail the document itself."""
    n = F.col("n_words")
    return {
        "few_words": n < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    }


BASE = ("few_words", "repeats")


def host_rates(failures: DataFrame, host: str, names: list[str]) -> DataFrame:
    """(host, rule, n, failed, rate): failure rates of each host, shrunk to all hosts.

    ``failures`` holds one boolean column per rule. Rates of hosts are taken as beta
    distributed; mean and within-host correlation come from the moments of the hosts'
    plain rates, weighted by documents, less what sampling of n documents adds to their
    spread. A host with few documents moves to the mean, one with many keeps its own rate.
    """
    sums = failures.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in names],
    )
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r in names])).alias("cell")
    # read by the prior and by the rates: one row per host and rule
    long = materialize(sums.select(host, "n", cells).select(host, "n", "cell.rule", "cell.failed"))
    n, k = F.col("n").cast("double"), F.col("failed")
    moments = long.groupBy("rule").agg(
        F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("all"), (F.sum(k) / F.sum(n)).alias("mean"),
        F.sum(k * k / n).alias("squares"), F.sum(n * n).alias("sizes"),
    )
    m, noise = F.col("mean"), F.col("mean") * (1 - F.col("mean"))
    spread = F.col("squares") / F.col("all") - m * m
    sampling = (F.col("hosts") - 1) / F.col("all")
    shared = 1 - F.col("sizes") / (F.col("all") * F.col("all"))
    between = F.try_divide(spread - noise * sampling, noise * (shared - sampling))
    held = F.least(F.greatest(F.coalesce(between, F.lit(LEAST_CORRELATION)), F.lit(LEAST_CORRELATION)), F.lit(MOST_CORRELATION))
    prior = moments.select("rule", "mean", ((1 - held) / held).alias("weight"))
    rate = (F.col("failed") + m * F.col("weight")) / (F.col("n") + F.col("weight"))
    # one row per rule is broadcast
    return long.join(F.broadcast(prior), "rule").select(host, "rule", "n", "failed", F.round(rate, 9).alias("rate"))


def host_verdicts(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", share: float = HOST_SHARE,
    own: Mapping[str, Column] | None = None, base: tuple[str, ...] = BASE,
) -> DataFrame:
    """``docs`` without its text and with the measures, base_failed, host_failed and kept.

    Each document is judged by the rules (``own`` or ``rules()``). Failures are added up
    by host, the hosts' rates shrunk by an empirical beta prior (``host_rates``), and
    hosts above ``share`` in any rule are rejected: none of their documents is kept.
    A document that fails a rule of ``base`` itself is not kept either.

    A document without a host stands for itself: its own rules decide. A null or empty
    text has no words, so it fails. Repeated rows are documents of their own and all
    judged alike. An empty table gives no rows. Other columns pass through; those
    named like a result are replaced by it.
    """
    conditions = dict(own or rules())
    names = list(conditions)
    taken = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept"}
    passed = [c for c in docs.columns if c != text_col and c.lower() not in taken]
    # the document's own columns travel as one struct: no name of theirs meets one of ours
    carried = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in passed]).alias("row"), F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{text_col}`").alias("text"),
    )
    judged = materialize(measured(carried).select("*", F.struct(*[c.alias(r) for r, c in conditions.items()]).alias("failed")))
    rates = host_rates(judged.select("host", "failed.*"), "host", names)
    rejected = rates.where(F.col("rate") > share).select("host").distinct().withColumn("host_failed", F.lit(True))
    failed_here = F.lit(False)
    for rule in base:
        failed_here = failed_here | F.col(f"failed.{rule}")
    host_failed = F.coalesce("host_failed", F.lit(False))
    return judged.join(rejected, "host", "left").select(
        *[F.col("row").getField(c).alias(c) for c in passed],
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        failed_here.alias("base_failed"), host_failed.alias("host_failed"), (~failed_here & ~host_failed).alias("kept"),
    )


def host_of(url: Column) -> Column:
    """The host of a web address, in lower case and without a leading ``www.``."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
