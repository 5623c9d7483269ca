"""Spelling variants: words one edit apart, found through a variable-length gram index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from hushframe.llm.frames import materialize

#: Letters of a run: A-Z, a-z and 00C0-00FF.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a code point, chosen by a hash of document and run.
DAMAGED = 199
#: A word has at least so many code points and occurrences; a form is so many times as frequent.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: A gram that more than this many words hold is told apart by longer grams.
FREQUENT = 64


@dataclass(frozen=True)
class Grams:
    """Gram lengths for pairs whose shorter word has at least ``length`` code points.

    With ``length`` at least twice ``most``, one edit never touches all grams of a
    word: far from the edit stands the first gram or the one that ends the word.
    """

    length: int
    least: int
    most: int


CLASSES = (Grams(6, 2, 3), Grams(8, 3, 4), Grams(10, 4, 5))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """(word, n): lower-cased runs of letters of all texts, some damaged by a rule of their
    document, of at least ``least_length`` code points and ``least_count`` occurrences."""
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    # most runs hold nothing to change, which lower() tells quickly
    lowered = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", UPPER, LOWER))
    hashed = runs.select(lowered.alias("run"), F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), lowered).cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.char_length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % damaged == 0, cut).otherwise(F.col("run"))
    return (
        hashed.select(word.alias("word")).where(F.char_length("word") >= least_length)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)
    )


def _in_class(classes: tuple[Grams, ...]) -> Column:
    """The numbers of the classes a word's pairs can fall into: its own, and that of a word one shorter."""
    def number(length: Column) -> Column:
        return sum((F.when(length >= c.length, 1).otherwise(0) for c in classes), F.lit(-1))

    own, shorter = number(F.col("length")), number(F.col("length") - 1)
    return F.array_distinct(F.filter(F.array(own, shorter), lambda k: k >= 0))


def _of(classes: tuple[Grams, ...], value: str) -> Column:
    """A property of the row's class."""
    return F.get(F.array(*[F.lit(getattr(c, value)) for c in classes]), F.col("class"))


def grams(words: DataFrame, classes: tuple[Grams, ...] = CLASSES, frequent: int = FREQUENT) -> DataFrame:
    """(class, word, length, gram, start, end): each word cut into variable-length grams.

    The dictionary holds every gram of the least length and, up to the longest, each
    gram whose beginning, one code point shorter, stands in more than ``frequent`` words:
    rare grams stay short, frequent ones are told apart. At each place of a word the
    longest gram of the dictionary is taken unless an earlier one reaches as far.
    """
    placed = words.select("word", F.char_length("word").alias("length")).select(
        "word", "length", F.explode(_in_class(classes)).alias("class"),
    ).select("*", F.explode(F.sequence(F.lit(0), F.col("length") - _of(classes, "least"))).alias("start"))
    longest = _of(classes, "most")
    beginnings = placed.select("*", F.explode(F.sequence(
        _of(classes, "least"), F.greatest(_of(classes, "least"), F.least(longest - 1, F.col("length") - F.col("start"))),
    )).alias("size")).withColumn("gram", F.substring("word", F.col("start") + 1, F.col("size")))
    beginnings = materialize(beginnings)
    often = beginnings.groupBy("class", "gram").agg(F.count_distinct("word").alias("words")).where(F.col("words") > frequent).select("class", "gram", F.lit(1).alias("more"))
    # a beginning held by many words goes on by one code point; longer ones are held by fewer
    size = F.max(F.col("size") + F.coalesce("more", F.lit(0)))
    cut = beginnings.join(often, ["class", "gram"], "left").groupBy("class", "word", "length", "start").agg(size.alias("size"))
    cut = cut.withColumn("size", F.least("size", F.col("length") - F.col("start"), longest)).withColumn("end", F.col("start") + F.col("size") - 1)
    earlier = Window.partitionBy("class", "word").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("reached", F.max("end").over(earlier)).where("reached IS NULL OR end > reached").select(
        "class", "word", "length", F.substring("word", F.col("start") + 1, F.col("size")).alias("gram"), "start", "end",
    )


def _affected(spans: str, length: str, longest: Column) -> Column:
    """The most grams that one edit of a word can touch: of the grams before the edit those
    that a longer gram could lengthen up to it, and of those behind it the ones an earlier
    gram could come to cover. An insertion touches no more than a replacement beside it."""
    def touched(at: Column) -> Column:
        left = lambda g: (g["start"] <= at) & (at <= g["start"] + longest - 1)
        right = lambda g: (g["start"] > at) & (g["end"] <= at + longest - 1)
        return F.size(F.filter(spans, lambda g: left(g) | right(g)))

    return F.array_max(F.transform(F.sequence(F.lit(0), F.col(length) - 1), touched))


def near_pairs(words: DataFrame, classes: tuple[Grams, ...] = CLASSES, frequent: int = FREQUENT) -> DataFrame:
    """(a, b) with ``a`` the shorter or smaller word: all pairs of different words one inserted,
    deleted or replaced code point apart. Words shorter than the first class's length are left out.

    A word has m grams of which one edit touches at most t, so two near words share m - t at
    matching places, for either word's m and t. In the order of the lists' lengths the first
    shared gram is then among the first t + 1 of both words: only these enter the lists. Lists
    are split by place and length; pairs that meet are verified on the words.
    """
    pieces = materialize(grams(words, classes, frequent))
    lists = pieces.groupBy("class", "gram").agg(F.count(F.lit(1)).alias("held"))
    ranked = pieces.join(lists, ["class", "gram"]).groupBy("class", "word", "length").agg(
        F.sort_array(F.collect_list(F.struct("held", "gram", "start", "end"))).alias("spans"),
    )
    kept = F.slice("spans", F.lit(1), _affected("spans", "length", _of(classes, "most")) + 1)
    entries = materialize(ranked.select("class", "word", "length", F.explode(kept).alias("g")).select("class", "word", "length", "g.gram", "g.start"))

    own = sum((F.when(F.col("length") >= c.length, 1).otherwise(0) for c in classes), F.lit(-1))
    # a shorter word looks for words as long with the gram in its place, and for longer ones
    # with the gram in its place or one further
    aims = F.explode(F.array(*[F.struct((F.col("length") + d).alias("length"), (F.col("start") + s).alias("start")) for d, s in ((0, 0), (1, 0), (1, 1))]))
    asks = entries.where(own == F.col("class")).select("class", "gram", F.col("word").alias("a"), aims.alias("aim")).select("class", "gram", "a", "aim.length", "aim.start")
    told = entries.withColumnRenamed("word", "b")
    ordered = (F.char_length("a") < F.col("length")) | (F.col("a") < F.col("b"))
    met = asks.join(told, ["class", "gram", "length", "start"]).where(ordered & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word with a form (word, form): the last word along the forms.

    Words point to their form, then to where that points: after r rounds chains of 2^r
    are resolved. Forms are ever more frequent words, so chains end and stay short.
    """
    ends = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        beyond = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(ends.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ends = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return ends


def spelling_variants(words: DataFrame, ratio: int = RATIO, classes: tuple[Grams, ...] = CLASSES, frequent: int = FREQUENT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of ``words`` (word, n).

    ``form`` is the near word of largest n, the smallest by code points among equals, if it
    is at least ``ratio`` times as frequent; ``root`` the last word along the forms. Words
    must be unique and have at least the first class's length; shorter ones stay without near
    words. No words give no rows.
    """
    words = words.select("word", F.col("n").cast("long").alias("n"))
    pairs = near_pairs(words, classes, frequent)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = both.join(counts, "near").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"),
    )
    is_form = -F.col("best.less") >= ratio * F.col("n")
    named = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    ))
    ends = roots(named.where("form IS NOT NULL"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants among the words of ``docs``: ``spelling_variants`` of ``word_counts``.

    Null and empty texts have no words; a null id counts as empty text in the rule that
    damages runs; repeated rows count again. Other columns are not read.
    """
    return spelling_variants(materialize(word_counts(docs, id_col, text_col)))
