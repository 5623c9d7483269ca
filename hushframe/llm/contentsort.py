"""Exact duplicates by sorting contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hushframe.llm.frames import materialize

#: A text that is more than this share of all rows (and more than LEAST_HOT rows) is
#: dealt to several sort keys; there can be no more than 1 / HOT_SHARE such texts.
HOT_SHARE = 0.001
LEAST_HOT = 100
#: Code points of a content that splitters are sampled from; digests order contents that share them.
BEGINNING = 32


def normalised(text: str) -> Column:
    """The text without space and 09-0D; null counts as empty."""
    out = F.coalesce(F.col(text), F.lit(""))
    for space in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def _first() -> Column:
    """Orders rows of a group: most code points, then smallest id, null ids last, then row key."""
    return F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull(), "doc_id", "row"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised contents are. Sampled splitters
    range-partition the contents by their beginning and digest, each partition
    sorts its part externally and a sorted aggregation compares neighbours in full, keeping the row with
    the most code points, then the smallest id. The pieces of a very frequent
    text, dealt to several sort keys, and their documents meet by digest.

    Null texts are empty; empty texts equal each other and texts of white
    space. Rows that share a doc_id are kept or dropped together; a row
    without an id is kept only if its whole group has none. An empty table
    gives no rows.

    With ``row_col``, a column of unique longs, ``kept`` tells rows apart: one row
    of each group stays, whatever ids repeat or are null, and the column is
    returned as well.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    text = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    contents = text.select(
        "row", "doc_id", normalised("text").alias("content"), F.length(F.coalesce("text", F.lit(""))).alias("n_points"),
    ).withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))
    contents = materialize(contents)  # normalised once: it is sampled and sorted below
    digests = contents.select("row", "doc_id", "digest")

    least = max(LEAST_HOT, int(digests.count() * HOT_SHARE))
    hot = digests.groupBy("digest").count().where(F.col("count") > least).select(
        "digest", F.ceil(F.col("count") / least).cast("int").alias("pieces"),
    )
    piece = F.pmod(F.xxhash64("row"), F.coalesce("pieces", F.lit(1))).cast("int").alias("piece")
    # at most 1 / HOT_SHARE rows are broadcast
    # splitters are sampled from beginnings and digests: no whole text comes to the driver
    dealt = [F.substring("content", 1, BEGINNING).alias("beginning"), "digest", piece]
    sorted_ = contents.join(F.broadcast(hot), "digest", "left").select(*dealt, "content", "row", "doc_id", "n_points").repartitionByRange("beginning", "digest", "piece")
    equal = sorted_.groupBy("beginning", "digest", "piece", "content").agg(F.count("*").alias("n"), _first().alias("first"))
    groups = materialize(
        equal.groupBy("digest").agg(F.sum("n").alias("group_size"), F.min("first").alias("first"))
        .select("digest", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row")),
    )
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    if row_col:
        kept = F.col("row") == F.col("keep_row")
    return digests.join(groups, "digest").select(
        *[F.col("row").alias(c) for c in [row_col] if c], "doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"),
    )
