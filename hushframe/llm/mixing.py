"""Mixing sources to target weights with a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hushframe.llm.frames import materialize

#: Weights of the sources in code point order, repeating; share of all words the mix takes; passes at most.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
#: Slots of a schedule, about: the words of a block follow from it at any size.
SLOTS = 1 << 18
#: Rows of a bucket in which running sums are taken, about, and slots of a chunk.
BUCKET_ROWS = 1024
GOLDEN = 0.6180339887498949

_KEY_BITS = 52


def shuffle_key(doc_id: str, seed: str) -> Column:
    """A number below 2^52 from the id and a seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("long")


def sized(docs: DataFrame, seed: str = "mix", row_col: str | None = None) -> DataFrame:
    """row, doc_id, source, size (words; null text: 0) and the shuffle key of each document."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return docs.select(
        row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"),
    ).withColumn("key", shuffle_key("doc_id", seed))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per source: number, source, source_size, target.

    Sources in code point order, null last, share ``share`` of all words by
    weight. No target exceeds PASSES times its source: what is over goes to
    the others by weight until none is above. In order of limit / weight, level
    k is what a unit of weight gets if the sources before k are full; the
    levels rise up to the answer and fall behind it.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("number", F.row_number().over(by_name) - 1).withColumn("weight", turn)
    fullest = Window.orderBy(F.col("limit") / F.col("weight"), "number")
    everything = Window.partitionBy()
    limit = (PASSES * F.col("source_size")).cast("double")
    levels = ranked.withColumn("limit", limit).withColumn(
        "level",
        (share * F.sum("source_size").over(everything) - (F.sum("limit").over(fullest) - F.col("limit")))
        / F.sum("weight").over(fullest.rowsBetween(0, Window.unboundedFollowing)),
    )
    target = F.least(F.col("limit"), F.col("weight") * F.max("level").over(everything))
    return levels.select("number", "source", "source_size", target.alias("target"))


def _running(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over earlier rows of the group, and
    ``place``, the row's number in its bucket: sums of whole buckets first, then
    sums inside each bucket, so that no group is one task's work."""
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*group).orderBy(bucket)
    bases = materialize(totals.select(*group, bucket, (F.sum("_total").over(earlier) - F.col("_total")).alias("_base")))
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    within = df.withColumn("_in", F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)).withColumn("place", F.row_number().over(inside))
    return within.join(bases, [*group, bucket]).withColumn(name, F.col("_base") + F.col("_in")).drop("_in", "_base")


def schedule(goals: DataFrame, slots: int = SLOTS) -> tuple[DataFrame, int]:
    """(position, number, turn, pass, block, start, words) of each slot, and the words of a block.

    Point i of the golden-ratio sequence falls into one source's stretch of the
    cumulated targets; the i-th slot goes to that source. A source's slots in
    order read its blocks from the first on, and again in a second pass. The
    last slot ends at the whole-number target; if the sequence left a source
    short by a slot or a few, these follow at the end.
    """
    spark = goals.sparkSession
    total = goals.agg(F.sum("target").alias("t"), F.count("*").alias("n")).first()
    words, sources = int(total["t"] or 0), total["n"]
    block = max(1, -(-words // slots))
    n_slots = -(-words // block)
    upto = Window.orderBy("number")
    high = F.sum("target").over(upto) / max(total["t"] or 0.0, 1e-9)
    stretches = goals.withColumn("high", high).withColumn(
        "low", F.coalesce(F.lag("high").over(upto), F.lit(0.0)),
    ).withColumn("high", F.when(F.col("number") == sources - 1, 1.0).otherwise(F.col("high"))).where("high > low")
    cell = F.explode(F.sequence(F.floor(F.col("low") * sources), F.least(F.floor(F.col("high") * sources), F.lit(sources - 1).cast("long"))))
    cells = stretches.select("number", "low", "high", cell.alias("cell"))
    point = (F.col("id") + 0.5) * GOLDEN
    points = spark.range(n_slots).withColumn("point", point - F.floor(point)).withColumn("cell", F.floor(F.col("point") * sources))
    hits = points.join(cells, "cell").where("point >= low and point < high").select(
        F.col("id").alias("position"), "number", F.floor(F.col("id") / BUCKET_ROWS).alias("chunk"), F.lit(1).cast("long").alias("one"),
    )
    dealt = _running(hits, ["number"], "chunk", ["position"], "one", "turn").select("position", "number", "turn")
    dealt = materialize(dealt)

    blocks = F.ceil(F.col("source_size") / block)
    whole = F.floor(F.col("target")).cast("long")
    passes = F.least(F.col("whole"), F.col("source_size")), F.greatest(F.col("whole") - F.col("source_size"), F.lit(0))
    wanted = goals.where("source_size > 0").select("number", "source_size", whole.alias("whole"), blocks.alias("blocks")).withColumn(
        "needed", F.ceil(passes[0] / block) + F.ceil(passes[1] / block),
    )
    counts = dealt.groupBy("number").agg(F.count("*").alias("n"))
    short = wanted.join(counts, "number", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < needed")
    late = short.select("number", "n", F.explode(F.sequence(F.col("n"), F.col("needed") - 1)).alias("turn")).select(
        (F.col("number") + n_slots + (F.col("turn") - F.col("n")) * sources).alias("position"), "number", "turn",
    )
    start = F.col("pass") * F.col("source_size") + F.col("block") * block
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block, F.col("whole") - F.col("start"))
    filled = dealt.unionByName(late).join(wanted, "number").where("turn < needed").withColumns({
        "pass": F.floor(F.col("turn") / F.col("blocks")), "block": F.col("turn") % F.col("blocks"),
    }).withColumn("start", start).withColumn("words", length).where("words > 0")
    return filled.select("position", "number", "turn", "pass", "block", "start", "words"), block


def _laid_out(
    docs: DataFrame, weights: tuple[float, ...], share: float, slots: int, seed: str, row_col: str | None,
) -> tuple[DataFrame, DataFrame, int]:
    """The schedule's slots, the pieces of the documents by (number, block), and the words of a block."""
    sizes = materialize(sized(docs, seed, row_col))
    goals = materialize(targets(sizes, weights, share))
    slot, block = schedule(goals, slots)
    buckets = max(1, sizes.count() // BUCKET_ROWS)
    bucket = F.floor(F.col("key") / float(1 << _KEY_BITS) * buckets)
    numbered = sizes.withColumn("bucket", bucket).join(
        goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")),
    ).drop("source", "_source")
    placed = materialize(_running(numbered, ["number"], "bucket", ["key", "doc_id", "size", "row"], "size", "offset"))

    last = F.floor((F.col("offset") + F.greatest(F.col("size"), F.lit(1)) - 1) / block)
    pieces = placed.select(
        "number", "bucket", "place", "row", "doc_id", "size", "source_size", "target", "offset",
        F.explode(F.sequence(F.floor(F.col("offset") / block), last)).alias("block"),
    )
    return slot, pieces, block


def stream(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, slots: int = SLOTS, seed: str = "mix", row_col: str | None = None,
) -> DataFrame:
    """The mix in its order, as (position, at, doc_id, pass, first, words): of which words of which
    document each slot of the schedule consists, ``at`` being their place within the slot.

    Slots of a source stand where the golden-ratio sequence puts them, so that every stretch of
    the stream holds the sources by their weights. ``mix`` counts what the stream reads: the words of a
    document's rows add up to its ``taken``. Nulls, ties, repeats and empties are those of ``mix``;
    with ``row_col`` the rows carry that column as well.
    """
    slot, pieces, block = _laid_out(docs, weights, share, slots, seed, row_col)
    begin = F.greatest(F.col("offset") - F.col("block") * block, F.lit(0))
    end = F.least(F.col("offset") + F.col("size") - F.col("block") * block, F.col("slot_words"))
    reads = slot.select("position", "number", "block", "pass", F.col("words").alias("slot_words"))
    met = pieces.where("size > 0").join(reads, ["number", "block"]).withColumns({"begin": begin, "end": end}).where("begin < end")
    return met.select(
        *[F.col("row").alias(c) for c in [row_col] if c], "position", F.col("begin").alias("at"), "doc_id", F.col("pass").cast("int").alias("pass"),
        (F.col("block") * block + F.col("begin") - F.col("offset")).alias("first"), (F.col("end") - F.col("begin")).alias("words"),
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, slots: int = SLOTS, seed: str = "mix", row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    The documents of a source stand in an order drawn from (seed, doc_id) and
    are cut into blocks of equal words; the schedule says which blocks the mix
    reads, once or twice. ``taken`` counts a document's words in the slots,
    repeats included; ``copies`` in how many passes the mix begins it. Null and
    empty texts have size 0 and are never taken. A null source is a source.
    Repeated rows are documents of their own; with ``row_col``, a column of unique
    longs that is returned as well, each has its own place among rows of equal
    id and size. Empty tables give no rows.
    """
    slot, pieces, block = _laid_out(docs, weights, share, slots, seed, row_col)
    reads = materialize(slot.groupBy("number", "block").agg(
        F.max(F.when(F.col("pass") == 0, F.col("words")).otherwise(0)).alias("once"),
        F.max(F.when(F.col("pass") == 1, F.col("words")).otherwise(0)).alias("twice"),
    ))

    begin = F.greatest(F.col("offset") - F.col("block") * block, F.lit(0))
    end = F.least(F.col("offset") + F.col("size") - F.col("block") * block, F.lit(block))

    def overlap(words: str) -> Column:
        return F.greatest(F.least(end, F.coalesce(words, F.lit(0))) - begin, F.lit(0))

    def begun(words: str) -> Column:
        starts = (F.col("size") > 0) & (F.col("offset") >= F.col("block") * block)
        return (starts & (begin < F.coalesce(words, F.lit(0)))).cast("int")

    return pieces.join(reads, ["number", "block"], "left").groupBy("number", "bucket", "place", "row", "doc_id").agg(
        F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum(overlap("once") + overlap("twice")).alias("taken"), F.sum(begun("once") + begun("twice")).cast("int").alias("copies"),
    ).select(*[F.col("row").alias(c) for c in [row_col] if c], "doc_id", "size", "source_size", "target", "taken", "copies")
