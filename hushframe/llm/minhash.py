"""Near duplicates by b-bit MinHash with confirmation on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from hushframe.llm.arrays import lowered, mix, prefix_hashes, random_words, range_hashes, text_runs, words
from hushframe.llm.components import components
from hushframe.llm.frames import materialize, per_batch

WORDS = 5
#: Links: intersection * 100 >= PERCENT * union.
PERCENT = 75
#: 64 bands of 6 minima: a pair at 0.75 shares none with probability 4e-6.
BANDS, ROWS = 64, 6
HASHES = BANDS * ROWS
#: Pairs whose estimate is lower are not confirmed: 5.5 standard errors below 0.75.
LEAST_ESTIMATE = 0.56
#: Pairs that would join two components get a second estimate from so many minima with
#: two bits each; those below 5.5 of its standard errors under 0.75 are not confirmed.
LONG_HASHES = 2048
LEAST_LONG_ESTIMATE = 0.687
#: Documents whose ids are sent to the scan of the texts or signatures; more are joined by a shuffle.
SENT_IDS = 1_000_000

_A = (random_words(LONG_HASHES, 5) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (random_words(LONG_HASHES, 6) >> np.uint64(32)).astype(np.uint32)
_CHUNK = 1 << 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    data = lowered(data)
    starts, ends, text = words(data, offsets)
    n = np.bincount(text, minlength=len(offsets) - 1)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(n)
    word = range_hashes(prefix_hashes(data), starts, ends)
    rolled = word[:max(0, len(word) - WORDS + 1)].copy()
    for k in range(1, WORDS):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15)) + word[k:k + len(rolled)]
    rolled = mix(rolled)
    out, first = [], 0
    for count in n:
        if count >= WORDS:
            own = np.sort(rolled[first:first + count - WORDS + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif count:
            whole = np.full(1, count, np.uint64)
            for k in range(first, first + count):
                whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + word[k:k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        first += count
    return out


def minima(shingles: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The least value of each hash function on a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(hashes, 0xFFFFFFFF, np.uint32)
    step = max(1, _CHUNK // hashes)
    for first in range(0, len(x), step):
        hashed = x[first:first + step, None] * _A[:hashes]
        hashed += _B[:hashes]
        np.minimum(out, hashed.min(axis=0), out=out)
    return out


def low_bits(least: np.ndarray, n: int) -> np.ndarray:
    """n bits of each minimum, plane by plane, packed into longs.

    The minima are stirred first: the low bits of a multiplicative hash tell
    two shingles apart alike under every multiplier, which would let the
    agreement by chance of small sets stray from one half.
    """
    x = least ^ (least >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return np.concatenate([np.packbits((x >> np.uint32(k) & np.uint32(1)).astype(np.uint8)) for k in range(n)]).view(np.int64)


_BAND_SALT = random_words(BANDS, 8)


def signature(least: np.ndarray) -> tuple[list[int], list[int]]:
    """Lowest bit of each minimum, packed into longs; one 64-bit key per band."""
    bits = low_bits(least, 1)
    key = _BAND_SALT.copy()
    for row in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return bits.tolist(), key.view(np.int64).tolist()


SIGNED = "row long, doc_id long, n_shingles long, digest binary, bits array<long>, bands array<long>"


def signed(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, digest of the set, packed bits, band keys; nulls for an empty set."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, bits, bands = [], [], [], []
        for _, data, ends in text_runs(batch, "text"):
            for own in shingle_sets(data, ends):
                sizes.append(len(own))
                b, k = signature(minima(own)) if len(own) else (None, None)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                bits.append(b)
                bands.append(k)
        longs = pa.list_(pa.int64())
        columns = [batch.column("row"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, longs), pa.array(bands, longs)]
        return pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_shingles", "digest", "bits", "bands"])

    return per_batch(docs, work, SIGNED)


def estimate(left: str, right: str, hashes: int = HASHES, n: int = 1) -> Column:
    """Similarity from the minima whose n bits are all equal, corrected for
    chance: n bits agree by chance in one of 2^n cases."""
    longs = hashes // 64
    unequal = F.lit(0)
    for i in range(longs):
        apart = F.col(left)[i].bitwiseXOR(F.col(right)[i])
        for k in range(1, n):
            apart = apart.bitwiseOR(F.col(left)[k * longs + i].bitwiseXOR(F.col(right)[k * longs + i]))
        unequal = unequal + F.bit_count(apart)
    return 1 - unequal / (hashes * (1 - 0.5**n))


def long_bits(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(row, long): two bits of LONG_HASHES minima of the rows named. The first
    HASHES / 64 longs are those of ``signature``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [low_bits(minima(own, LONG_HASHES), 2).tolist() for _, data, ends in text_runs(batch, "text") for own in shingle_sets(data, ends)]
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(packed, pa.list_(pa.int64()))], names=["row", "long"])

    return per_batch(named(docs, ids), work, "row long, long array<long>")


def named(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(row, text) of each row whose key is among ``ids``, written once."""
    few = ids.count() <= SENT_IDS
    return materialize(docs.select("row", "text").join(F.broadcast(ids) if few else ids, "row", "left_semi"))


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    texts = named(docs, materialize(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()))
    first = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        sets = ([s for _, d, e in text_runs(batch, side) for s in shingle_sets(d, e)] for side in ("text_a", "text_b"))
        for x, y in zip(*sets, strict=True):
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return per_batch(both.select("a", "b", "text_a", "text_b"), work, "a long, b long")


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    ends = [found.select(F.col("node").alias(side), F.col("component").alias(f"in_{side}")) for side in "ab"]
    placed = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left")
    return materialize(placed.where(F.coalesce("in_a", "a") != F.coalesce("in_b", "b")).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Each row has a key of its own, so rows without an id or with the same id are
    compared like any other. Rows with equal sets are one class, led by one row. Leaders
    that share a band key are candidates. In the first round every leader is held
    against the hub of each of its keys, the row that meets most others: first
    the hub it shares most keys with, then those that this left in another
    component. In the second round, pairs of a key that are still in different
    components are held against each other, so that no pair of a key stays
    undecided, and groups of copies cost one comparison each. Candidates pass
    the bit estimate first, those of the second round a closer one as well; links
    count only after their full sets were compared.

    Null and empty texts have no set and are linked with nothing. The component's
    id is its smallest doc_id, null if it has none; rows of that id are kept, or
    all rows of a component without ids. With ``row_col``, a column of unique
    longs of a table already written, exactly one row of a component is kept
    (smallest doc_id, null last, then key) and the column is returned as well.
    Empty tables give no rows.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    texts = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts if row_col else materialize(texts)  # keys must stay with their rows
    rows = materialize(signed(texts))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    classes = materialize(rows.where("digest is not null").groupBy("digest").agg(F.min("row").alias("leader"), first.alias("first")))
    # signatures stay where they are: ids of the copies come to them
    copies = materialize(rows.where("digest is not null").select("row").join(classes.select(F.col("leader").alias("row")), "row", "left_anti"))
    few = copies.count() <= SENT_IDS
    leaders = rows.where("digest is not null").select("row", "bits", "bands").join(F.broadcast(copies) if few else copies, "row", "left_anti")
    leaders = leaders if few else materialize(leaders)
    keyed = leaders.select("row", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(keyed.join(shared, "key"))
    # what others are copies of shares keys with more rows than its copies do
    known = members.groupBy("row").agg(F.sum("n").alias("met"))
    ranked = members.join(known, "row").select("key", F.struct("met", (-F.col("row")).alias("first")).alias("rank"))
    hubs = ranked.groupBy("key").agg(F.max("rank").alias("rank")).select("key", (-F.col("rank.first")).alias("a"))
    bits = leaders.select("row", "bits")

    def probable(pairs: DataFrame) -> DataFrame:
        return pairs.join(bits.select(F.col("row").alias("a"), F.col("bits").alias("bits_a")), "a").join(
            bits.select(F.col("row").alias("b"), F.col("bits").alias("bits_b")), "b",
        ).where(estimate("bits_a", "bits_b") >= LEAST_ESTIMATE).drop("bits_a", "bits_b")

    pairs = members.select("key", F.col("row").alias("b")).join(hubs, "key").where("a <> b")
    stars = materialize(probable(pairs.groupBy("a", "b").agg(F.count("*").alias("n"))))
    # each row against the hub it shares most keys with; of the rest only what that left apart
    nearest = stars.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("hub")).select((-F.col("hub.a")).alias("a"), "b")
    links = materialize(confirmed(nearest, texts))
    found = components(links)
    rest = apart(stars.join(nearest, ["a", "b"], "left_anti").select("a", "b"), found)
    if not rest.isEmpty():
        links = materialize(links.union(confirmed(rest, texts)))
        found = components(links)

    placed = members.select("key", "row").join(
        found.withColumnRenamed("node", "row"), "row", "left",
    ).withColumn("component", F.coalesce("component", "row"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    open_ = materialize(placed.join(mixed, "key"))
    own = materialize(open_.groupBy("row").agg(F.collect_list("key").alias("keys")))
    undecided = open_.join(long_bits(texts, own.select("row")).join(own, "row"), "row")
    sides = [undecided.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("row", "component", "long", "keys")]) for side in "ab"]
    # the first longs of the long bits are the bits
    near = (estimate("long_a", "long_b") >= LEAST_ESTIMATE) & (estimate("long_a", "long_b", LONG_HASHES, 2) >= LEAST_LONG_ESTIMATE)
    # a pair that shares several keys, all of them open, is met at the least of them
    once = F.col("key") == F.array_min(F.array_intersect("keys_a", "keys_b"))
    met = sides[0].join(sides[1], "key").where(
        (F.col("row_a") < F.col("row_b")) & (F.col("component_a") != F.col("component_b")) & near & once,
    ).select(F.col("row_a").alias("a"), F.col("row_b").alias("b")).distinct()
    tried = stars.select("a", "b").union(stars.select("b", "a"))
    others = materialize(met.join(tried, ["a", "b"], "left_anti"))
    if not others.isEmpty():
        more = materialize(confirmed(others, texts))
        found = components(links.union(more))

    placed = materialize(classes.join(found.withColumnRenamed("node", "leader"), "leader", "left").select(
        "digest", "first", F.coalesce("component", "leader").alias("component"),
    ))
    firsts = placed.groupBy("component").agg(F.min("first").alias("first"))
    reached = materialize(placed.select("digest", "component").join(firsts, "component").select(
        "digest", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("keep_row"),
    ))
    alone = F.col("keep_row").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    kept = alone | F.coalesce(F.col("doc_id") == component, component.isNull())
    if row_col:
        kept = alone | (F.col("row") == F.col("keep_row"))
    return rows.select("row", "doc_id", "n_shingles", "digest").join(reached, "digest", "left").select(
        *[F.col("row").alias(c) for c in [row_col] if c], "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(kept, F.lit(True)).alias("kept"),
    )
