"""Removal of repeated byte strings by sorting sampled suffixes with prefix hashes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from hushframe.llm.arrays import mix, prefix_hashes, range_hashes, text_runs
from hushframe.llm.frames import materialize, per_batch, small_batches

#: Bytes of a repeated string, and of the grams among which an anchor is chosen.
LENGTH = 400
GRAM = 100
#: Distinct contexts of an anchor that are sorted in one task; more are counted by Spark.
TOGETHER = 8192
#: Window starts of a block in that count.
BLOCK = 32
#: Rows (or list entries) sent to all executors at most; beyond it a shuffle joins them.
SENT = 2_000_000

_PIECE = 1 << 22
_POSITION = 24
_RUN = 1 << 18
_KEY = ["doc", "version"]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    whole = -(-len(values) // width) * width
    padded = np.full(whole, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchors(prefix: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions of the smallest gram hash in some LENGTH-byte window of a text:
    equal windows have their anchor at the same place."""
    width, n = LENGTH - GRAM + 1, int(offsets[-1]) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    chosen = np.zeros(int(offsets[-1]), bool)
    low = np.uint64((1 << _POSITION) - 1)
    for first in range(0, n, _PIECE):
        starts = np.arange(first, min(first + _PIECE, n))
        grams = np.arange(first, starts[-1] + width)
        # equal leading bits: the leftmost, which is the same one in equal windows
        least = _sliding_min(range_hashes(prefix, grams, grams + GRAM) & ~low | (grams - first).astype(np.uint64), width)
        chosen[(least[ends[starts] - starts >= LENGTH] & low).astype(np.int64) + first] = True
    return np.flatnonzero(chosen)


def _anchored(texts: DataFrame) -> DataFrame:
    """(doc, version, pos, gram, context): each anchor, its gram's hash and a digest of
    all bytes that windows around it can hold."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts: list[tuple[np.ndarray, ...]] = []
        for row, data, offsets in text_runs(batch, "text", _RUN):
            prefix = prefix_hashes(data)
            at = anchors(prefix, offsets)
            text = np.searchsorted(offsets, at, "right") - 1
            left = np.minimum(at - offsets[text], LENGTH - GRAM)
            end = np.minimum(offsets[text + 1], at + LENGTH)
            raw = data.tobytes()
            context = np.array([xxhash.xxh3_64_intdigest(raw[p - a:e], a) for p, a, e in zip(at.tolist(), left.tolist(), end.tolist(), strict=True)], np.uint64)
            parts.append((row + text, at - offsets[text], range_hashes(prefix, at, at + GRAM).view(np.int64), context.view(np.int64)))
        rows, *columns = (np.concatenate(c) for c in zip(*parts, strict=True))
        keys = [batch.column(k).take(pa.array(rows)) for k in _KEY]
        return pa.RecordBatch.from_arrays([*keys, *map(pa.array, columns)], names=[*_KEY, "pos", "gram", "context"])

    return per_batch(texts, work, "doc long, version long, pos long, gram long, context long")


def _sent(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def _repeated(data: bytes, starts: np.ndarray, ends: np.ndarray, anchor: np.ndarray, group: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each context data[start:end], the byte ranges (counted from its anchor)
    covered by LENGTH-byte strings that another context of its group holds at
    the same distance from the anchor.

    Every window is a suffix start. Suffixes are ordered by group, distance and
    the polynomial hash of their first LENGTH bytes in a stable merge sort;
    neighbours of equal hash are a match, and the bytes of each run of matches
    with one partner are compared. A false match lets the group be counted by bytes.
    """
    prefix = prefix_hashes(np.frombuffer(data, np.uint8))
    counts = ends - starts - LENGTH + 1
    context = np.repeat(np.arange(len(starts), dtype=np.int32), counts)
    first = np.cumsum(counts) - counts
    start = np.arange(len(context), dtype=np.int32) - np.repeat((first - starts).astype(np.int32), counts)
    place = group[context].astype(np.int32) * np.int32(LENGTH) + (anchor[context] - start).astype(np.int32)  # group and distance
    hashed = range_hashes(prefix, start, start + LENGTH) ^ mix(place.astype(np.uint64))
    order = np.argsort(hashed, kind="stable").astype(np.int32)
    equal = (hashed[order[1:]] == hashed[order[:-1]]) & (place[order[1:]] == place[order[:-1]])
    del hashed, place
    partner = np.full(len(context), -1, np.int32)
    partner[order[:-1][equal]] = order[1:][equal]
    partner[order[1:][equal]] = order[:-1][equal]  # the one before, if there are both
    hits = np.flatnonzero(partner >= 0)
    found: list[list[tuple[int, int]]] = [[] for _ in starts]
    if not len(hits):
        return found
    shift = partner[hits] - hits
    edge = np.flatnonzero((np.diff(hits) != 1) | (np.diff(shift) != 0) | (np.diff(context[hits]) != 0) | (np.diff(context[partner[hits]]) != 0)) + 1
    firsts, lasts = np.r_[0, edge], np.r_[edge, len(hits)] - 1
    false = set()
    for a, b in zip(hits[firsts].tolist(), hits[lasts].tolist(), strict=True):
        i, s, e, p = int(context[a]), int(start[a]), int(start[b]) + LENGTH, int(start[partner[a]])
        if data[s:e] != data[p:p + e - s]:
            false.add(int(group[i]))
        base = int(anchor[i])
        ranges = found[i]
        if ranges and ranges[-1][1] >= s - base:
            ranges[-1] = (ranges[-1][0], e - base)
        else:
            ranges.append((s - base, e - base))
    for g in false:
        members = np.flatnonzero(np.isin(context, np.flatnonzero(group == g)))
        away = {int(w): int(anchor[context[w]] - start[w]) for w in members}
        held = Counter((away[w], data[start[w]:start[w] + LENGTH]) for w in away)
        for i in np.flatnonzero(group == g).tolist():
            found[i] = []
        for w in members:
            if held[away[int(w)], data[start[w]:start[w] + LENGTH]] > 1:
                found[context[w]].append((-away[int(w)], LENGTH - away[int(w)]))
    return found


_SPANS = "doc long, version long, start long, stop long"


def _sorted_groups(contexts: DataFrame) -> DataFrame:
    """Spans of the contexts whose anchor has few enough of them for one task."""

    def spans(table: pa.Table) -> pa.RecordBatch:
        columns = {c: table.column(c).to_numpy() for c in ("doc", "version", "pos", "gram", "left", "copies")}
        pieces = table.column("bytes").to_pylist()
        sizes = np.array([len(p) for p in pieces], np.int64)
        starts = np.cumsum(sizes) - sizes
        found = _repeated(b"".join(pieces), starts, starts + sizes, starts + columns["left"], np.unique(columns["gram"], return_inverse=True)[1])
        rows = [(i, a, b) for i, ranges in enumerate(found) if columns["copies"][i] == 1 for a, b in ranges]
        at = np.array([r[0] for r in rows], np.int64)
        edges = [columns["pos"][at] + np.array([r[k] for r in rows], np.int64) for k in (1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (columns["doc"][at], columns["version"][at], *edges)], names=["doc", "version", "start", "stop"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            gram = table.column("gram").to_numpy()
            borders = np.r_[0, np.flatnonzero(gram[1:] != gram[:-1]) + 1]  # the last group may go on
            done = 0
            while done < borders[-1]:  # some thousand contexts at a time
                upto = borders[max(int(np.searchsorted(borders, done + 1000, "right")) - 1, int(np.searchsorted(borders, done)) + 1)]
                yield spans(table.slice(done, upto - done))
                done = int(upto)
            kept = table.slice(done).combine_chunks()
        if kept is not None and kept.num_rows:
            yield spans(kept)

    return small_batches(contexts).repartition("gram").sortWithinPartitions("gram").mapInArrow(work, _SPANS)


def _counted_groups(contexts: DataFrame) -> DataFrame:
    """Spans of the contexts whose anchor has very many: by counting digests.

    A block is BLOCK neighbouring distances from the anchor. All its windows
    are repeated if the union of their bytes is; none is if the bytes they
    have in common are not. The windows of blocks between are counted one by one.
    """
    contexts = materialize(contexts)
    key = ["doc", "version", "pos"]

    def blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for i, (left, text) in enumerate(zip(batch.column("left").to_pylist(), batch.column("bytes").to_pylist(), strict=True)):
            nearest = max(0, LENGTH - (len(text) - left))
            for block in range(nearest // BLOCK, left // BLOCK + 1):
                near, far = block * BLOCK, block * BLOCK + BLOCK - 1
                whole = near >= nearest and far <= left
                union = xxhash.xxh3_64_intdigest(text[left - far:left - near + LENGTH], block) if whole else None
                common = xxhash.xxh3_64_intdigest(text[max(left - near, 0):left - far + LENGTH], block)
                rows.append((i, block, union, common))
        index, block, union, common = zip(*rows, strict=True)
        signed = [pa.array([None if x is None else x - (1 << 64) if x >> 63 else x for x in c], pa.int64()) for c in (union, common)]
        keys = [batch.column(k).take(pa.array(index, pa.int64())) for k in key]
        return pa.RecordBatch.from_arrays([*keys, pa.array(block, pa.int32()), *signed], names=[*key, "block", "union", "common"])

    cut = materialize(per_batch(contexts.select(*key, "left", "bytes"), blocks, "doc long, version long, pos long, block int, union long, common long"))

    def often(df: DataFrame, column: str) -> DataFrame:
        return materialize(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1").select(column, F.lit(True).alias(f"{column}_often")))

    judged = cut.join(often(cut, "common"), "common").join(often(cut, "union"), "union", "left")
    judged = materialize(judged.select(*key, "block", "union", "common", F.coalesce("union_often", F.lit(False)).alias("all")))
    whole = judged.where("all").select(
        "doc", "version", (F.col("pos") - F.col("block") * BLOCK - (BLOCK - 1)).alias("start"), (F.col("pos") - F.col("block") * BLOCK + LENGTH).alias("stop"),
    )
    open_ = judged.where(~F.col("all"))
    # windows of an open block can also match inside a repeated union: one of each kind is counted with them
    stand_in = judged.where("all").groupBy("union").agg(F.min(F.struct(*key, "block")).alias("one"), F.first("common").alias("common"))
    beside = stand_in.join(materialize(open_.select("common").distinct()), "common").select("one.*")
    between = open_.select(*key, "block").union(beside).groupBy(*key).agg(F.sort_array(F.collect_set("block")).alias("blocks"))

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple[int, int, int]] = []
        for i, (left, text, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("left", "bytes", "blocks")), strict=True)):
            nearest = max(0, LENGTH - (len(text) - left))
            for block in own:
                for far in range(max(block * BLOCK, nearest), min(block * BLOCK + BLOCK - 1, left) + 1):
                    rows.append((i, far, xxhash.xxh3_64_intdigest(text[left - far:left - far + LENGTH], far)))
        index, far, digest = zip(*rows, strict=True)
        keys = [batch.column(k).take(pa.array(index, pa.int64())) for k in key]
        digests = pa.array([x - (1 << 64) if x >> 63 else x for x in digest], pa.int64())
        return pa.RecordBatch.from_arrays([*keys, pa.array(far, pa.int32()), digests], names=[*key, "far", "window"])

    single = materialize(per_batch(
        contexts.select(*key, "left", "bytes").join(between, key), windows, "doc long, version long, pos long, far int, window long",
    ))
    alone = single.join(often(single, "window"), "window").select(
        "doc", "version", (F.col("pos") - F.col("far")).alias("start"), (F.col("pos") - F.col("far") + LENGTH).alias("stop"),
    )
    return whole.union(alone)


def _merged(df: DataFrame) -> DataFrame:
    """``spans`` of each text with overlapping and touching ones joined."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for spans in batch.column("spans").to_pylist():
            joined: list[dict] = []
            for span in sorted(spans, key=lambda s: s["start"]):
                if joined and span["start"] <= joined[-1]["stop"]:
                    joined[-1]["stop"] = max(joined[-1]["stop"], span["stop"])
                else:
                    joined.append(span)
            out.append(joined)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in _KEY), pa.array(out, kind)], names=[*_KEY, "spans"])

    return per_batch(df, work, "doc long, version long, spans array<struct<start:long,stop:long>>")


def _cut_out(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed (maximal ranges of bytes), kept (the other bytes)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, kept = [], [], []
        for data, spans in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            merged: list[list[int]] = []
            for a, b in sorted((max(0, s["start"]), min(len(data), s["stop"])) for s in spans or []):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            edges = [0, *(x for ab in merged for x in ab), len(data)]
            sizes.append(len(data))
            removed.append([{"start": a, "stop": b} for a, b in merged])
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "removed", "kept"])

    return per_batch(df.select("doc_id", "text", "spans"), work, "doc_id long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary")


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", together: int = TOGETHER, sent: int = SENT,
) -> DataFrame:
    """doc_id, n_bytes, removed, kept of each text: every byte covered by a
    LENGTH-byte string that starts anywhere else too is removed.

    Candidate suffixes are sampled: the position of the smallest gram hash of
    any window. Equal windows share it, so only anchors whose gram occurs again
    matter. Anchors with equal digests of all bytes around them are repeated
    with the whole of it. Of the others, and of one of each equal kind, the bytes
    around them meet by gram: up to ``together`` distinct ones are suffix-sorted
    in one task, more are counted block by block. Strings are judged on the
    input; overlapping ones count, also within a text; none crosses texts.

    A null text is empty; texts shorter than LENGTH lose nothing. Repeated rows
    repeat each other's strings. An empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = source.select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.xxhash64("text").alias("version"), "text")
    found = materialize(_anchored(texts.select("doc", "version", "text").where(F.octet_length("text") >= LENGTH)))
    again = materialize(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    candidates = materialize(found.join(_sent(again, again.count(), sent), "gram"))

    kinds = materialize(candidates.groupBy("gram", "context").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "version", "pos")).alias("one")))
    equal = materialize(kinds.where("copies > 1").select("gram", "context"))
    whole = candidates.join(_sent(equal, equal.count(), sent), ["gram", "context"]).select(
        "doc", "version", (F.col("pos") - (LENGTH - GRAM)).alias("start"), (F.col("pos") + LENGTH).alias("stop"),
    )
    mixed = materialize(kinds.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    unlike = materialize(kinds.join(_sent(mixed, mixed.count(), sent), "gram").select("one.*", "gram", "n", "copies"))
    lists = unlike.groupBy(*_KEY).agg(F.collect_list(F.struct("pos", "gram", "n", "copies")).alias("found"))

    def around(x: Column) -> Column:
        left = F.least(x["pos"], F.lit(LENGTH - GRAM))
        size = F.least(left + LENGTH, F.octet_length("text") - x["pos"] + left)
        piece = F.substring(F.col("text").cast("binary"), (x["pos"] - left + 1).cast("int"), size.cast("int"))
        return F.struct(x["pos"].alias("pos"), x["gram"].alias("gram"), x["n"].alias("n"), x["copies"].alias("copies"), left.cast("int").alias("left"), piece.alias("bytes"))

    n_unlike = unlike.count()
    held = texts.drop("doc_id").join(_sent(lists, n_unlike, sent), _KEY)
    contexts = held.select(*_KEY, F.explode(F.transform("found", around)).alias("x")).select(*_KEY, "x.*")
    spans = whole.union(_sorted_groups(contexts.where(F.col("n") <= together).drop("n")))
    if not unlike.where(F.col("n") > together).isEmpty():
        spans = spans.union(_counted_groups(contexts.where(F.col("n") > together).drop("n")))
    by_text = materialize(_merged(spans.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))))
    return _cut_out(texts.join(_sent(by_text, by_text.agg(F.sum(F.size("spans"))).first()[0] or 0, sent), _KEY, "left"))


def digests(cut: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_kept (bytes left), n_spans, kept_sha256 of ``without_repeats``."""
    left = F.octet_length("kept").cast("long")
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - left).alias("n_removed"), left.alias("n_kept"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
