"""Quality scores by logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hushframe.llm.arrays import mix, prefix_hashes, range_hashes, text_runs, words
from hushframe.llm.frames import per_batch, sampled

#: Labelled rows that are learnt from at most, and the shards that learn side by side.
ROWS = 24_000
SHARDS = 8
BITS = 18
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.1, 1.0, 0.05, 0.1


def _classes() -> np.ndarray:
    """Byte -> 0 lower, 1 upper, 2 digit, 3 other ASCII, 4 beyond ASCII."""
    kind = np.full(256, 4, np.uint64)
    kind[:128] = 3
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    return kind


_KIND = _classes()


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text number) of every word n-gram: words, pairs of words, and pairs
    of word shapes. A shape tells how a word begins, whether it goes on in
    capitals, which signs end it and whether it repeats one of the two before."""
    starts, ends, text = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = range_hashes(prefix_hashes(data), starts, ends)
    last = data[ends - 1].astype(np.uint64)
    sign = np.where(_KIND[data[ends - 1]] == 3, last, 0)
    before = np.where((ends - starts > 1) & (sign > 0), np.where(_KIND[data[np.maximum(ends - 2, 0)]] == 3, data[np.maximum(ends - 2, 0)], 0), 0).astype(np.uint64)
    second = np.where(ends - starts > 1, _KIND[data[np.minimum(starts + 1, len(data) - 1)]], 5).astype(np.uint64)
    same = np.zeros(len(word), np.uint64)
    for back in (1, 2):
        same[back:] |= ((word[back:] == word[:-back]) & (text[back:] == text[:-back])).astype(np.uint64) << np.uint64(back)
    shape = _KIND[data[starts]] | second << np.uint64(3) | sign << np.uint64(6) | before << np.uint64(14) | same << np.uint64(22)
    pair = np.flatnonzero(text[1:] == text[:-1])
    pairs = mix(word[pair] * np.uint64(3) + word[pair + 1])
    shapes = mix((shape[pair] << np.uint64(25) | shape[pair + 1]) + np.uint64(77))
    slots = np.concatenate([word, pairs, shapes]) >> np.uint64(64 - BITS)
    return slots.astype(np.int64), np.concatenate([text, text[pair], text[pair]])


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sparse dot product of each text's n-gram counts, divided by the root of
        their number, with the weights."""
        slots, text = features(data, offsets)
        n = len(offsets) - 1
        total = np.bincount(text, self.weights[slots], n)
        counted = np.bincount(text, minlength=n)
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.sqrt(np.maximum(counted, 1)), -500, 500)))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (slots, values, label); the bias is a slot without penalty."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        penalty = np.where(at == 1 << BITS, 0, L1)
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - penalty, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for slots, values, label in examples:
            at, x = np.r_[slots, 1 << BITS], np.r_[values, 1.0]
            w = weights(at)
            gradient = (1 / (1 + np.exp(-np.clip(w @ x, -500, 500))) - label) * x
            sigma = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - sigma * w
            n[at] += gradient**2
    w = weights(np.arange((1 << BITS) + 1))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """Learns from labels (doc_id, label 0/1) of texts (doc_id, text).

    At most about ``rows`` labelled texts are used, chosen by a hash of doc_id
    and dealt to SHARDS models that are trained side by side and averaged.
    Null labels, texts or ids teach nothing; of several labels of a document
    the highest counts. Without labels every score is 0.5.
    """
    clean = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = sampled(clean, "doc_id", rows, clean.count())
    shard = F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(SHARDS)).cast("int").alias("shard")
    # the broadcast side is bounded by ``rows``
    examples = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(shard, "doc_id", "text", "label")

    def work(table: pa.Table) -> pa.Table:
        batch = table.sort_by([("doc_id", "ascending"), ("label", "ascending")]).combine_chunks().to_batches()[0]
        label, ready = batch.column("label").to_pylist(), []
        for first, data, ends in text_runs(batch, "text"):
            slots, text = features(data, ends)
            order = np.argsort(text, kind="stable")
            borders = np.searchsorted(text[order], np.arange(len(ends)))
            for i in range(len(ends) - 1):
                own, counts = np.unique(slots[order[borders[i]:borders[i + 1]]], return_counts=True)
                ready.append((own, counts / np.sqrt(max(counts.sum(), 1)), label[first + i]))
        turns = np.random.default_rng(7).permutation(len(ready))
        weights, bias = train([ready[i] for i in turns])
        return pa.table({"weights": pa.array([weights.astype(np.float32).tobytes()], pa.binary()), "bias": [bias], "n": [len(ready)]})

    parts = examples.groupBy("shard").applyInArrow(work, "weights binary, bias double, n long").collect()
    if not parts:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    total = sum(p["n"] for p in parts)
    parts.sort(key=lambda p: p["bias"])  # the same sum in every run
    weights = sum(np.frombuffer(p["weights"], np.float32).astype(np.float64) * (p["n"] / total) for p in parts)
    return Model(weights.astype(np.float32), sum(p["bias"] * p["n"] / total for p in parts))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of each whole text; null and empty texts get the
    score of the bias alone. Repeated rows are scored each."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [model.scores(data, ends) for _, data, ends in text_runs(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(scores))], names=["doc_id", "score"])

    return per_batch(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        work, "doc_id long, score double",
    )
