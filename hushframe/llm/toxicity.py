"""Toxicity by compression distance: zstandard dictionaries of toxic and of
ordinary text, and the length of short windows under each."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from hushframe.llm.arrays import prefix_hashes, range_hashes, text_runs
from hushframe.llm.frames import per_batch, sampled

#: Labelled rows that are learnt from at most. Half of each trains the dictionaries, half the score.
TOXIC_ROWS = 2400
ORDINARY_ROWS = 6000
WINDOW = 128
#: Bytes a window repeats of the one before, so that a word lies whole in one of them, and
#: bytes behind it, since the compressor looks for no match in the last ones.
OVERLAP, PADDING = 12, b"\0" * 8
#: Gains that are counted.
STEPS = (1, 2, 3, 4, 5, 6, 7, 9)
FEATURES = len(STEPS) + 4
ORDINARY_BYTES = 32 * 1024
SAMPLE_WINDOWS = 30_000
TOXIC_BYTES = 768
#: Toxic samples are runs of GRAM-byte strings that no ordinary sample text holds
#: and that at least this share of the toxic texts hold.
GRAM = 6
LEAST_SHARE = 0.03
#: Grams that may pass by chance, all of them together: few texts need more sightings than the share.
CHANCE = 0.1


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Literals stay uncompressed (fast strategy with a target length), so a
    window's length tells what the dictionary matches and little else."""
    raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters(
        compression_level=1, strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=5, window_log=17,
        hash_log=18, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    raw.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=raw, compression_params=settings)


@dataclass
class Model:
    """The toxic dictionary's content follows the ordinary one's in the second
    compressor: a window is shorter there by what toxic text alone explains."""

    ordinary: bytes
    toxic: bytes
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @cached_property
    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return _compressor(self.ordinary), _compressor(self.ordinary + self.toxic)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "compressors"}

    def gains(self, text: bytes) -> np.ndarray:
        """Bytes each window gains by the toxic dictionary."""
        ordinary, toxic = self.compressors
        parts = [text[max(0, i - OVERLAP):i + WINDOW] + PADDING for i in range(0, len(text), WINDOW)]
        return np.array([len(ordinary.compress(p)) - len(toxic.compress(p)) for p in parts])

    def features(self, text: bytes) -> list[float]:
        gains = self.gains(text) if self.toxic and text else np.zeros(1)
        size = np.log(len(gains))
        counts = [np.log1p((gains >= step).sum()) for step in STEPS]
        return [*counts, gains.max(), gains.mean(), size, gains.max() * size]

    def score(self, text: bytes) -> float:
        x = (np.array(self.features(text), float) - self.center) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1:] @ x, -500, 500))))


def _grams(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    starts = np.arange(max(0, len(data) - GRAM + 1))
    return range_hashes(prefix_hashes(data), starts, starts + GRAM)


def _marked_runs(text: bytes, marks: np.ndarray) -> list[bytes]:
    """The stretches of text whose GRAM-byte strings are all marked."""
    edges = np.flatnonzero(np.diff(np.r_[0, marks.astype(np.int8), 0]))
    return [text[a:b + GRAM - 1] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _dictionary(size: int, samples: list[bytes], k: int) -> bytes:
    """Content of a trained dictionary; what there is, if it is too little to train on."""
    try:
        trained = zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zstandard.ZstdError:
        trained = b"".join(samples)
    return trained[-size:]


def _beyond_chance(toxic: int, ordinary: int, grams: int) -> int:
    """In how many toxic texts a gram that no ordinary one holds must be, for less than CHANCE of
    all the grams to get there by chance (Chernoff's bound for half a sighting among the ordinary)."""
    expected = toxic * 0.5 / (ordinary + 1)
    least = np.log(max(grams, 1) / CHANCE)
    n = 1
    while n <= toxic and (n <= expected or n * np.log(n / expected) - n + expected < least):
        n += 1
    return n


def _toxic_samples(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """What toxic texts share and ordinary texts never hold, several runs to a sample."""
    known = np.zeros(0, np.uint64)
    for first in range(0, len(ordinary), 200):
        known = np.union1d(known, np.concatenate([_grams(t) for t in ordinary[first:first + 200]]))
    grams = [_grams(t) for t in toxic]
    held = Counter()
    new = []
    for g in grams:
        at = np.minimum(np.searchsorted(known, g), max(len(known) - 1, 0))
        new.append(known[at] != g if len(known) else np.ones(len(g), bool))
        held.update(np.unique(g[new[-1]]).tolist())
    least = max(2, int(len(toxic) * LEAST_SHARE), _beyond_chance(len(toxic), len(ordinary), len(held)))
    common = np.sort(np.array([g for g, n in held.items() if n >= least], np.uint64))
    runs = []
    for text, g, fresh in zip(toxic, grams, new, strict=True):
        runs += _marked_runs(text, fresh & np.isin(g, common))
    return [b" ".join(runs[i:i + 8]) for i in range(0, len(runs), 8)]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method with a small ridge."""
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - center) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(curve, z.T @ (y - p) - 1e-2 * w)
    return center, scale, w


def learn(texts: list[bytes], labels: list[int]) -> Model:
    """A model of these texts; they are taken in the given order."""
    by_label = [[t for t, y in zip(texts, labels, strict=True) if y == k] for k in (0, 1)]
    (ordinary, held_ordinary), (toxic, held_toxic) = ((x[::2], x[1::2]) for x in by_label)
    upto = np.cumsum([-(-len(t) // WINDOW) for t in ordinary])  # windows of the texts so far
    turns = np.random.default_rng(3).permutation(upto[-1] if len(upto) else 0)[:SAMPLE_WINDOWS]
    windows = []
    for turn in turns:
        text = int(np.searchsorted(upto, turn, "right"))
        start = int(turn - (upto[text - 1] if text else 0)) * WINDOW
        windows.append(ordinary[text][start:start + WINDOW])
    base = _dictionary(ORDINARY_BYTES, windows, 64) if windows else b"-"
    shared = _toxic_samples(toxic, ordinary)
    extra = _dictionary(TOXIC_BYTES, shared, 32) if shared else b""
    model = Model(base, extra, np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1))
    held = [(t, 0) for t in held_ordinary] + [(t, 1) for t in held_toxic]
    if not held_ordinary or not held_toxic:
        share = np.clip(len(held_toxic) / max(len(held), 1), 0.01, 0.99) if held else 0.01
        model.weights[0] = np.log(share / (1 - share))
        return model
    model.center, model.scale, model.weights = _logistic(
        np.array([model.features(t) for t, _ in held], float), np.array([y for _, y in held], float),
    )
    return model


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """Learns from labels (doc_id, label 0/1) of texts (doc_id, text).

    At most about ``toxic_rows`` and ``ordinary_rows`` labelled whole texts are
    used, chosen by a hash of doc_id; this bounded sample is learnt from in
    one task. Null labels, texts or ids teach nothing; of several labels of
    a document the highest counts. Without toxic examples all scores are low.
    """
    clean = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    totals = {r["label"]: r["count"] for r in clean.groupBy("label").count().collect()}
    chosen = sampled(clean.where("label = 1"), "doc_id", toxic_rows, totals.get(1, 0)).unionByName(
        sampled(clean.where("label = 0"), "doc_id", ordinary_rows, totals.get(0, 0)),
    )
    # the broadcast side is bounded by the two row numbers
    examples = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        texts = [t.encode() for t in table.column("text").to_pylist()]
        m = learn(texts, table.column("label").to_pylist())
        return pa.table({
            "ordinary": pa.array([m.ordinary], pa.binary()), "toxic": pa.array([m.toxic], pa.binary()),
            "numbers": pa.array([[*m.center, *m.scale, *m.weights]], pa.list_(pa.float64())),
        })

    found = examples.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(work, "ordinary binary, toxic binary, numbers array<double>").collect()
    if not found:
        return learn([], [])
    numbers = np.array(found[0]["numbers"])
    return Model(bytes(found[0]["ordinary"]), bytes(found[0]["toxic"]), numbers[:FEATURES], numbers[FEATURES:2 * FEATURES], numbers[2 * FEATURES:])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of each whole text, window by window.

    A null or empty text has no window and gets the score of no gain at all.
    Repeated rows are scored each.
    """
    return with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, "score").select("doc_id", "score")


def with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """All columns of ``docs`` and each row's own score in column ``name``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [
            model.score(data[a:b].tobytes())
            for _, data, ends in text_runs(batch, "text") for a, b in zip(ends[:-1], ends[1:], strict=True)
        ]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return per_batch(docs, work, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
