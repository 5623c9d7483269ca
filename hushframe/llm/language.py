"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hushframe.llm.arrays import mix, text_runs
from hushframe.llm.frames import per_batch

#: Rows of each language that are learnt from at most. Every language is learnt, so many
#: of them in one model; models of more languages lie side by side.
ROWS_PER_LANGUAGE = 1500
LANGUAGES_AT_ONCE = 64
ORDER = 4
DISCOUNT = 0.75
#: Share of calibration texts of a known language that the rejection may hit.
REJECTED_SHARE = 0.005
#: Sharpness of the score: difference of nats a character at which odds change by a factor e.
SHARPNESS = 20.0
UNKNOWN_CHARACTERS = 1 << 16

_LETTER = re.compile(r"[^\W\d_]")
_A = np.uint64(0xD6E8FEB86659FD93)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-case text behind ORDER - 1 spaces."""
    return np.frombuffer((" " * (ORDER - 1) + text.lower()).encode("utf-32-le"), np.uint32).astype(np.uint64)


def _grams(codes: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the n characters that end at each position from ORDER - 1 on."""
    out, poly = {}, np.zeros(len(codes) - ORDER + 1, np.uint64)
    for n in range(1, ORDER + 1):
        at = codes[ORDER - n:len(codes) - n + 1]
        poly = poly + (at + np.uint64(1)) * _A ** np.uint64(n)
        out[n] = mix(poly + np.uint64(n))
    return out


def _contexts(codes: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the n characters before each position."""
    return {n: h for n, h in _grams(np.r_[np.uint64(32), codes[:-1]]).items() if n < ORDER} | {
        0: np.zeros(len(codes) - ORDER + 1, np.uint64),
    }


class SortedHashes:
    """Sorted 64-bit keys with an index over their leading bits."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.r_[keys, np.uint64(0)]  # one entry beyond the end can be read
        self.shift = np.uint64(63 - max(1, int(len(keys)).bit_length()))
        buckets = np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)
        self.index = np.searchsorted(keys >> self.shift, buckets)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted keys, -1 where there is none."""
        bucket = (wanted >> self.shift).astype(np.int64)
        at, end = self.index[bucket], self.index[bucket + 1]
        hit = (self.keys[at] == wanted) & (at < end)
        place = np.where(hit, at, -1)
        left = np.flatnonzero(~hit & (at + 1 < end))
        while len(left):
            at[left] += 1
            hit = self.keys[at[left]] == wanted[left]
            place[left[hit]] = at[left[hit]]
            left = left[~hit & (at[left] + 1 < end[left])]
        return place


@dataclass
class Model:
    """For each order: n-gram hashes with log probabilities by language, context
    hashes with log back-off weights by language."""

    languages: list[str]
    grams: dict[int, SortedHashes]
    logs: dict[int, np.ndarray]
    contexts: dict[int, SortedHashes]
    backoff: dict[int, np.ndarray]
    floor: np.ndarray
    threshold: float = float("inf")

    def entropies(self, text: str) -> np.ndarray:
        """Nats a character under each language's model."""
        total, n = np.zeros(len(self.languages)), 0
        step = 1 << 18
        codes = _codes(text)
        for first in range(0, len(codes) - ORDER + 1, step):
            part = codes[first:first + step + ORDER - 1]
            total += self._logs(part).sum(axis=0, dtype=np.float64)
            n += len(part) - ORDER + 1
        return -total / max(n, 1)

    def _logs(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each character by language."""
        grams, contexts = _grams(codes), None
        place = self.grams[ORDER].find(grams[ORDER])
        out = self.logs[ORDER][place]
        left = np.flatnonzero(place < 0)
        out[left] = 0
        for n in range(ORDER - 1, -1, -1):
            if not len(left):
                break
            contexts = contexts or _contexts(codes)
            place = self.contexts[n + 1].find(contexts[n][left])
            out[left] += np.where((place >= 0)[:, None], self.backoff[n + 1][place], 0)
            if n == 0:
                out[left] += self.floor
                break
            place = self.grams[n].find(grams[n][left])
            hit = place >= 0
            out[left[hit]] += self.logs[n][place[hit]]
            left = left[~hit]
        return out


@dataclass
class Models:
    """Models of many languages side by side."""

    parts: list[Model]
    threshold: float = float("inf")

    @property
    def languages(self) -> list[str]:
        return [name for part in self.parts for name in part.languages]

    def entropies(self, text: str) -> np.ndarray:
        return np.concatenate([part.entropies(text) for part in self.parts])


def _counted(train: DataFrame) -> DataFrame:
    """(lang, n, gram, context, suffix, count) of the training texts."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang = np.array(batch.column("lang").to_pylist(), object)
        by_lang: dict[str, list[np.ndarray]] = {}
        for first, data, ends in text_runs(batch, "text"):
            for i in range(len(ends) - 1):
                by_lang.setdefault(lang[first + i], []).append(_codes(data[ends[i]:ends[i + 1]].tobytes().decode("utf-8", "replace")))
        columns: list[list] = [[], [], [], [], [], []]
        for name, texts in by_lang.items():
            for n in range(1, ORDER + 1):
                gram = np.concatenate([_grams(c)[n] for c in texts])
                values, first, counts = np.unique(gram, return_index=True, return_counts=True)
                context = np.concatenate([_contexts(c)[n - 1] for c in texts])[first]
                suffix = np.concatenate([_grams(c)[n - 1] if n > 1 else np.zeros(len(c) - ORDER + 1, np.uint64) for c in texts])[first]
                for column, part in zip(columns, ([name] * len(values), np.full(len(values), n, np.int32), values.view(np.int64), context.view(np.int64), suffix.view(np.int64), counts), strict=True):
                    column.append(part)
        arrays = [pa.array([x for part in columns[0] for x in part], pa.string())]
        arrays += [pa.array(np.concatenate(c)) for c in columns[1:]]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "n", "gram", "context", "suffix", "count"])

    schema = "lang string, n int, gram long, context long, suffix long, count long"
    return per_batch(train, work, schema).groupBy("lang", "n", "gram", "context", "suffix").agg(F.sum("count").alias("count"))


def _model(languages: list[str], table: pa.Table) -> Model:
    lang = np.searchsorted(languages, np.array(table.column("lang").to_pylist(), str)) if table.num_rows else np.zeros(0, int)
    n, count = table.column("n").to_numpy(), table.column("count").to_numpy().astype(np.float64)
    gram, context, suffix = (table.column(c).to_numpy().view(np.uint64) for c in ("gram", "context", "suffix"))
    size = len(languages)
    model = Model(languages, {}, {}, {}, {}, np.full(size, -np.log(UNKNOWN_CHARACTERS), np.float32))
    lower = None
    for order in range(1, ORDER + 1):
        here = n == order
        keys, first, at = np.unique(gram[here], return_index=True, return_inverse=True)
        counts = np.zeros((len(keys), size))
        if order == ORDER:
            counts[at, lang[here]] = count[here]
        else:  # how many characters are seen before it
            above = n == order + 1
            place = np.searchsorted(keys, suffix[above])
            np.add.at(counts, (place, lang[above]), 1)
        its_context, its_suffix = context[here][first], suffix[here][first]
        contexts, to = np.unique(its_context, return_inverse=True)
        totals, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
        np.add.at(totals, to, counts)
        np.add.at(kinds, to, counts > 0)
        seen = totals > 0
        gamma = np.where(seen, DISCOUNT * kinds / np.where(seen, totals, 1), 1.0)
        below = np.full((len(keys), size), 1.0 / UNKNOWN_CHARACTERS) if order == 1 else lower[1][np.searchsorted(lower[0], its_suffix)]
        p = np.maximum(counts - DISCOUNT, 0) / np.where(seen, totals, 1)[to] + gamma[to] * below
        model.grams[order], model.logs[order] = SortedHashes(keys), np.r_[np.log(p), np.zeros((1, size))].astype(np.float32)
        model.contexts[order], model.backoff[order] = SortedHashes(contexts), np.r_[np.log(gamma), np.zeros((1, size))].astype(np.float32)
        lower = (keys, p)
    return model


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, at_once: int = LANGUAGES_AT_ONCE) -> Model | Models:
    """Models of the languages in ``docs`` (doc_id, text, lang).

    Learnt from at most about ``rows_per_language`` whole texts of each lang
    value, chosen by a hash of doc_id; a tenth of them calibrates the rejection
    instead. Spark counts the n-grams; the counts of this bounded sample meet on the
    driver, ``at_once`` languages at a time. Rows with a null text, lang or doc_id
    teach nothing. Without any row the model knows no language.
    """
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    found = usable.groupBy("lang").count().collect()
    if not found:
        return _model([], pa.table({c: pa.array([], t) for c, t in (("lang", pa.string()), ("n", pa.int32()), ("gram", pa.int64()), ("context", pa.int64()), ("suffix", pa.int64()), ("count", pa.int64()))}))
    share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, rows_per_language / r["count"]))])
    dealt = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.withColumn("at", dealt / F.element_at(share, F.col("lang"))).where(F.col("at") < 1)
    names, train = sorted(r["lang"] for r in found), sample.where(F.col("at") < 0.9).select("lang", "text")
    if len(names) <= at_once:
        model = _model(names, _counted(train).toArrow())
    else:
        parts = [names[k:k + at_once] for k in range(0, len(names), at_once)]
        model = Models([_model(part, _counted(train.where(F.col("lang").isin(part))).toArrow()) for part in parts])
    best = [r["entropy"] for r in _scored(sample.where(F.col("at") >= 0.9), model).where("entropy is not null").select("entropy").collect()]
    model.threshold = float(np.quantile(best, 1 - REJECTED_SHARE)) if best else float("inf")
    return model


def _scored(docs: DataFrame, model: Model | Models) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores, entropies = [], [], []
        for _, data, ends in text_runs(batch, "text"):
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                text = data[a:b].tobytes().decode("utf-8", "replace")
                if not model.languages or not _LETTER.search(text):
                    names.append("und")
                    scores.append(0.0)
                    entropies.append(None)
                    continue
                nats = model.entropies(text)
                best = int(np.argmin(nats))
                names.append(model.languages[best])
                scores.append(float(1 / np.exp((nats[best] - nats) * SHARPNESS).sum()))
                entropies.append(float(nats[best]))
        columns = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(entropies, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "entropy"])

    return per_batch(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        work, "doc_id long, lang_pred string, score double, entropy double",
    )


def identify(docs: DataFrame, model: Model | Models) -> DataFrame:
    """doc_id, lang_pred, score, entropy, rejected for each whole text.

    The language of lowest cross-entropy per character; ``score`` is its share
    among all languages. ``rejected`` marks texts whose entropy lies above
    that of nearly all calibration texts: probably no known language. A null
    text and a text without a letter are ``und`` with score 0 and null entropy.
    Ties go to the first language by name; repeated rows are scored each.
    """
    return _scored(docs, model).withColumn("rejected", F.coalesce(F.col("entropy") > F.lit(model.threshold), F.lit(True)))
