"""The learnt models against plain versions, number by number."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from hushframe.llm import language, quality, toxicity

from test_operators import SCHEMA, table


def texts_of(seed, n, letters, size):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randint(1, size))) for _ in range(n)]


# language

class PlainKneserNey:
    """Interpolated Kneser-Ney over characters, from its definition."""

    def __init__(self, texts):
        self.count = {n: defaultdict(Counter) for n in range(1, language.ORDER + 1)}
        grams = {n: Counter() for n in range(1, language.ORDER + 1)}
        for text in texts:
            padded = " " * (language.ORDER - 1) + text.lower()
            for i in range(language.ORDER - 1, len(padded)):
                for n in grams:
                    grams[n][padded[i - n + 1:i + 1]] += 1
        for gram, k in grams[language.ORDER].items():
            self.count[language.ORDER][gram[:-1]][gram[-1]] = k
        for n in range(1, language.ORDER):  # in how many contexts one character longer a gram is seen
            for gram in grams[n + 1]:
                self.count[n][gram[1:-1]][gram[-1]] += 1

    def p(self, context, c, n=language.ORDER):
        if n == 0:
            return 1 / language.UNKNOWN_CHARACTERS
        context = context[len(context) - n + 1:]
        seen = self.count[n].get(context)
        if not seen:
            return self.p(context[1:], c, n - 1)
        total = sum(seen.values())
        return max(seen[c] - language.DISCOUNT, 0) / total + language.DISCOUNT * len(seen) / total * self.p(context[1:], c, n - 1)

    def entropy(self, text):
        padded = " " * (language.ORDER - 1) + text.lower()
        logs = [math.log(self.p(padded[i - language.ORDER + 1:i], padded[i])) for i in range(language.ORDER - 1, len(padded))]
        return -sum(logs) / len(logs)


def test_language_models_are_interpolated_kneser_ney(spark):
    taught = {"a": texts_of(1, 12, "abcd  ", 60), "b": texts_of(2, 9, "cdeé ", 80), "c": ["Zz"]}
    rows = [(lang, t) for lang, ts in taught.items() for t in ts]
    train = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    model = language._model(sorted(taught), language._counted(train).toArrow())
    plain = {lang: PlainKneserNey(ts) for lang, ts in taught.items()}
    unseen = [*texts_of(3, 20, "abcdeéfZ  \n", 50), "x", "ABCD", "zz", taught["a"][0], "a" * 500]
    for text in unseen:
        want = [plain[lang].entropy(text) for lang in sorted(taught)]
        assert model.entropies(text) == pytest.approx(want, rel=2e-5)
    docs = table(spark, unseen)
    for r in language.identify(docs, model).collect():
        nats = {lang: plain[lang].entropy(unseen[r.doc_id]) for lang in taught}
        best = min(nats, key=lambda lang: (nats[lang], lang))
        assert r.lang_pred == best and r.entropy == pytest.approx(nats[best], rel=2e-5)
        assert r.score == pytest.approx(1 / sum(math.exp((nats[best] - x) * language.SHARPNESS) for x in nats.values()), rel=1e-3)


# quality

def plain_ftrl(examples, epochs):
    """FTRL-proximal, slot by slot; the slot None is the bias."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        penalty = 0 if i is None else quality.L1
        if abs(z[i]) <= penalty:
            return 0.0
        return -(z[i] - math.copysign(penalty, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        for values, label in examples:
            x = {**values, None: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - label) * x[i]
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def counted(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    slots, text = quality.features(data, ends)
    return [Counter(slots[text == i].tolist()) for i in range(len(texts))]


def test_quality_weights_are_those_of_plain_updates():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["good", "bad", "word", "X!", "12", "the"], k=rng.randint(1, 30))) for _ in range(60)]
    labels = [int("good" in t) for t in texts]
    plain = [({i: k / math.sqrt(sum(c.values())) for i, k in c.items()}, y) for c, y in zip(counted(texts), labels)]
    given = [(np.array(sorted(x)), np.array([x[i] for i in sorted(x)]), y) for x, y in plain]
    weights, bias = quality.train(given)
    want = plain_ftrl(plain, quality.EPOCHS)
    assert bias == pytest.approx(want.pop(None), rel=1e-9)
    assert {i: w for i, w in enumerate(weights) if w} == pytest.approx({i: w for i, w in want.items() if w}, rel=1e-9)


def test_quality_scores_are_plain_dot_products(spark):
    rng = random.Random(5)
    weights = np.random.default_rng(5).normal(size=1 << quality.BITS).astype(np.float32)
    texts = [None, "", "one", "one two", *[" ".join(rng.choices(["a", "Bb", "c.", "9"], k=k)) for k in (3, 50, 4000)]]
    model = quality.Model(weights, -0.25)
    got = {r.doc_id: r.score for r in quality.score(table(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        c = counted([t or ""])[0]
        total = sum(float(weights[s]) * k for s, k in c.items()) / math.sqrt(max(sum(c.values()), 1))
        assert got[i] == pytest.approx(1 / (1 + math.exp(0.25 - total)), rel=1e-6)


# toxicity

def test_toxicity_scores_follow_from_compressed_windows(spark):
    rng = random.Random(6)
    prose = lambda k: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(k))
    model = toxicity.Model(
        prose(300).encode(), b" horridword uglyword ", np.linspace(0.1, 0.5, toxicity.FEATURES), np.linspace(1, 2, toxicity.FEATURES),
        np.linspace(-1, 1, toxicity.FEATURES + 1),
    )
    texts = [None, "", "short", prose(20), prose(200) + " horridword " + prose(200), "horridword " * 50, "é" * 3000]
    got = {r.doc_id: r.score for r in toxicity.score(table(spark, texts), model).collect()}

    def plain(text):
        data, gains = text.encode(), []
        for i in range(0, len(data), toxicity.WINDOW):
            window = data[max(0, i - toxicity.OVERLAP):i + toxicity.WINDOW] + toxicity.PADDING
            sizes = [len(toxicity._compressor(d).compress(window)) for d in (model.ordinary, model.ordinary + model.toxic)]
            gains.append(sizes[0] - sizes[1])
        gains = gains or [0]
        size = math.log(len(gains))
        x = [math.log1p(sum(g >= s for g in gains)) for s in toxicity.STEPS] + [max(gains), sum(gains) / len(gains), size, max(gains) * size]
        odds = model.weights[0] + sum(w * (v - c) / s for w, v, c, s in zip(model.weights[1:], x, model.center, model.scale))
        return 1 / (1 + math.exp(-odds))

    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain(t or ""), rel=1e-9), i
    assert isinstance(toxicity._compressor(model.ordinary), zstandard.ZstdCompressor)


def test_few_sightings_need_not_be_more_than_chance():
    """With few texts a gram must be in more of them; with many the share decides."""
    assert toxicity._beyond_chance(0, 100, 1000) >= 1 and toxicity._beyond_chance(19, 174, 20_000) > 2
    assert toxicity._beyond_chance(1000, 3000, 500_000) < 1000 * toxicity.LEAST_SHARE
    assert SCHEMA.startswith("doc_id")
