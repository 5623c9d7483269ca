"""Each operator against a plain version on small and awkward tables."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from hushframe.llm import (
    bpe, components, contentsort, edits, language, minhash, mixing, quality, suffixes, topk, toxicity,
)
from hushframe.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, size int, kept string, score string, text_sha256 int"

AWKWARD = [
    None, "", " ", "\n\t\x0b\x0c\r ", "a", "a", "A", "a b c d e", "A  B\nC\tD E", "a b c d e f", "été ß 你好 \U0001f600",
    " x y\x85z", "don't I'll 12345 !!! ...", "<|endoftext|> x", "x" * 5000, "word " * 3000, "\u0000nul\u0000", " lead", "trail  ", "á",
]


def table(spark, texts, **columns):
    rows = [(i, t, columns.get("lang"), columns.get("source"), i, "x", "y", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    ids = list(range(len(AWKWARD) - 1)) + [None]
    rows = [(i, t, None, None, 1, "k", "s", 2) for i, t in zip(ids, AWKWARD, strict=True)]
    return spark.createDataFrame(rows + [rows[5], rows[-1]], SCHEMA)  # two rows repeated


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# exact top-k

def test_top_k_counts_ties_and_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.5, 0.0, 0.25, 0.999]) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (301, [None, 1.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, []), (305, [0.5]), (None, [1.0])]
    df = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    vectors = topk.quantised(df)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, 5).collect()}
    weights = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in weights if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(weights[q], w, strict=False)), i) for i, w in weights.items() if i != q)
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in scored[:5]]
    assert len(got) == 5 * sum(i % 50 == 0 for i in weights)


def test_top_k_in_several_blocks(spark, monkeypatch):
    df = spark.range(500).selectExpr("id AS vec_id", "array(double(id % 7), double(id % 11), 1D) AS embedding")
    vectors = topk.quantised(df)
    queries = vectors.where("vec_id % 50 = 0")
    whole = sorted(topk.top_k(queries, vectors, 3).collect())
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    assert sorted(topk.top_k(queries, vectors, 3).collect()) == whole


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    vectors = topk.quantised(df)
    assert [tuple(r) for r in topk.top_k(vectors.where("vec_id = 0"), vectors, 5).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(vectors.where("false"), vectors, 5).count() == 0
    assert topk.top_k(vectors.where("false"), vectors.where("false"), 5).count() == 0


def test_scores_never_leave_a_long(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [2.0**22, 1.0]), (1, [2.0**22, 2.0]), (50, [-(2.0**22), 0.0])]
    vectors = topk.quantised(spark.createDataFrame(rows, schema))
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(vectors, vectors, 5).collect()}
    assert got[0, 1] == 2**60 + 256 * 512 and got[0, 50] == -(2**60)
    for long in ([1e8, 1.0], [1e300], [2.0**24]):
        with pytest.raises(Exception, match="too long"):
            topk.quantised(spark.createDataFrame([(0, long)], schema)).collect()


# language

def test_every_language_is_learnt(spark):
    """70 languages, each with letters of its own and some that all share."""
    rng = random.Random(7)
    rows = []
    for k in range(70):
        letters = [chr(0x4E00 + 20 * k + j) for j in range(12)] + list("abc ")
        rows += [(1000 * k + i, "".join(rng.choices(letters, k=60)), f"l{k:02d}") for i in range(12 if k else 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id % 1000 > 1"), at_once=32)
    assert model.languages == sorted({r[2] for r in rows}) and len(model.parts) == 3
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs.where("doc_id % 1000 <= 1"), model).collect()}
    assert all(found[i][0] == lang and 0 < found[i][1] <= 1 for i, _, lang in rows if i % 1000 <= 1)
    whole = language.fit(docs.where("doc_id % 1000 > 1"), at_once=100)
    assert {r.doc_id: r.lang_pred for r in language.identify(docs.where("doc_id % 1000 <= 1"), whole).collect()} == {i: p for i, (p, _) in found.items()}


def test_language_of_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(docs.where("doc_id % 3 <> 0"))
    found = docs.where("doc_id % 3 = 0").join(language.identify(docs, model), "doc_id")
    wrong = found.where("lang <> lang_pred").count()
    assert wrong <= 0.02 * found.count()
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_of_awkward_texts(spark, sf_dir, awkward, nothing):
    model = language.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = language.identify(awkward, model).collect()
    assert len(got) == awkward.count()
    named = {r.doc_id: r.lang_pred for r in got}
    assert all(named[i] == "und" for i in (0, 1, 2, 3)) and named[7] != "und"
    assert language.identify(nothing, model).count() == 0
    untaught = language.fit(nothing)
    assert {r.lang_pred for r in language.identify(awkward, untaught).collect()} == {"und"}


def test_language_model_sums_to_one_over_seen_characters(spark):
    docs = table(spark, ["abab abba baab"] * 40, lang="x")
    model = language.fit(docs)
    codes = language._codes("abab")
    seen = sorted(set("ab "))
    context = language._codes("ab")[-language.ORDER + 1:]
    total = sum(np.exp(model._logs(np.r_[context, np.uint64(ord(c))])[-1, 0]) for c in seen)
    assert 0.98 < total <= 1.0001 and len(codes) == 4 + language.ORDER - 1


def test_sorted_hashes_find_what_is_there():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    held = language.SortedHashes(keys)
    assert (held.find(keys) == np.arange(len(keys))).all()
    assert (held.find(keys + np.uint64(1)) == -1).all()
    assert (language.SortedHashes(keys[:0]).find(keys[:9]) == -1).all()


# byte-level BPE

@pytest.fixture(scope="module")
def ranks():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=held, special_tokens={})


def wild_texts():
    rng = random.Random(4)
    alphabet = ["a", "b", " ", " ", "  ", "\n", "\t", "'s", "'", "1", "23", "!", "é", "你", "\U0001f600", " ", " ", "\x85", "\x1c", "The", " the", "\r\n", "<|endoftext|>", "́"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(1500)]


def test_ids_are_those_of_the_ranks(spark, ranks):
    texts = AWKWARD + wild_texts()
    encoded = bpe.encode(table(spark, texts), vocabulary())
    for row in bpe.decode(encoded, vocabulary()).collect():
        text = texts[row.doc_id] or ""
        assert row.ids == ranks.encode_ordinary(text), text
        assert bytes(row.decoded) == text.encode()


def test_digests_and_spans(spark, ranks, awkward, nothing):
    got = bpe.digests(bpe.round_trip(awkward, vocabulary()))
    assert sorted(got.collect(), key=str) == sorted(bpe.digests(bpe.decode(bpe.encode(awkward, vocabulary()), vocabulary())).collect(), key=str)
    by_id = {r.doc_id: r for r in got.collect()}
    for i, text in enumerate(AWKWARD[:-1]):
        ids = ranks.encode_ordinary(text or "")
        assert by_id[i].n_tokens == len(ids)
        assert by_id[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert by_id[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert got.count() == awkward.count()
    assert bpe.encode(nothing, vocabulary()).count() == 0
    text = "\U0001f600 x"
    row = bpe.encode(table(spark, [text]), vocabulary(), offsets=True).first()
    assert row.chars[0] == [0, 1] and row.chars[-1] == [1, 3]  # a split character belongs to each of its ids
    assert sum(a == 0 for a, _ in row.chars) > 1


def test_white_space_and_control_characters_part_pre_tokens(ranks):
    model = bpe.Coder(vocabulary())
    texts = [f"a{chr(i)}b {chr(i)}1{chr(i)} {chr(i)}{chr(i)}x" for i in [*range(1, 0x400), *range(0x1680, 0x1690), *range(0x1FF0, 0x2070), 0x3000]]
    texts += ["", " ", "  ", "a ", " a", " a  b", "it's they'll'd", "<|endoftext|> <|endoftext|>"]
    ids, sizes = model.encode(texts)
    for text, own, size in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), sizes, strict=True):
        assert own.tolist() == ranks.encode_ordinary(text)
        assert model.count(text) == size


def test_forgetting_pieces_changes_nothing(monkeypatch, ranks):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    model = bpe.Coder(vocabulary())
    for text in wild_texts()[:200]:
        assert model.encode([text])[0].tolist() == ranks.encode_ordinary(text)


# near duplicates

def plain_sets(texts):
    out = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def plain_components(sets):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if x and 100 * common >= 75 * (len(x) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(sets))]


def near_texts():
    rng = random.Random(8)
    vocabulary_ = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):  # chains and stars of edited copies around the threshold
        base = rng.choices(vocabulary_, k=rng.randint(6, 120))
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary_)
            texts.append(" ".join(copy))
            if rng.random() < 0.4:
                base = copy
    return texts + ["One two", "one TWO", "one", None, "", "  ", "one two three four five", "ONE two three four five"]


def test_near_duplicates_match_all_pairs(spark):
    texts = near_texts()
    sets = plain_sets(texts)
    want = plain_components(sets)
    got = {r.doc_id: r for r in minhash.near_duplicates(table(spark, texts)).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(got[i].kept == (want[i] == i) for i in got)


def test_near_duplicates_by_shuffled_ids(spark, monkeypatch):
    texts = near_texts()
    want = sorted(minhash.near_duplicates(table(spark, texts)).collect())
    monkeypatch.setattr(minhash, "SENT_IDS", 0)
    assert sorted(minhash.near_duplicates(table(spark, texts).repartition(7)).collect()) == want


def test_signatures_are_written_once_and_their_bands_meet_no_pair(spark, monkeypatch, capsys):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    texts = []
    for k in range(40):  # many pairs on either side of the threshold, and copies of each text
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts += [" ".join(words)] * 2
    written, plans, write = [], [], minhash.materialize

    def recorded(df):
        written.append(df.columns)
        df.explain()
        plans.append(capsys.readouterr().out)
        return write(df)

    monkeypatch.setattr(minhash, "materialize", recorded)
    got = {r.doc_id: r for r in minhash.near_duplicates(table(spark, texts)).collect()}
    assert [c for c in written if "bands" in c] == [["row", "doc_id", "n_shingles", "digest", "bits", "bands"]]
    assert any("keys_a" in p for p in plans) and not any("bands_a" in p for p in plans)
    want = plain_components(plain_sets(texts))
    assert {i: (r.component_id, r.kept) for i, r in got.items()} == {i: (want[i], want[i] == i) for i in got}


def test_long_bits_begin_with_the_bits_of_the_signature(spark):
    texts = ["a b c d e f g", " ".join(f"v{i * i % 997}" for i in range(4000)), "one"]
    docs = table(spark, texts).select(F.col("doc_id").alias("row"), "doc_id", "text")
    long = {r.row: r.long for r in minhash.long_bits(docs, docs.select("row")).collect()}
    assert {r.row: r.bits for r in minhash.signed(docs).collect()} == {k: v[:minhash.HASHES // 64] for k, v in long.items()}


def test_near_duplicates_of_awkward_rows(spark, awkward, nothing):
    got = minhash.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id and r.kept for r in got if r.doc_id in (0, 1, 2, 3))
    assert {r.component_id for r in got if r.doc_id in (4, 5, 6)} == {4}
    assert all(r.kept for r in got if r.doc_id is None)
    assert minhash.near_duplicates(nothing).count() == 0


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    y = np.r_[x[:300], rng.integers(0, 2**63, 100).astype(np.uint64)]
    a, b = (minhash.low_bits(minhash.minima(v), 1).view(np.uint64) for v in (x, y))
    unequal = np.bitwise_count(a ^ b).sum()
    assert abs(1 - 2 * unequal / minhash.HASHES - 0.6) < 0.15


def test_estimates_of_small_sets_lose_no_link():
    rng = np.random.default_rng(5)
    for size in (3, 6, 9, 30):
        for _ in range(60):
            x = rng.integers(0, 2**63, size + size // 3).astype(np.uint64)
            y = x[:size]  # similarity 0.75
            short = [minhash.low_bits(minhash.minima(v), 1).view(np.uint64) for v in (x, y)]
            assert 1 - 2 * np.bitwise_count(short[0] ^ short[1]).sum() / minhash.HASHES >= minhash.LEAST_ESTIMATE
            a, b = (minhash.low_bits(minhash.minima(v, minhash.LONG_HASHES), 2).view(np.uint64).reshape(2, -1) for v in (x, y))
            apart = np.bitwise_count((a[0] ^ b[0]) | (a[1] ^ b[1])).sum()
            assert 1 - apart / (minhash.LONG_HASHES * 0.75) >= minhash.LEAST_LONG_ESTIMATE


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (7, 7), (300, 300)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# exact duplicates

def test_exact_duplicates_of_awkward_rows(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), i is None, i or 0, i))
    got = contentsort.exact_duplicates(awkward).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        content = "".join(c for c in texts[r.doc_id] or "" if c not in " \t\n\x0b\x0c\r")
        assert (r.keep_id, r.group_size) == (min(groups[content])[3], len(groups[content]))
        assert r.kept == (r.doc_id == r.keep_id) and r.text_sha256 == hashlib.sha256(content.encode()).hexdigest()
    assert contentsort.exact_duplicates(nothing).count() == 0


def test_a_hot_text_is_one_group(spark, monkeypatch):
    monkeypatch.setattr(contentsort, "LEAST_HOT", 5)
    texts = ["same text"] * 200 + ["same  text "] * 3 + [f"t{i}" for i in range(50)]
    got = {r.doc_id: r for r in contentsort.exact_duplicates(table(spark, texts)).collect()}
    assert {(got[i].keep_id, got[i].group_size) for i in range(203)} == {(200, 203)}
    assert all(got[i].kept and got[i].group_size == 1 for i in range(203, 253))


# quality and toxicity

def labelled(spark, sf_dir, column):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(column).alias("label"))
    return docs, labels


def area(rows):
    good, bad = ([s for y, s in rows if y == k] for k in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_quality_of_held_out_texts(spark):
    docs, labels = labelled(spark, "/root/testdata/sf0.01", "quality")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 1"))
    scored = quality.score(docs, model).join(labels, "doc_id").where("doc_id % 3 = 1")
    assert area([(r.label, r.score) for r in scored.collect()]) > 0.95


def test_toxicity_of_held_out_texts(spark):
    """Toxic texts hold some of a few words among invented ones."""
    rng = random.Random(5)
    syllables = ["ba", "ko", "ri", "tu", "ne", "sha", "lom", "ver", "dis", "ant"]

    def text(toxic):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(40, 200))]
        for _ in range(rng.randint(2, 6) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["horridword", "vilething", "nastyname"])
        return " ".join(words)

    labels = [i % 5 == 0 for i in range(900)]
    docs = table(spark, [text(y) for y in labels])
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id long, label int")
    model = toxicity.fit(docs, marks.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in got if i % 4 == 2]
    assert area([(int(labels[i]), got[i]) for i in held]) > 0.97
    assert sum(got[i] >= 0.3 for i in held if labels[i]) >= 0.9 * sum(labels[i] for i in held)
    assert sum(got[i] >= 0.3 for i in held if not labels[i]) <= 0.05 * len(held)


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers_on_awkward_rows(spark, sf_dir, awkward, nothing, operator):
    docs, labels = labelled(spark, sf_dir, "quality" if operator is quality else "toxic")
    more = labels.union(spark.createDataFrame([(None, 1), (3, None), (5, 1), (5, 0)], "doc_id long, label int"))
    model = operator.fit(docs, more)
    got = operator.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (0, 1)}
    assert len(empty) == 1
    assert operator.score(nothing, model).count() == 0
    blank = operator.fit(docs, labels.where("false"))
    assert len({r.score for r in operator.score(awkward, blank).collect()}) == 1


def test_compression_features_of_a_known_word():
    model = toxicity.Model(b"ordinary words stand here " * 20, b" horridword vilething ", np.zeros(12), np.ones(12), np.zeros(13))
    assert model.gains(b"zx qy horridword kv lq").max() >= 5
    assert model.gains(b"zx qy kv lq wp mn bv cx").max() <= 0
    assert model.features(b"")[0] == 0


# edit-aware counts

def test_counts_follow_any_edits(ranks):
    rng = random.Random(6)
    model = bpe.Coder(vocabulary())
    for _ in range(150):
        text = "".join(rng.choices(["word", " ", "  ", "\n", "a", "'s", "12", "é", " the", "!?", " "], k=rng.randint(0, 1500)))
        tree = edits.build(text, model)
        assert tree.tokens == len(ranks.encode_ordinary(text))
        for _ in range(6):
            a = rng.randint(0, len(text) + 3)
            b = a + rng.choice([0, 0, 1, 5, 700, 5000])
            new = rng.choice(["", " ", "x", "  two  words ", "\n", " lorem ipsum" * 40, "y" * 9000])
            a_, b_ = min(a, len(text)), min(b, len(text))
            text = text[:a_] + new + text[b_:]
            edits.edit(tree, a, b, new, model)
            assert "".join(tree.texts) == text and tree.chars == len(text)
            assert tree.tokens == len(ranks.encode_ordinary(text))


def test_an_edit_encodes_little_again():
    model = bpe.Coder(vocabulary())
    text = "some words and others " * 2000
    tree = edits.build(text, model)
    assert edits.edit(tree, 20_001, 20_005, "changed", model) < 4 * edits.LEAF


def test_counts_of_rows(spark, ranks, awkward, nothing):
    rows = awkward.withColumn("edits", edits.sample_edits())
    got = edits.counts_after_edits(rows, vocabulary()).collect()
    assert len(got) == awkward.count()
    by_id = {r.doc_id: r for r in got}
    for i, text in enumerate(AWKWARD[:-1]):
        text = text or ""
        assert by_id[i].n_tokens == len(ranks.encode_ordinary(text))
        n = len(text)
        new = text[:n // 3] + " inserted words" + text[n // 3:]
        new = new[:n // 2] + new[int(n // 2 + n / 8):]
        new += text[:40]
        assert (by_id[i].n_tokens_after, by_id[i].n_chars_after) == (len(ranks.encode_ordinary(new)), len(new))
    assert edits.counts_after_edits(nothing.withColumn("edits", edits.sample_edits()), vocabulary()).count() == 0
    odd = spark.createDataFrame([(1, "abc", None), (2, None, [None, (None, None, None), (0, 9, "x")])], "doc_id long, text string, edits array<struct<start:int,stop:int,text:string>>")
    assert [(r.doc_id, r.n_chars_after) for r in edits.counts_after_edits(odd, vocabulary()).orderBy("doc_id").collect()] == [(1, 3), (2, 1)]


def test_kept_trees_follow_later_edits(spark, ranks, awkward, nothing):
    texts = {i: t for i, t in enumerate(AWKWARD)} | {90: "some words and others " * 2000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = edits.stored_trees(docs, vocabulary())
    for r in kept.collect():
        assert "".join(x.text for x in r.leaves) == (texts[r.doc_id] or "") and r.n_tokens == len(ranks.encode_ordinary(texts[r.doc_id] or ""))
    rounds = [{90: [(20_001, 20_005, "changed")], 7: [(2, 3, "x y"), (0, 0, " ")], 0: [(0, 0, "new")], 999: [(0, 1, "z")]}, {90: [(0, 9, "")], 15: [None, (4, None, "!")]}]
    for changes in rounds:
        given = spark.createDataFrame(list(changes.items()), "doc_id long, edits array<struct<start:int,stop:int,text:string>>")
        after = edits.edited_trees(kept, given, vocabulary())
        for i, cs in changes.items():
            for c in cs if i in texts else []:
                t, (a, b, new) = texts[i] or "", c or (0, None, "")
                texts[i] = t[:a] + new + t[(a if b is None else b):]
        rows = {r.doc_id: r for r in after.collect()}
        assert set(rows) == set(texts)
        for i, text in texts.items():
            assert "".join(x.text for x in rows[i].leaves) == (text or "") and rows[i].n_tokens == len(ranks.encode_ordinary(text or ""))
            assert rows[i].chars_encoded_again == 0 if i not in changes else rows[i].chars_encoded_again < 4 * edits.LEAF
        kept = spark.createDataFrame(after.drop("chars_encoded_again").collect(), edits.TREES)
    assert edits.stored_trees(nothing, vocabulary()).count() == edits.edited_trees(kept.where("false"), given, vocabulary()).count() == 0


# mixing

def test_stream_reads_what_the_mix_takes(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])) or None, None, rng.choice(["a", "a", "a", "b", "c", None]), 0, "", "", 0) for i in range(400)]
    docs = spark.createDataFrame(rows + rows[:9], SCHEMA)
    taken = {}
    for r in mixing.mix(docs, slots=600).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    stream = mixing.stream(docs, slots=600).collect()
    read, places = Counter(), {}
    for r in stream:
        read[r.doc_id] += r.words
        places.setdefault(r.position, []).append((r.at, r.words))
    assert {i: n for i, n in taken.items() if n} == dict(read)
    for parts in places.values():  # a slot is read without gaps or overlaps
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    source = {r[0]: r[3] for r in rows}
    order = [source[r.doc_id] for r in sorted(stream, key=lambda r: (r.position, r.at)) for _ in range(r.words)]
    whole = Counter(order)
    for first in range(0, len(order) - len(order) // 10, len(order) // 10):  # each tenth holds the sources by their share
        part = Counter(order[first:first + len(order) // 10])
        assert all(abs(part[s] / (len(order) // 10) - whole[s] / len(order)) < 0.05 for s in whole)


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in out]
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return {**out, **share}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]


def test_mix_meets_targets_whole(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 40, 400])), rng.choice(["b", "a", "a", "a", "c", "é", None, "tiny" if i == 5 else "b"])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("clash"))
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    again = {r.doc_id: r for r in mixing.mix(df.repartition(13)).collect()}
    assert got == again and len(got) == 900
    sizes, taken = Counter(), Counter()
    for i, text, source in rows:
        assert got[i].size == len(text.split()) and got[i].taken <= 2 * got[i].size
        sizes[source] += got[i].size
        taken[source] += got[i].taken
    want = plain_targets(dict(sizes))
    for source, target in want.items():
        assert abs(taken[source] - target) <= 1
    for i, _, source in rows:
        assert got[i].source_size == sizes[source] and abs(got[i].target - want[source]) < 1e-6


def test_mix_of_awkward_rows(spark, awkward, nothing):
    got = mixing.mix(awkward).collect()
    assert len(got) == awkward.count()
    assert {(r.size, r.taken, r.copies) for r in got if r.doc_id in (0, 1, 2, 3)} == {(0, 0, 0)}
    assert mixing.mix(nothing).count() == 0
    empty = mixing.mix(table(spark, ["", None, " "], source="s")).collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 3


def test_schedule_is_spread_and_complete(spark):
    goals = spark.createDataFrame([(0, "a", 5000, 6000.0), (1, "b", 1000, 1500.0), (2, "c", 10, 20.0)], "number int, source string, source_size long, target double")
    slots, block = mixing.schedule(goals, 750)
    rows = slots.collect()
    assert block == 11
    words = Counter()
    for r in rows:
        words[r.number] += r.words
    assert words == {0: 6000, 1: 1500, 2: 20}
    early = [r.number for r in rows if r.position < 100]
    assert abs(early.count(0) - 80) <= 3 and abs(early.count(1) - 20) <= 3


# repeated strings

def plain_repeats(texts):
    n = suffixes.LENGTH
    data = [(t or "").encode() for t in texts]
    held = Counter(d[i:i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d), bool)
        for i in range(len(d) - n + 1):
            if held[d[i:i + n]] > 1:
                covered[i:i + n] = True
        edges = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
        out.append((len(d), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), bytes(np.frombuffer(d, np.uint8)[~covered])))
    return out


def repeated_texts():
    rng = random.Random(11)

    def prose(k):
        return "".join(rng.choices("abcdefgh é", k=k))

    shared = [prose(k) for k in (399, 400, 401, 450, 900, 1500)]
    texts = ["".join([prose(rng.randint(0, 700)), *(rng.choice(shared)[:rng.randint(350, 1500)] + prose(rng.choice([0, 1, 30])) for _ in range(rng.randint(0, 3)))]) for _ in range(50)]
    copy = prose(2500)
    texts += [copy, copy, copy[:1200] + "X" + copy[1200:], copy[7:], copy[:1100], "a" * 1500, "ab" * 700, prose(399), None, "", shared[2] + shared[2]]
    return texts


@pytest.mark.parametrize("options", [{}, {"together": 1, "sent": 0}, {"together": 3, "sent": 0}])
def test_repeated_strings_are_removed(spark, options):
    texts = repeated_texts()
    want = plain_repeats(texts)
    got = {r.doc_id: r for r in suffixes.without_repeats(table(spark, texts), **options).collect()}
    for i, (size, ranges, kept) in enumerate(want):
        assert (got[i].n_bytes, [tuple(x) for x in got[i].removed], bytes(got[i].kept)) == (size, ranges, kept), i


def test_repeated_strings_of_awkward_rows(spark, awkward, nothing):
    got = suffixes.digests(suffixes.without_repeats(awkward)).collect()
    assert len(got) == awkward.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].n_bytes == 0 and by_id[14].n_removed == 5000 and by_id[15].n_spans == 1
    assert suffixes.without_repeats(nothing).count() == 0


def test_false_matches_are_counted_by_bytes(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 2400).astype(np.uint8).tobytes()
    pieces = [data[:700], data[:650] + b"z" * 50, data[1000:1700]]
    sizes = np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    arguments = (b"".join(pieces), starts, starts + sizes, starts + 300, np.zeros(3, np.int64))
    want = [[(-300, 350)], [(-300, 350)], []]
    assert suffixes._repeated(*arguments) == want
    monkeypatch.setattr(suffixes, "range_hashes", lambda prefix, a, b: np.zeros(len(a), np.uint64))
    merged = []
    for ranges in suffixes._repeated(*arguments):
        out = []
        for a, b in sorted(ranges):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        merged.append(out)
    assert merged == want


# rows that repeat or have no id

def test_rows_are_told_apart_by_their_key(spark):
    rng = random.Random(12)
    base = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=60)) for _ in range(4)]
    texts = [base[0], base[0], base[0] + " ", base[1], base[1] + " more", base[1] + " more", base[2], base[3], None]
    ids = [None, None, None, None, None, 7, 7, 7, None]
    rows = spark.createDataFrame([(k, i, t, "s") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "key long, doc_id long, text string, source string")
    exact = {r.key: r for r in contentsort.exact_duplicates(rows, row_col="key").collect()}
    assert [exact[k].kept for k in range(9)] == [False, False, True, True, False, True, True, True, True]
    near = {r.key: r for r in minhash.near_duplicates(rows, row_col="key").collect()}
    assert [near[k].kept for k in range(9)] == [True, False, False, False, False, True, True, True, True]
    plain = {(r.doc_id, r.component_id, r.n_shingles, r.kept) for r in minhash.near_duplicates(rows).collect()}
    assert plain == {(None, None, 56, True), (None, None, 0, True), (None, 7, 56, False), (None, 7, 57, False), (7, 7, 57, True), (7, 7, 56, True)}
    mixed = {r.key: r for r in mixing.mix(rows, row_col="key").collect()}
    assert len(mixed) == 9 and mixed[8].copies == 0
    assert abs(sum(r.taken for r in mixed.values()) - next(iter(mixed.values())).target) <= 1
