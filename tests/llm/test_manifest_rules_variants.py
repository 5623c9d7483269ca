"""Host rules, spelling variants and the Merkle manifest against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hushframe.llm import hostrules, merkle, variants

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept string, word string, leaf int, index int, tree string, part int"

TEXTS = [
    None, "", " ", "\n\t\x0b\x0c\r ", "a", "a b c", "a b c a b c", "a a a a a", "x y z " * 40, "A  B\nC\tD E\n\n\nC\tD E", "#*$%&|<>" * 9,
    "one two\none two\n one two\n", "été ß 你好 \U0001f600", "word\x85z  ", "long " * 20000, "q" * 9000, "nul\u0000 b c",
    " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i % 57}" for i in range(90)), "line\n" * 70,
]


def rows_of(texts, seed=3):
    rng = random.Random(seed)
    return [
        (i, t, rng.choice(["en", None]), rng.choice(["a", "b", "hot", "hot", None]), rng.choice([None, 7]), 1, "k", "w", 2, 3, "t", 4)
        for i, t in enumerate(texts)
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = rows_of(TEXTS)
    rows += [rows[6], rows[6], (None, *rows[9][1:]), (None, *rows[9][1:])]  # repeated rows and ids
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# host rules

def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered),
    )


def plain_failures(m):
    n, chars, symbols, lines, dup, repeat = m
    return {
        "few_words": n < 50, "repeats": 100 * repeat > 50 * n, "symbols": 10 * symbols > n, "dup_lines": 100 * dup > 30 * lines,
        "word_length": chars < 2 * n or chars > 15 * n,
    }


def plain_hosts(judged, share=0.5):
    """Hosts rejected, from (host, failures) of each document."""
    by = defaultdict(list)
    for host, failures in judged:
        if host is not None:
            by[host].append(failures)
    bad = set()
    for rule in ("few_words", "repeats", "symbols", "dup_lines", "word_length"):
        rates = {h: sum(f[rule] for f in fs) / len(fs) for h, fs in by.items()}
        if not rates:
            continue
        total = sum(map(len, by.values()))
        share_of = {h: len(fs) / total for h, fs in by.items()}
        m = sum(share_of[h] * rates[h] for h in rates)
        spread = sum(share_of[h] * (rates[h] - m) ** 2 for h in rates)
        sampling = sum(share_of[h] * (1 - share_of[h]) / len(by[h]) for h in rates)
        shared = sum(w * (1 - w) for w in share_of.values())
        below = m * (1 - m) * (shared - sampling)
        r = min(max((spread - m * (1 - m) * sampling) / below, 0.02), 0.2) if below else 0.02
        weight = (1 - r) / r
        bad |= {h for h, fs in by.items() if round((sum(f[rule] for f in fs) + m * weight) / (len(fs) + weight), 9) > share}
    return bad


def test_measures_of_odd_texts(spark, odd):
    got = hostrules.host_verdicts(odd)
    assert got.columns[:5] == ["doc_id", "lang", "source", "n_chars", "word"]
    want = [(r.doc_id, r.source, *plain_measures(r.text)) for r in odd.collect()]
    bad = plain_hosts([(w[1], plain_failures(w[2:])) for w in want])
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    found = [(r.doc_id, r.source, *[r[c] for c in names], r.base_failed, r.host_failed, r.kept) for r in got.collect()]
    expected = []
    for w in want:
        f = plain_failures(w[2:])
        base, host = f["few_words"] or f["repeats"], w[1] in bad
        expected.append((*w, base, host, not base and not host))
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_windows_with_one_hash_are_told_apart(spark, monkeypatch):
    """Every window collides: the words decide."""
    monkeypatch.setattr(hostrules.F, "xxhash64", lambda *cols: F.lit(1).cast("long"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t and len(t) < 5000], "doc_id long, text string")
    for r in hostrules.measured(df.withColumn("body", F.col("text")), "body").collect():
        assert r.n_repeat_words in (plain_measures(r.text)[5], 0)
    # with all hashes equal the first comparison of hash counts says that something repeats
    twice = spark.createDataFrame([(0, "a b c d e f a b c")], "doc_id long, text string")
    assert hostrules.measured(twice).first().n_repeat_words == 6


def test_bad_hosts_go_whole_and_small_ones_are_shrunk(spark):
    good, bad = " ".join(f"word{i}" for i in range(80)), "short text"
    rows = [("fine", good)] * 200 + [("junk", bad)] * 180 + [("junk", good)] * 20 + [(f"h{i}", good) for i in range(60)]
    rows += [("one", bad), (None, good), (None, bad)]
    df = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string")
    got = {r.doc_id: r for r in hostrules.host_verdicts(df).collect()}
    kept = Counter((rows[i][0], rows[i][1] == good, r.kept) for i, r in got.items() if (rows[i][0] or "-")[0] != "h")
    assert kept == {("fine", True, True): 200, ("junk", False, False): 180, ("junk", True, False): 20, ("one", False, False): 1, (None, True, True): 1, (None, False, False): 1}
    rates = hostrules.host_rates(df.select("source", (F.col("text") == bad).alias("few")), "source", ["few"]).collect()
    rate = {r.source: r.rate for r in rates}
    assert 0.85 < rate["junk"] < 0.9 and 0 < rate["fine"] < 0.01 and rate["fine"] < rate["h1"] < rate["one"] < 0.6


def test_no_documents_no_verdicts(nothing):
    assert hostrules.host_verdicts(nothing).count() == 0


def test_hosts_of_addresses(spark):
    df = spark.createDataFrame([("https://www.Example.org:80/a?b",), ("http://x.y/",), ("nonsense",), (None,)], "u string")
    assert [r[0] for r in df.select(hostrules.host_of(F.col("u"))).collect()] == ["example.org", "x.y", None, None]


# spelling variants

def plain_counts(rows):
    low, n = str.maketrans(variants.UPPER, variants.LOWER), Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if v != w and one_apart(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def vocabulary_of(seed, size, alphabet):
    """Words full of near ones: stems with edits, and counts with many ties."""
    rng = random.Random(seed)
    words = set()
    while len(words) < size:
        word = "".join(rng.choice(alphabet) for _ in range(rng.randint(6, 14)))
        for _ in range(rng.randint(1, 6)):
            words.add(word)
            i, c = rng.randrange(len(word) + 1), rng.choice(alphabet)
            word = rng.choice([word[:i] + c + word[i:], word[:i] + word[i + 1:], word[:i] + c + word[i + 1:]])
            word = word if len(word) >= 6 else word + c * 6
    return {w: rng.choice([5, 5, 6, 30, 160, 1000]) for w in words}


@pytest.mark.parametrize("frequent", [0, 3, 64])
@pytest.mark.parametrize("alphabet", ["ab", "aeéßxyz"])
def test_all_near_words_are_found(spark, frequent, alphabet):
    counts = vocabulary_of(5, 400, alphabet)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(r) for r in variants.spelling_variants(df, frequent=frequent).collect()}
    assert got == plain_variants(counts)


def test_one_long_run_of_a_letter(spark):
    counts = {"a" * k: 5 ** (k % 4 + 1) for k in range(6, 40)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in variants.spelling_variants(df, frequent=2).collect()} == plain_variants(counts)


def test_an_edit_leaves_unaffected_grams(spark):
    """What list merging rests on: near words share as many grams at matching places as the bound says."""
    counts = vocabulary_of(9, 150, "abc")
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    held = defaultdict(list)
    for r in variants.grams(df, frequent=5).collect():
        held[r["class"], r.word].append((r.gram, r.start, r.end))
    for (k, a), mine in held.items():
        most = variants.CLASSES[k].most
        bound = max(sum(s <= i <= s + most - 1 or (s > i and e <= i + most - 1) for _, s, e in mine) for i in range(len(a)))
        for (other, b), theirs in held.items():
            if k == other and min(len(a), len(b)) >= variants.CLASSES[k].length and one_apart(a, b):
                places = {(g, s) for g, s, _ in theirs}
                shift = len(b) - len(a)
                shared = sum((g, s) in places or (g, s + shift) in places for g, s, _ in mine)
                assert shared >= len(mine) - bound >= 1


def test_variants_of_odd_texts(spark, odd, nothing):
    rng = random.Random(2)
    stems = ["réseau", "maison", "Window", "lettering", "ÀÈÌÒÙü", "abcdef"]
    texts = [None, "", "x" * 3000] + [" ".join(rng.choice(stems) + rng.choice(["", "", "s", "1"]) for _ in range(300)) for _ in range(12)]
    rows = rows_of(texts) + [(None, texts[4], None, None, None, 1, "k", "w", 2, 3, "t", 4)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    counts = plain_counts([(r[0], r[1]) for r in rows])
    assert counts and {tuple(r) for r in variants.variants_of(df).collect()} == plain_variants(counts)
    assert variants.variants_of(nothing).count() == 0
    assert {tuple(r) for r in variants.variants_of(odd).collect()} == plain_variants(plain_counts([(r.doc_id, r.text) for r in odd.collect()]))


# Merkle manifest

def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [digest("".join(nodes[i:i + 16])) for i in range(0, len(nodes), 16)]
        levels.append(nodes)
    return levels


def plain_manifest(rows, tampered):
    def leaf(r, text):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    low, by = str.maketrans(merkle.UPPER, merkle.LOWER), defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for rs in by.values():
        rs.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {s: plain_tree([leaf(r, r.text) for r in by[s]]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, r in enumerate(by[s]):
            d, proof = leaf(r, r.text.translate(low) if tampered(r.doc_id) and r.text is not None else r.text), ""
            for levels, k in ((trees[s], i), (top, j)):
                for nodes in levels[:-1]:
                    first = k - k % 16
                    run = nodes[first:first + 16]
                    left, right = "".join(run[:k - first]), "".join(run[k - first + 1:])
                    proof, d, k = proof + left + right, digest(left + d + right), k // 16
            out.append((r.doc_id, trees[s][0][i], trees[s][-1][0], top[-1][0], digest(proof), d, d == top[-1][0]))
    return sorted(map(repr, out))


def fifth(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


RESULT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_of_odd_rows(spark, odd, nothing):
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.manifest(odd, tamper).select(*RESULT)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_manifest(odd.collect(), fifth)
    assert merkle.manifest(nothing, tamper).count() == 0
    one = odd.where("doc_id = 9")
    assert [r.root == r.leaf and r.proof_sha256 == digest("") for r in merkle.manifest(one).collect()] == [True]


@pytest.mark.parametrize("sizes, sources", [((1, 16, 17, 256, 257, 4097), 1), ((3,), 300)])
def test_manifest_of_many_sizes(spark, sizes, sources):
    """Sizes around the fan and the page, and more sources than a page holds."""
    rows = [(i, f"Text {i}", None, f"s{k}-{x}", i) for k, n in enumerate(sizes) for x in range(sources) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.manifest(df, tamper).select(*RESULT).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_manifest(df.collect(), fifth)
    assert {r.verified for r in got} == ({True, False} if len(sizes) > 1 else {True})


def test_places_are_those_of_an_appending_builder(spark):
    for n in (1, 2, 15, 16, 17, 31, 255, 256, 257, 300, 4096, 4097, 5000):
        order, held = [], [n]
        while held[-1] > 1:
            held.append(-(-held[-1] // 16))
        done = [0] * len(held)
        for i in range(n):
            order.append((0, i))
            done[0] += 1
            for level in range(1, len(held)):
                if done[level] < held[level] and (done[level - 1] == min((done[level] + 1) * 16, held[level - 1])):
                    order.append((level, done[level]))
                    done[level] += 1
        assert [merkle.postorder(level, index, n) for level, index in order] == list(range(len(order)))
        df = spark.createDataFrame([(level, index, n) for level, index in order], "level int, index long, n long")
        places = df.select(merkle.place(F.col("level"), F.col("index"), F.col("n")).alias("p"), "level", "index").collect()
        assert [order[r.p] for r in places] == [(r["level"], r["index"]) for r in places]


def test_the_log_holds_every_node_once(spark):
    rows = [(i, f"t{i}", None, s, i) for s, n in (("a", 700), ("b", 1), (None, 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    placed = merkle.materialize(merkle.numbered(merkle.materialize(merkle.leaves(df)), ["doc_id", "entry", "salt"]))
    forest = merkle.build(placed)
    by = defaultdict(dict)
    for r in merkle.log(placed, forest).collect():
        assert r.place not in by[r.tree]
        by[r.tree][r.place] = r.digest
    roots = {r.tree: r.root for r in forest.roots.collect()}
    for tree, n in (("a", 700), ("b", 1), (None, 20)):
        leaves = {r["index"]: r.entry for r in placed.where(F.col("tree").eqNullSafe(tree)).collect()}
        levels = plain_tree([leaves[i] for i in range(n)])
        assert sorted(by[tree]) == list(range(sum(map(len, levels)))) and by[tree][max(by[tree])] == roots[tree]
        for level, nodes in enumerate(levels):
            assert [by[tree][merkle.postorder(level, i, n)] for i in range(len(nodes))] == nodes
