"""One query per operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hushframe.llm import bpe, contentsort, edits, hostrules, language, merkle, minhash, mixing, quality, suffixes, topk, toxicity, variants
from hushframe.llm.frames import fold, materialize


def vocabulary() -> str:
    """Path of the byte-level vocabulary, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialize(topk.quantised(_table(spark, sf_dir, "embeddings")))
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = language.fit(docs.where(~held_out))
    return language.identify(docs, model).withColumn("held_out", held_out).select(
        "doc_id", "held_out", "lang_pred", "score", "entropy", "rejected",
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(_documents(spark, sf_dir), vocabulary()))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contentsort.exact_duplicates(_documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    labels = _table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels)
    return quality.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with three edits that follow from its text."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", edits.sample_edits().alias("edits"))
    return edits.counts_after_edits(docs, vocabulary())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.without_repeats(_documents(spark, sf_dir)))


#: Documents of this score and more are predicted to be toxic.
TOXIC_SCORE = 0.3


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learnt from the labels; rows with crc32 remainder 2 teach nothing."""
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return toxicity.fit(docs, labels.where(~held_out).select("doc_id", F.col("toxic").alias("label")))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; rows with crc32 remainder 2 teach nothing."""
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return toxicity.score(docs, toxicity_model(docs, labels)).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op11_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of a document is its host."""
    return hostrules.host_verdicts(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept",
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants_of(_documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents with crc32 remainder 0 are tampered with."""
    return merkle.manifest(_documents(spark, sf_dir), fold("doc_id", 5) == 0).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified",
    )


QUERIES = {
    f.__name__: f for f in (
        op1_exact_topk, op2_language_id, op3_byte_bpe, op4_minhash_near_dedup, op5_exact_dedup, op6_quality,
        op7_token_counts, op8_mixing, op9_repeated_strings, op10_toxicity, op11_host_rules, op12_spelling_variants,
        op13_merkle_manifest,
    )
}

_TOPK = """WITH v AS (
  SELECT vec_id, min([floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding]) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
  GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([coalesce(z[1] * z[2], 0) FOR z IN list_zip(q.w, c.w)])::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

_EXACT = r"""WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content, length(coalesce(text, '')) AS points
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY content) AS group_size,
  doc_id = first_value(doc_id) OVER g AS kept, sha256(content) AS text_sha256
FROM t WINDOW g AS (PARTITION BY content ORDER BY points DESC, doc_id NULLS LAST
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""

_MIX = r"""WITH t AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM t GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + number % 3]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS most FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(most) OVER f - most))
  / sum(weight) OVER (ORDER BY most / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW f AS (ORDER BY most / weight, number)),
g AS (SELECT source, source_size, least(most, weight * max(level) OVER ()) AS target FROM l),
d AS (SELECT t.*, source_size, target, floor(target)::BIGINT AS whole,
  (sum(size) OVER (PARTITION BY t.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS pos
  FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  greatest(least(whole - pos, size), 0) + greatest(least(whole - source_size - pos, size), 0) AS taken,
  ((size > 0 AND pos < whole)::INTEGER + (size > 0 AND pos < whole - source_size)::INTEGER) AS copies
FROM d"""

_NEAR = r"""WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(doc_id, there) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.there),
m AS (SELECT doc_id, min(there) AS component_id FROM reach GROUP BY 1)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM t JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""

_HOST = r"""WITH t AS (
  SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT id, unnest(range(1, len(w) - 1)) AS i, unnest([w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] FOR k IN range(1, len(w) - 1)]) AS g FROM w),
again AS (SELECT id, i FROM p QUALIFY count(*) OVER (PARTITION BY id, g) > 1),
covered AS (SELECT id, count(DISTINCT i + step)::BIGINT AS n FROM again, range(3) s(step) GROUP BY id),
m AS (SELECT w.id, doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered ON covered.id = w.id),
f AS (SELECT id, source, unnest(['few_words', 'repeats', 'symbols', 'dup_lines', 'word_length']) AS rule,
  unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 100 * n_dup_lines > 30 * n_lines,
    word_chars < 2 * n_words OR word_chars > 15 * n_words]) AS failed FROM m),
h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS k FROM f WHERE source IS NOT NULL GROUP BY ALL),
b AS (SELECT rule, sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) - pow(sum(k) / sum(n), 2) AS spread,
  (count(*) - 1) / sum(n) AS sampling, 1 - sum(n::DOUBLE * n) / pow(sum(n), 2) AS shared FROM h GROUP BY rule),
c AS (SELECT rule, mean, least(greatest(coalesce((spread - mean * (1 - mean) * sampling)
  / nullif(mean * (1 - mean) * (shared - sampling), 0), 0.02), 0.02), 0.2) AS r FROM b),
bad AS (SELECT DISTINCT source FROM h JOIN c USING (rule)
  WHERE round((k + mean * (1 - r) / r) / (n + (1 - r) / r), 9) > 0.5),
o AS (SELECT id, bool_or(failed) FILTER (rule IN ('few_words', 'repeats')) AS base_failed FROM f GROUP BY id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  bad.source IS NOT NULL AS host_failed, NOT base_failed AND bad.source IS NULL AS kept
FROM m JOIN o USING (id) LEFT JOIN bad ON bad.source = m.source"""

#: The table of crc32, and its value for a list of bytes; ``lut`` is a column of the one row of crc.
_CRC_TABLE = """bits(i, k, c) AS (SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS lut FROM bits WHERE k = 8)"""


def _crc(text: str) -> str:
    octets = f"flatten([CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [(192 + (ord(ch) >> 6))::BIGINT, (128 + (ord(ch) & 63))::BIGINT] END FOR ch IN string_split({text}, '')])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: xor(a >> 8, lut[1 + (xor(a, b) & 255)])), 4294967295)"


_VARIANTS = f"""WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
h AS (SELECT run, n, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM r, crc),
w AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.rest UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.rest),
best AS (SELECT near.word, near, v.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near,
  row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, near) AS place FROM near JOIN v ON v.word = near.near),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form,
  CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best ON best.word = v.word AND place = 1),
walk(word, root) AS (SELECT word, word FROM f
  UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, root, f.n, f.n_near, f.form_n
FROM f JOIN walk ON walk.word = f.word JOIN f e ON e.word = root WHERE e.form IS NULL"""

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {0})"
_LOW_TEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_MANIFEST = f"""WITH RECURSIVE {_CRC_TABLE},
l AS (SELECT doc_id, source, {_LEAF.format(_FIELD.format("text"))} AS leaf,
  CASE WHEN {_crc("doc_id::VARCHAR")} % 5 = 0 THEN {_LEAF.format(_FIELD.format(_LOW_TEXT))} END AS tampered FROM documents, crc),
t AS (SELECT doc_id, leaf, coalesce(tampered, leaf) AS given, row_number() OVER () AS id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l),
up(s, level, i, n, digest) AS (SELECT s, 0, i, n, leaf FROM t
  UNION ALL SELECT s, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY s, level, i // 16, n),
sub AS (SELECT s, level AS height, digest AS subroot, count(*) OVER () AS n FROM up WHERE n = 1),
top(level, i, n, digest) AS (SELECT 0, s, n, subroot FROM sub
  UNION ALL SELECT level + 1, i // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 16, n),
steps AS (
  SELECT t.id, up.level + 1 AS step, coalesce(string_agg(digest, '' ORDER BY up.i) FILTER (up.i < (t.i >> (4 * up.level))), '') AS a,
    coalesce(string_agg(digest, '' ORDER BY up.i) FILTER (up.i > (t.i >> (4 * up.level))), '') AS b
  FROM t JOIN up ON up.s = t.s AND up.n > 1 AND up.i // 16 = t.i >> (4 * up.level + 4) GROUP BY t.id, up.level
  UNION ALL
  SELECT t.id, height + top.level + 1, coalesce(string_agg(digest, '' ORDER BY top.i) FILTER (top.i < (t.s >> (4 * top.level))), ''),
    coalesce(string_agg(digest, '' ORDER BY top.i) FILTER (top.i > (t.s >> (4 * top.level))), '')
  FROM t JOIN sub ON sub.s = t.s JOIN top ON top.n > 1 AND top.i // 16 = t.s >> (4 * top.level + 4) GROUP BY t.id, height, top.level),
fold(id, step, digest) AS (SELECT id, 0, given FROM t
  UNION ALL SELECT fold.id, fold.step + 1, sha256(a || digest || b) FROM fold JOIN steps ON steps.id = fold.id AND steps.step = fold.step + 1),
ends AS (SELECT id, arg_max(digest, step) AS folded_root FROM fold GROUP BY id),
proofs AS (SELECT id, sha256(string_agg(a || b, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY id)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM t JOIN sub ON sub.s = t.s CROSS JOIN (SELECT digest AS root FROM top WHERE n = 1) JOIN ends ON ends.id = t.id LEFT JOIN proofs ON proofs.id = t.id"""

SQL = {
    "op11_host_rules": _HOST, "op12_spelling_variants": _VARIANTS, "op13_merkle_manifest": _MANIFEST,
    "op1_exact_topk": _TOPK, "op4_minhash_near_dedup": _NEAR, "op5_exact_dedup": _EXACT, "op8_mixing": _MIX,
}
