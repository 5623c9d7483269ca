"""Registered queries against their SQL, and the pipeline against plain stages."""

from collections import Counter

import corpus_pipeline
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from hushframe.llm import contentsort, minhash, mixing, toxicity
from hushframe.llm.queries import QUERIES, SQL, TOXIC_SCORE, toxicity_scores

from test_operators import plain_components, plain_sets

COLUMNS = {
    "op1_exact_topk": ["query_id", "rank", "vec_id", "score"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_minhash_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op5_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op6_quality": ["doc_id", "held_out", "score", "predicted"],
    "op7_token_counts": ["doc_id", "n_tokens", "n_tokens_after"],
    "op8_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op9_repeated_strings": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op11_host_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op13_merkle_manifest": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert oracle.spark_rows(QUERIES[name](spark, sf_dir)) == oracle.sql_rows(oracle.connect(sf_dir), SQL[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_per_document(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    assert set(COLUMNS[name]) <= set(got.columns)
    if name != "op1_exact_topk":
        ids = [r.doc_id for r in got.select("doc_id").collect()]
        assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    held, columns = docs, docs.columns
    want = {
        "toxicity": lambda d: toxicity_scores(d, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 0"),
        "exact_dedup": lambda d: contentsort.exact_duplicates(d).where("kept"),
        "near_dedup": lambda d: minhash.near_duplicates(d).where("kept"),
    }
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = corpus_pipeline.materialize(stage(spark, held, sf_dir))
        assert after.columns == columns
        assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in want[name](held).collect())
        held = after
    mixed = corpus_pipeline.materialize(corpus_pipeline.mix_sources(spark, held, sf_dir))
    copies = {r.doc_id: r.copies for r in mixing.mix(held).collect() if r.copies}
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == copies
    final = corpus_pipeline.encode(spark, mixed, sf_dir)
    assert final.count() == mixed.count()
    assert sorted(corpus_pipeline.run(spark, sf_dir).collect()) == sorted(final.collect())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_nothing_and_nulls(spark, sf_dir, name, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert stage(spark, docs.where("false"), sf_dir).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "a", None, None, None), (1, "a", None, None, None), (2, "", "x", "s", 0)], docs.schema)
    got = stage(spark, odd.selectExpr("*", "1 AS _id", "'x' AS copies"), sf_dir)
    assert got.count() >= (2 if name == "mixing" else 3)


#: Names a stage might use itself, and one that stands for the key of rows.
NAMES = [
    "_file", "_at", "_number", "_score", "_copies", "_pass", "_row_key", "row", "row_key", "row_key_", "score_of_row", "times_taken", "turn_of_row", "key",
    "file_of_row", "place_of_row", "number_of_file", "size", "kept", "bucket", "digest", "content", "score", "copies", "number", "bits", "component", "_metadata",
]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_keep_columns_of_any_name(spark, sf_dir, name, stage):
    """Rows and their other columns come out as they went in, from files and from elsewhere."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    named = docs.select("*", *[F.concat(F.lit(f"{n}:"), "doc_id").alias(n) for n in NAMES])
    plain = Counter(map(tuple, stage(spark, corpus_pipeline.materialize(docs), sf_dir).collect()))
    for rows in (corpus_pipeline.materialize(named), named.repartition(3, "doc_id")):
        got = stage(spark, rows, sf_dir)
        if name == "byte_bpe":
            assert Counter(map(tuple, got.collect())) == plain
            continue
        assert got.columns == named.columns
        found = got.collect()
        assert all(r[n] == f"{n}:{r.doc_id}" for r in found for n in NAMES)
        assert Counter(tuple(r[: len(docs.columns)]) for r in found) == plain


def test_stages_decide_row_by_row(spark, sf_dir, monkeypatch):
    """A third of the ids is null and every fifth row is there twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    docs = corpus_pipeline.materialize(docs.union(docs.where("n_chars % 5 = 0")))
    rows = [tuple(r) for r in docs.collect()]
    text = docs.columns.index("text")

    longer = np.zeros(toxicity.FEATURES + 1)
    longer[-2] = 1.0  # scores follow the number of windows
    model = toxicity.Model(b"ordinary words " * 20, b" horridword ", np.zeros(toxicity.FEATURES), np.ones(toxicity.FEATURES), longer)
    model.weights[0] = -np.log(np.median([len(r[text] or "") for r in rows]) / toxicity.WINDOW) - 0.85
    monkeypatch.setattr(corpus_pipeline, "toxicity_model", lambda *_: model)
    clean = [r for r in rows if model.score((r[text] or "").encode()) < TOXIC_SCORE]
    assert {r[0] is None for r in clean} == {r[0] is None for r in rows if r not in clean} == {True, False}
    assert Counter(map(tuple, corpus_pipeline.drop_toxic(spark, docs, sf_dir).collect())) == Counter(clean)

    def content(r):
        return "".join(c for c in r[text] or "" if c not in " \t\n\x0b\x0c\r")

    best = {}
    for r in sorted(rows, key=lambda r: (-len(r[text] or ""), r[0] is None, r[0] or 0)):
        best.setdefault(content(r), r)
    single = corpus_pipeline.materialize(corpus_pipeline.drop_copies(spark, docs, sf_dir))
    got = [tuple(r) for r in single.collect()]
    assert Counter(map(content, got)) == Counter(dict.fromkeys(best, 1))
    assert Counter(r[0] for r in got) == Counter(r[0] for r in best.values())

    sets = plain_sets([r[text] for r in rows])
    component = plain_components(sets)
    want = Counter()
    for c in set(component):
        own = [r for r, k in zip(rows, component, strict=True) if k == c]
        want[min(own, key=lambda r: (r[0] is None, r[0] or 0))[0]] += 1
    near = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()]
    assert Counter(r[0] for r in near) == want

    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] += r.copies
    mixed = [tuple(r) for r in corpus_pipeline.mix_sources(spark, docs, sf_dir).collect()]
    assert Counter(r[0] for r in mixed) == +copies
