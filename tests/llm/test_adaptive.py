"""The operators with the most joins as shipped: adaptive plans, no broadcast joins."""

import oracle
import pytest

from hushframe.llm import suffixes
from hushframe.llm.queries import QUERIES, SQL

from test_operators import plain_repeats, repeated_texts, table


@pytest.mark.parametrize("name", ["op4_minhash_near_dedup", "op5_exact_dedup", "op8_mixing", "op12_spelling_variants", "op13_merkle_manifest"])
def test_same_as_sql(adaptive, sf_dir, name):
    assert oracle.spark_rows(QUERIES[name](adaptive, sf_dir)) == oracle.sql_rows(oracle.connect(sf_dir), SQL[name])


def test_repeated_strings(adaptive):
    texts = repeated_texts()
    wanted = plain_repeats(texts)
    for r in suffixes.without_repeats(table(adaptive, texts), sent=0).collect():
        size, ranges, kept = wanted[r.doc_id]
        assert (r.n_bytes, [tuple(x) for x in r.removed], bytes(r.kept)) == (size, ranges, kept)
