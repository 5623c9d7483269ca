"""Queries whose plans change at run time, without broadcast joins, against their SQL."""

import oracle
import pytest

from hushframe.plans import registry

NAMES = [
    "ledger_admission", "ledger_admission_moments", "ledger_admission_advanced", "private_draws", "corr_kendall", "corr_spearman_wide",
    "category_index", "compare_numeric", "wasserstein_real_weights", "profile_growing", "column_kinds",
]


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(adaptive, sf_dir, name):
    query, sql = registry.all_queries()[name], registry.all_sql()[name]
    assert oracle.spark_rows(query(adaptive, sf_dir)) == oracle.sql_rows(oracle.connect(sf_dir), sql)
