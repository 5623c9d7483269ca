"""Headline timings: profile, protect, compare, divergences on lineitem.

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hushframe.operators import (  # noqa: E402
    advise, compare, correlate, divergence, ledger, profile,
)
from hushframe.operators.protect import EXCLUDE, ColumnRule, protect  # noqa: E402
from hushframe.plans import advice, budgets  # noqa: E402
from hushframe.session import local_session  # noqa: E402
from hushframe.sources import readers, writers  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXT = ["l_returnflag", "l_linestatus"]
RULES = {
    "row_key": ColumnRule(EXCLUDE),
    "l_orderkey": ColumnRule(lower=0, upper=150_000, epsilon=2.0),
    "l_partkey": ColumnRule(lower=0, upper=20_000, epsilon=2.0),
    "l_suppkey": ColumnRule(lower=0, upper=1_000, epsilon=2.0),
    "l_linenumber": ColumnRule(lower=1, upper=7, epsilon=2.0),
    "l_quantity": ColumnRule(lower=1, upper=50, epsilon=1.0),
    "l_extendedprice": ColumnRule(epsilon=1.0, mechanism="gaussian", sensitivity=100_000.0),
    "l_discount": ColumnRule(lower=0, upper=0.1, epsilon=1.0),
    "l_tax": ColumnRule(lower=0, upper=0.08, epsilon=1.0),
    "l_returnflag": ColumnRule(epsilon=1.0, score_sensitivity=1000.0),
    "l_linestatus": ColumnRule(epsilon=1.0, score_sensitivity=1000.0),
    "l_shipdate": ColumnRule(epsilon=1.0, lower="1992-01-01", upper="2002-12-31"),
}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, "bench", **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    scratch = tempfile.mkdtemp(prefix="bench-")
    raw = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").repartition(CPUS)
    lines = readers.with_row_key(raw, f"{scratch}/lineitem.parquet")
    shown = lines.drop("row_key")
    paired_path, out_path = f"{scratch}/pairs", f"{scratch}/release.parquet"

    def release(**options):
        return protect(lines, RULES, ["row_key"], "bench-secret", "bench", **options)

    def paired():
        return spark.read.parquet(paired_path)

    steps = {
        "column_kinds": lambda: run(readers.column_kinds(shown)),
        "profile_numeric": lambda: run(profile.profile_numeric(shown, NUMERIC)),
        "profile_categorical": lambda: run(profile.profile_categorical(shown, TEXT)),
        "profile_dates": lambda: run(profile.profile_dates(shown)),
        "missing_summary": lambda: run(profile.missing_summary(shown)),
        "duplicate_rows": lambda: run(profile.duplicate_rows(shown)),
        "corr_pearson": lambda: run(correlate.correlation_pairs(shown, NUMERIC)),
        "corr_spearman": lambda: run(correlate.correlation_pairs(shown, NUMERIC[:2], "spearman")),
        "corr_kendall": lambda: run(correlate.correlation_pairs(shown, NUMERIC[:2], "kendall")),
        "protect": lambda: run(release().data),
        "protect_pairs": lambda: release(keep_original=True, unique_key=True).data.write.parquet(paired_path),
        "compare_numeric": lambda: run(compare.compare_numeric(paired(), NUMERIC)),
        "compare_categorical": lambda: run(compare.compare_categorical(paired(), TEXT)),
        "compare_dates": lambda: run(compare.compare_dates(paired())),
        "compare_correlations": lambda: run(compare.correlation_preservation(paired(), NUMERIC)),
        "all_divergences": lambda: run(divergence.all_divergences(paired(), NUMERIC, TEXT)),
        "recommend": lambda: run(advise.recommend_dataset(shown)),
        "classify_catalog": lambda: run(advice.QUERIES["classify_columns"](spark, SF_DIR)),
        "ledger_admission": lambda: run(budgets.QUERIES["ledger_admission"](spark, SF_DIR)),
        "ledger_status": lambda: run(ledger.status(budgets.entries(spark, SF_DIR), budgets.budgets(spark, SF_DIR))),
        "export_parquet": lambda: writers.export_parquet(paired().select("prot.*"), out_path),
    }
    timings = {}
    for name, step in steps.items():
        start = time.perf_counter()
        step()
        timings[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "release_steps_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(SF_DIR.rstrip("/")), "rows": lines.count(),
    }))


if __name__ == "__main__":
    main()
