"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the number of local cores.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.compare import session  # noqa: E402
from checks.queries import all_queries  # noqa: E402

HEADLINES = [
    "txn_breakdown",
    "revenue_summary",
    "revenue_summary_with_ship",
    "revenue_nonderived",
    "revenue_untyped",
    "date_type_filter",
    "wow_change",
    "top_products_revenue",
    "top_sku_only",
    "status_counts",
    "region_top10",
    "daily_trend",
    "weekly_products",
    "fast_movers",
    "decliners",
    "overall_totals",
    "kpi_bundle",
    "clean_money",
    "clean_dates",
    "clean_labels",
    "exact_dedup",
    "first_by_key_subset",
    "cleaning_report",
    "canonical_projection",
    "upsert_last_wins",
    "upsert_into_stored",
    "append_counts",
    "duplicate_precheck",
    "data_health",
    "amount_reconciliation",
    "totals_by_type",
    "profile_sample",
    "header_mapping",
    "csv_roundtrip",
    "full_ingest",
    "replace_then_append",
    "question_answers",
]


def run(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark, queries = session("bench", cores), all_queries()
    run(queries["txn_breakdown"], spark, folder)  # starts the JVM's compilers, not timed
    times = {}
    for name in names:
        times[name] = run(queries[name], spark, folder)
        print(f"{name:28}{times[name]:8.2f} s", file=sys.stderr, flush=True)
    result = {
        "metric": "headline query time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cores": int(cores),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
