"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3, after one
warm-up), BENCH_QUERIES (names or 'all'). Every query writes all its rows to the noop sink; the value is
the sum of the medians."""

from __future__ import annotations

import json
import os
import statistics
import time

from carlake.session import local_session
from checks import all_queries
from checks.registry import QUERIES, Tables

HEADLINES = [
    "N08_worst_sentiment", "T01_sentiment", "T09_extract_makers", "T12_tag_articles", "T15_event_dates",
    "T17_tag_events", "T18_scope_words", "T19_drop_sentences", "P01_standardize_name", "P09_clean_text_documents",
    "P18_complaint_facts", "P18_investigation_facts", "P18_rating_facts", "D03_categorize", "D17_clean_recalls",
    "R01_dedup", "R03_pivot_series", "A08_share", "A09_n_distinct", "A11_sentiment_mix", "A12_compare_makers",
    "L05_top_k_per", "J01_make_scorecard", "J02_inner_count", "J03_join_vehicle", "K06_upsert_articles",
    "N17_sentiment_by_drive", "Q01_search_news", "Q09_briefing", "G04_screen_sql", "G07_approval_needed",
    "M01_column_roles", "M03_quartiles", "M05_vector_topk", "M01_column_roles_estimated", "M05_vector_topk_many",
]
# text rules over 600,000 sentences (lineitem rows at sf0.1); the published figure is 100 to 200 rows/s
RATED = {"T01_sentiment": "lineitem", "T12_tag_articles": "events", "T18_scope_words": "orders"}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    all_queries()
    names = list(QUERIES) if chosen == "all" else [n for n in (chosen.split(",") if chosen else HEADLINES) if n in QUERIES]
    spark = local_session(cores, 8, "12g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](Tables(spark, folder)).write.mode("overwrite").format("noop").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    rates = {
        n: round(spark.read.parquet(f"{folder}/{t}.parquet").count() / seconds[n]) for n, t in RATED.items() if n in seconds
    }
    line = {
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")), "cores": cores, "rows_per_sec": rates,
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
