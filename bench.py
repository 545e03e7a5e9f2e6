"""Seconds per headline query. Prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose the data and the cores. Every query runs to the end into the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from primrose.plans.queries import QUERIES  # noqa: E402
from primrose.session import local_session  # noqa: E402

HEADLINE = [
    "corpus_stats",
    "top_bigrams",
    "bigram_presence",
    "label_bigram_probs",
    "count_terms",
    "ngram_terms",
    "tfidf_terms",
    "word_presence",
    "apply_vocabulary",
    "naive_bayes_table",
    "naive_bayes_predict",
    "informative_features",
    "classify_validity",
    "long_enough",
    "html_to_text",
    "extract_links",
    "attach_crawled",
    "merge_crawl_results",
    "commit_batches",
    "size_chunks",
    "fill_rating_slots",
    "rating_audit_log",
    "describe_column",
    "binned_counts",
    "annotation_batches",
    "partial_label_counts",
    "train_test_split",
    "first_feed_wins",
    "new_items",
    "stored_status",
    "classification_report",
    "fit_logistic",
    "stream_capture",
    "stream_ratings",
]


def seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "primrose-bench")
    spark.sparkContext.setLogLevel("ERROR")
    for warm in ("corpus_stats", "binned_counts"):
        seconds(spark, warm, folder)
    times = {}
    for name in names:
        times[name] = round(seconds(spark, name, folder), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
