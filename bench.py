"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with the median of three warm runs of each."""

import json
import os
import statistics
import time

from quarry import queries
from quarry.session import get_session

HEADLINE = [
    "chunk_documents", "html_strip", "html_outcome_fallback", "tokenize_stats", "postings", "doc_frequency", "bm25_top", "bm25_filtered", "bm25_multi_field", "cosine_top", "cosine_many",
    "rrf_fusion", "hybrid_search", "hybrid_filtered", "hybrid_reranked", "sync_diff", "retry_keys", "rebuild_versions", "upsert_chunks", "tags_list", "status_breakdown", "change_hash",
    "bm25_grammar", "bm25_stemmed", "phrase_query", "note_strip", "clean_text", "issues_list", "index_counts", "find_items", "stored_snapshot",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": "8g", "spark.sql.files.maxPartitionBytes": "4m", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            queries.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs[1:]), 3)
    sf = sf_dir.rstrip("/").rpartition("sf")[2]
    print(json.dumps({"metric": "total of median warm seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
