"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores, BENCH_QUERIES an
optional comma-separated list of query keys. Every query is run to the end with its whole
output (Spark's ``noop`` sink), once to warm up on the small tables and once for the time.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "f1_word_count",
    "f6_clean_chunk_text",
    "f8_format_answer",
    "p15_page_media_extract",
    "s2_scan_caption_items",
    "c1_parse_inline_timestamps",
    "c4_validate_segments",
    "c5_chunk_segments",
    "c6_chunk_segments_fixed",
    "c7_chunk_text",
    "c8_choose_chunker",
    "c9_select_transcript",
    "e2_zero_vector_fallback",
    "j1_similarity_join",
    "j1_similarity_join_large",
    "j2_similarity_join_unscoped",
    "w1_topk_per_question",
    "w4_latest_wins",
    "k1_upsert_vectors",
    "k4_ingest_report",
    "a6_build_context",
    "a8_format_qa_session",
    "q1_ingest",
    "q3_search",
    "q4_ask",
    "q4_assemble_answers",
    "q5_summarize",
    "q6_quality_report",
    "t1_stream_ingest",
    "t2_stream_chunk_segments",
]


def main() -> None:
    from talkmill.queries import QUERIES
    from talkmill.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session("bench", cpus, os.environ.get("BENCH_MEMORY", "12g"))

    def run(key: str, folder: str) -> float:
        begin = time.perf_counter()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    times = {}
    for key in chosen:
        if os.path.isdir(warm_dir):
            run(key, warm_dir)
        times[key] = round(run(key, sf_dir), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
