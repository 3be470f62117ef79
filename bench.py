"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local
threads. Every query runs to completion through the no-op sink. With --all every
registered query is timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagemill.plans import QUERIES  # noqa: E402
from pagemill.session import local_session  # noqa: E402

HEADLINE = [
    "Q13_assess_quality", "H4_extract_main_content", "H4_main_content_tree", "H12_extract_links", "H25_html_to_markdown",
    "U1_normalize_url", "U13_frontier_add", "U16_link_graph_levels", "T1_clean_text", "T4_split_text", "T7_chunk_words", "T9_chunk_chars_stride",
    "T17_top_keywords", "Q9_score_overall_documents", "Q18_flesch_readability", "Q26_analyze_content", "Q31_constraint_checks", "K2_knowledge_chunks",
    "K4_domain_tags", "V1_embed_text", "V4_top_k_similar", "V7_approximate_top_k", "R5_fulltext_search", "R5_fulltext_index", "R16_spell_correct", "R20_bulk_search",
    "W8_analyze_workflow", "W22_workflow_stats", "J1_chunks_of_workflow", "J2_documents_with_chunks", "J7_upsert", "J10_snapshot_diff",
    "A1_content_statistics", "A4_link_analysis", "A17_percentiles", "P1_topic_trend", "P4_anomalies", "P10_content_recommendation",
    "L2_most_common", "Z1_sliding_window_rate", "Z3_token_bucket", "Z4_adaptive_delay", "Z6_presence_sessions", "Z2_stream_tumbling",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = list(QUERIES) if "--all" in sys.argv else HEADLINE
    QUERIES["L1_recent_documents"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the engine
    times = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        if "--verbose" in sys.argv:
            print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
