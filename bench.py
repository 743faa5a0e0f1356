"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "keep_first_savings_by_source",  # G1 with tokens before and after
    "token_statistics",  # B1
    "duplicate_sentence_counts",  # F8
    "corpus_first_sentences",  # G1 over the corpus
    "cluster_pairs",  # E2
    "fact_counts_by_source",  # C1
    "light_fact_keys",  # C7
    "status_events",  # C10
    "item_lists",  # F12
    "duplicate_graph",  # J9
    "prompt_features",  # J8
    "savings_report",  # J7
    "safe_cache_matches",  # E18
    "cache_hit_ordinals",  # G12
    "stream_daily_savings",  # S2
    "light_layer",  # J2
)


def main() -> None:
    from pleonasm.catalog import load
    from pleonasm.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus=cpus)
    known = load()
    # One small query first, so that no headline query pays for the start of the session.
    known["token_statistics"].build(spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        known[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder)}))
    spark.stop()


if __name__ == "__main__":
    main()
