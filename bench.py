"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores, BENCH_QUERIES a
comma-separated selection, BENCH_SHARED_DIR the folder for written intermediates.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revlens.plans.registry import all_queries  # noqa: E402
from revlens.session import local_session  # noqa: E402
from revlens.sources.corpus import READ_PARTITIONS  # noqa: E402


HEADLINE = (
    "reviews_unified", "reviews_sample", "source_profile", "reviews_distinct", "by_text_first",
    "prompts", "token_cost", "llm_response_parse", "sentiment_leaderboard", "noisy_reviews",
    "sentiment_wide", "rouge_n", "rouge_l", "bleu", "meteor", "soft_match_f1", "perplexity",
    "best_reference", "polarity", "compression", "summary_leaderboard", "response_leaderboard",
    "tone_alignment", "e2e_detail", "e2e_totals", "batch_infer_log", "pending_calls",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    shared = os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="revlens-bench-")
    spark = local_session("revlens-bench", cpus, spark__checkpoint__dir=shared)
    # the tables are single files that cannot be split: deal them out over the cores
    spark.conf.set(READ_PARTITIONS, str(cpus))
    queries = all_queries()
    names = wanted.split(",") if wanted else list(HEADLINE)
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
