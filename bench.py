"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints ONE JSON line.

Each query is planned from scratch and fully computed once into Spark's ``noop`` sink (every
row produced, nothing collected to the driver); the reported value is the total wall time.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "r1_build_chains",          # corpus -> chains (one aggregate, one exchange)
    "m5_score_chains",          # BLEU-2, ROUGE-1, ROUGE-2 for every chain and stage
    "m4_rouge_l",               # ROUGE-L (LCS in the same Arrow task)
    "m9_greedy_match_f1",       # greedy token matching in blocks
    "e5_retention_for_chains",  # entity sets and retention for every chain and stage
    "y4_tag_distribution",      # rule tagger + tag shares per version
    "y6_style_features",        # all style features with tree depth per version
    "c3_vocabulary_by_stage",   # cleaning, stopwords, word counts per dataset x stage
    "l3_evaluate_by_stage",     # classification metrics per stage
]


def main() -> None:
    from textdrift.plans.catalog import queries
    from textdrift.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus)), app="textdrift-bench")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textdrift-bench-ckpt-"))
    qs = queries()
    times = {}
    for name in names:
        t = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
