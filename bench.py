"""Headline queries, timed end to end; prints one JSON line.

``BENCH_SF_DIR`` names the folder, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shortlist.catalog import load  # noqa: E402
from shortlist.catalog.features import passages  # noqa: E402
from shortlist.session import local_session  # noqa: E402
from shortlist.sources import tables  # noqa: E402

HEADLINE = (
    "slice_report",
    "recovery_by_band",
    "band_pairs",
    "paired_mcnemar",
    "seed_agreement",
    "miss_anatomy",
    "recovery_ladder",
    "budget_fit",
    "preimage_poisson",
    "size_bias",
    "arm_table",
    "ensemble_report",
    "seed_union",
    "policy_routing",
    "matched_cost",
    "drop_reasons",
    "first_seen_dedup",
    "split_random",
    "split_group",
    "exclude_anti",
    "vocab_build",
    "ambiguity_by_band",
    "ambiguity_by_band_counts",
    "collision_profile",
    "unseen_flag",
    "tanimoto_topk",
    "tanimoto_topk_join",
    "passage_topk_join",
    "retrieval_baseline",
    "threshold_sweep",
    "trace_fit",
    "leaderboard",
)


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    entries = load()
    seconds = {"build_stored_tables": 0.0}
    start = time.perf_counter()
    tables.queries(spark, folder).count()
    tables.judged(spark, folder).count()
    tables.corpus(spark, folder).count()
    seconds["build_stored_tables"] = time.perf_counter() - start
    for name in HEADLINE:
        seconds[name] = timed(lambda: entries[name].run(spark, folder))
    total = sum(seconds.values())
    sf = Path(folder).name.removeprefix("sf")
    n_queries = spark.read.parquet(f"{folder}/benchmark.parquet").count()
    n_items = tables.distinct_items(spark, folder).count()
    n_passages = passages(spark, folder).count()
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(total, 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                "rates": {
                    "retrieval_queries_per_second": round(n_queries / seconds["tanimoto_topk"], 2),
                    "index_passages": n_passages,
                    "million_pairs_per_second_scan": round(n_queries * n_items / seconds["tanimoto_topk"] / 1e6, 3),
                    "million_pairs_per_second_join": round(n_items**2 / seconds["tanimoto_topk_join"] / 1e6, 3),
                    "million_pairs_per_second_passages": round(n_queries * n_passages / seconds["passage_topk_join"] / 1e6, 3),
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
