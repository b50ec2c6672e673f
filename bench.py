"""Headline timings: one JSON line on stdout.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores. Each query is forced in full
through the no-op sink. ``verify_chains`` reads chains that were built and stored once.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "chain_build_heads",
    "access_payloads",
    "chain_entry_hash",
    "verify_chains",
    "verify_chains_tampered",
    "chain_heads_by_time",
    "link_check",
    "running_hash",
    "fingerprint_queries",
    "analyze_queries",
    "build_access_events",
    "build_doc_events",
    "build_object_events",
    "attribute_actor",
    "process2_divergence",
    "table_checksum",
    "merge_ranges",
    "failure_streaks",
    "connection_count",
    "token_bucket_ip",
    "canonical_documents",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from chainlake.session import get_spark

    spark = get_spark(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    from chainlake.operators.chain import verify_chains
    from chainlake.plans import fixtures, load
    from chainlake.plans.observer import observer_chain

    registered = dict(load()[0])
    registered["verify_chains"] = lambda s, d: verify_chains(fixtures.chains(s, d))

    # Start the Python workers before timing anything.
    spark.range(8).repartition(8).mapInPandas(lambda it: it, "id long").count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        if name == "verify_chains":
            fixtures.chains(spark, sf_dir)
        if name == "process2_divergence":
            observer_chain(spark, sf_dir)
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    entries = fixtures.chains(spark, sf_dir).count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "chain_entries": entries,
                "verified_entries_per_sec": round(entries / times["verify_chains"]),
            }
        )
    )


if __name__ == "__main__":
    main()
