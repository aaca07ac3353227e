"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from ledgerspark.plans import QUERIES
from ledgerspark.session import local_session
from ledgerspark.sources import fixture

HEADLINE = [
    "g3_reachable", "p8_pattern_signals",
    "g1_address_edges", "g4_k_hop_exposure", "g4_k_hop_exposure_full", "g5_entity_exposure", "g6_tx_stats",
    "r8_batch_risk", "a8_resolve_addresses", "k2_cio_clusters", "n7_resolve_prevouts", "u4_link_spent_outputs",
    "t5_trace_cases", "t12_ledger_hops", "c6_actor_matches", "e5_data_quality", "w1_stream_ingest", "w2_error_rate",
    "w3_latency_p95", "h7_window_24h_volume", "h10_peeling_chain",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    began = time.time()
    fixture.ledger(spark, sf_dir)
    prepared = time.time() - began
    seconds = {}
    for name in wanted:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf_dir.rsplit("sf", 1)[-1], "derive_ledger_seconds": round(prepared, 3), "cpus": cpus}))


if __name__ == "__main__":
    main()
