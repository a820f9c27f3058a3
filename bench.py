"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "M1_pair_notes", "A10_weighted_median", "A11_polyphony", "A12_part_summary", "A13_detect_key", "J10_notes_in_range",
    "R8_stride_sample", "M12_ride_gain", "C1_build_index", "C3_bleed_risk", "J1_source_summary", "A2_diagnostics_summary",
    "S8_effective_lexicon", "S3_load_lexicon", "A21_coverage_report", "C6_transcript_gaps", "J7_verify_captions", "R5_best_takes",
    "Q2_best_run", "Q8_ngram_counts", "F5_splice_edges", "T5_apply_edits",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from wordclips import build_session
    from wordclips.plans.queries import QUERIES

    spark = build_session("bench", cores=cpus, shuffle_partitions=str(max(8, 2 * int(cpus))))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").count()
    took: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        # Every row and column is computed, nothing is brought to the driver.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
