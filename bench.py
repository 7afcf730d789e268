"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from diamondframe.plans.queries import all_queries  # noqa: E402
from diamondframe.session import local_session  # noqa: E402
from diamondframe.sources.pitches import pitch_table  # noqa: E402

HEADLINE = [
    "run_expectancy", "run_values", "inning_runs", "inning_trajectory", "hitter_profiles",
    "generic_hitter_profiles", "pitcher_profiles", "training_table", "model_features",
    "stratified_folds", "candidate_grid", "expected_runs", "best_pitch", "recommend",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()  # the session is up

    begin = time.time()
    pitches = pitch_table(spark, sf_dir).count()
    seconds = {"pitch_table": time.time() - begin}
    for name in chosen:
        # The whole query, the tables it writes on the way included, without a sink.
        begin = time.time()
        all_queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = time.time() - begin
    total = sum(seconds.values())
    print(json.dumps({
        "metric": "headline queries, total time",
        "value": round(total, 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in seconds.items()},
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "pitches": pitches,
        "pitches_per_sec": {k: round(pitches / v) for k, v in seconds.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
