"""Benchmark: run every registered query on $BENCH_SF_DIR and print one JSON line.

Each query is executed in full with the ``noop`` sink (nothing is collected
to the driver). A warm-up pass runs every query (trained models excepted)
on the smallest scale folder next to $BENCH_SF_DIR, so code generation is
done before timing; every query is then timed once, warm.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (optional comma list), BENCH_MEMORY (driver memory, default 16g).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pulseframe.plans import catalog  # noqa: E402
from pulseframe.plans.bindings import Domain, wide  # noqa: E402
from pulseframe.session import build_session, ensure_checkpoint_dir  # noqa: E402


MODEL_QUERIES = {"feature_importance", "local_influence", "predict", "regression_scatter", "segmentation"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", cpus * 2, app_name="pulseframe-bench",
                          extra={"spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    ensure_checkpoint_dir(spark)
    qs = catalog.queries()
    only = os.environ.get("BENCH_QUERIES")
    names = [n for n in sorted(qs) if not only or n in only.split(",")]

    def run(name: str) -> float:
        t = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    # Warm-up: every query once on the smallest scale (same plan shapes, so
    # the generated code is compiled before the timed runs); trained models
    # are skipped there. Then each query is timed once on the bench scale.
    warm_dir = os.environ.get("BENCH_WARM_DIR", os.path.join(os.path.dirname(sf_dir), "sf0.001"))
    warm = os.path.isdir(warm_dir) and warm_dir != sf_dir
    for n in names:
        if warm and not n.startswith(("train_", "cv_")) and n not in MODEL_QUERIES:
            try:
                qs[n](spark, warm_dir).write.format("noop").mode("overwrite").save()
            except Exception:  # noqa: BLE001 - the timed run reports failures
                pass
    # The stored tables are built first, each under an entry of its own, so
    # that no query is charged for them and none of their work goes unseen.
    times, failed = {}, {}
    for n, build in (("build_score_history", lambda d: d.history), ("build_users_met_scores", wide)):
        t = time.perf_counter()
        build(Domain(spark, sf_dir))
        times[n] = round(time.perf_counter() - t, 3)
    for n in names:
        try:
            times[n] = round(run(n), 3)
        except Exception as e:  # noqa: BLE001 - report and continue
            failed[n] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
        "n_queries": len(times),
        "warmup": os.path.basename(warm_dir) if warm else None,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
