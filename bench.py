"""Times the registered queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` an
optional comma-separated selection. Every query is run to its full result. Inputs that several
queries share (the rendered history, its cleaning, the predictions, the retrieval index) are built
first, timed apart and counted in the total and the headline. Shuffle bytes come from the event log. The headline queries also run on the next smaller data set, so the
line shows how they scale. After ``BENCH_BUDGET_SEC`` no further query starts; the line names those
left out.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from ticketlake.plans.queries import _cleaned, _predictions, _raw, _retrieved  # noqa: E402
from ticketlake.plans.registry import QUERIES  # noqa: E402
from ticketlake.session import local_session  # noqa: E402

HEADLINE = (
    "p1_dates", "p2_catalog", "p5_valid", "w1_dedup_clean", "w1_dedup_quarantine", "a5_quality",
    "a3_summary", "a1_area", "j2_detail", "a2_discrepancy", "a9_monthly", "a10_attention",
    "p8_list", "p10_accepted", "w13_numbering", "r1_intake_batch", "t2_rules", "t3_model_output",
    "a16_nb_model", "w8_split_row", "w7_nb_predict", "a18_class_metrics", "t1_chunks",
    "a20_tfidf", "w5_topk", "t4_gates", "a21_evaluate", "a23_sweep", "a11_latency", "a13_tokens",
    "r2_metrics_batch", "w9_business_days", "j5_reminders",
)
SETUP = {
    "setup_history": _raw,
    "setup_cleaning": lambda spark, sf_dir: _cleaned(spark, sf_dir).report,
    "setup_predictions": lambda spark, sf_dir: _predictions(spark, sf_dir)[1],
    "setup_retrieval": _retrieved,
}


def shuffled_mb(log: Path, spans: dict[str, tuple[float, float]]) -> dict[str, float]:
    """MB of shuffle written by the tasks launched inside each span."""
    written = dict.fromkeys(spans, 0)
    for part in log.rglob("*"):
        if not part.is_file():
            continue
        with part.open(errors="replace") as lines:
            for line in lines:
                if '"SparkListenerTaskEnd"' not in line:
                    continue
                event = json.loads(line)
                at = event["Task Info"]["Launch Time"] / 1000
                metrics = (event.get("Task Metrics") or {}).get("Shuffle Write Metrics", {})
                for name, (start, end) in spans.items():
                    if start <= at <= end:
                        written[name] += metrics.get("Shuffle Bytes Written", 0)
    return {name: round(n / 1e6, 2) for name, n in written.items()}


def timed(spark: SparkSession, runs: dict, sf_dir: str, deadline: float) -> dict[str, tuple[float, float]]:
    spans = {}
    for name, run in runs.items():
        start = time.time()
        if start > deadline:
            break
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        spans[name] = start, time.time()
    return spans


def seconds(spans: dict[str, tuple[float, float]]) -> dict[str, float]:
    return {name: round(end - start, 3) for name, (start, end) in spans.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    deadline = time.time() + float(os.environ.get("BENCH_BUDGET_SEC", "420"))
    rest = [name for name in QUERIES if name not in HEADLINE]
    names = chosen.split(",") if chosen else [*HEADLINE, *rest]
    log = Path(tempfile.mkdtemp(prefix="bench-log-"))
    os.environ.setdefault(
        "PYSPARK_SUBMIT_ARGS",
        f"--conf spark.eventLog.enabled=true --conf spark.eventLog.dir=file://{log} "
        "--conf spark.eventLog.compress=false pyspark-shell",
    )
    start = time.time()
    spark = local_session("bench", cores, shuffle_partitions=int(cores))
    spark.range(1).count()
    session = {"session": (start, time.time())}
    setup = session | timed(spark, SETUP, sf_dir, deadline)
    queries = {name: QUERIES[name] for name in names}
    main_spans = timed(spark, queries, sf_dir, deadline)
    scale = float(os.path.basename(sf_dir).removeprefix("sf"))
    smaller = f"{os.path.dirname(sf_dir)}/sf{scale / 10:g}"
    small_spans = {}
    if not chosen and os.path.isdir(smaller):
        small = {f"{name}@small": run for name, run in SETUP.items()}
        small |= {f"{name}@small": QUERIES[name] for name in HEADLINE}
        small_spans = timed(spark, small, smaller, time.time() + 60)
    spark.stop()
    mb = shuffled_mb(log, main_spans | small_spans)
    timings = seconds(main_spans)
    inputs = sum(seconds({name: setup[name] for name in SETUP if name in setup}).values())
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(inputs + sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": f"{scale:g}",
                "headline": round(inputs + sum(timings.get(name, 0) for name in HEADLINE), 3),
                "setup": seconds(setup),
                "shuffle_mb": {name: mb[name] for name in main_spans},
                "smaller_sf": f"{scale / 10:g}",
                "smaller": {
                    name.removesuffix("@small"): {"sec": sec, "shuffle_mb": mb[name]}
                    for name, sec in seconds(small_spans).items()
                },
                "not_run": [name for name in names if name not in main_spans],
            }
        )
    )


if __name__ == "__main__":
    main()
