"""Command line: ``python -m quartzmill --features PATH --labels PATH [--config FILE] [--quick]``.

Prints the metrics and the comparison with the baseline; the exit code is 1 if a metric is beyond its tolerance.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import sinks
from .plans.run import configured, run
from .sources import sensor_files as S


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="quartzmill", description=__doc__)
    p.add_argument("--features", required=True, help="space-separated feature rows")
    p.add_argument("--labels", required=True, help="labels and timestamps")
    p.add_argument("--n-features", type=int, default=S.N_FEATURES)
    p.add_argument("--config", help="YAML file of settings")
    p.add_argument("--quick", action="store_true", help="a small sample, without elimination, attributions and comparison")
    args = p.parse_args(argv)
    cfg = configured(S.read_config(args.config) if args.config else None)
    spark = spark or SparkSession.builder.appName("quartzmill").getOrCreate()
    rows = S.read_sensors(spark, args.features, args.labels, args.n_features).drop("ts")
    out = run(spark, rows, cfg, args.quick or None)
    print("\n".join(sinks.summary(out["metrics"])))
    print(f"best model by test BER: {out['best_model']}")
    print(f"results: {out['output_dir']}")
    for r in out["baseline_report"] or []:
        print(f"{r['model']} {r['metric']}: expected {r['expected']}, got {r['actual']} [{'ok' if r['ok'] else 'differs'}]")
    return sinks.exit_code(out["baseline_ok"])


if __name__ == "__main__":
    sys.exit(main())
