"""Command line: ``python -m cellweave.plans.cli {random2d,random3d,compare} ...`` (or through spark-submit)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from cellweave.plans import experiments

OPTIONS = {
    "random2d": {"rules": 5, "initial_conditions": 4, "size": 24, "steps": 50},
    "random3d": {"rules": 100, "initial_conditions": 20, "size": 64, "steps": 500},
    "compare": {"rules": 1, "initial_conditions": 20, "size_2d": 64, "size_3d": 32, "steps": 100, "rule_2d": "B3/S23", "rule_3d": "B6/S5,6,7"},
}


def main(argv: list[str] | None = None) -> str:
    parser = argparse.ArgumentParser(description="Rule sweeps over random grids")
    kinds = parser.add_subparsers(dest="kind", required=True)
    for kind, options in OPTIONS.items():
        own = kinds.add_parser(kind)
        for name, value in (options | {"density": 0.10, "seed": 42}).items():
            own.add_argument("--" + name.replace("_", "-"), dest=name, type=type(value), default=value)
        own.add_argument("--output-dir", default=None)
    request = vars(parser.parse_args(argv))
    kind, target = request.pop("kind"), request.pop("output_dir")
    spark = SparkSession.builder.appName(f"cellweave-{kind}").getOrCreate()
    run = {"random2d": experiments.random_2d_experiment, "random3d": experiments.random_3d_experiment, "compare": experiments.compare_dimensions}[kind]
    rows, manifest = run(spark, **request)
    written = experiments.save_experiment(rows, manifest, {"random2d": "random_2d", "random3d": "random_3d", "compare": "compare_dimensions"}[kind], target)
    print(f"{kind}: results in {written}")
    return written


if __name__ == "__main__":
    main()
