"""python -m cyclaris.cli pipeline | export | verify | cross-validate"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .plans import pipeline, validate


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cyclaris")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("pipeline")
    run.add_argument("--data-dir", default="data")
    run.add_argument("--max-genomes", type=int, default=200)
    run.add_argument("--seed", type=int, default=42)
    run.add_argument("--summary")
    run.add_argument("--skip-download", action="store_true")
    run.add_argument("--validate-only", action="store_true")
    for name in ("export", "verify"):
        sub.add_parser(name).add_argument("data_dir", nargs="?", default="data")
    sub.choices["verify"].add_argument("--strict", action="store_true")
    sub.add_parser("cross-validate")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("cyclaris").getOrCreate()
    if args.command == "pipeline":
        return pipeline.run_pipeline(spark, args.data_dir, args.max_genomes, args.seed, args.skip_download, args.validate_only, args.summary)
    if args.command == "export":
        pipeline.export(spark, args.data_dir, int(os.environ.get("PIPELINE_MAX", 200)), int(os.environ.get("PIPELINE_SEED", 42)))
        return 0
    if args.command == "verify":
        return pipeline.verify_file(spark, args.data_dir, strict=args.strict)
    found = validate.cross_validation(validate.sequences(spark, validate.test_sequences()), spark)
    found.show(truncate=False)
    return 0 if not found.where("n_failed > 0").count() else 1


if __name__ == "__main__":
    sys.exit(main())
