"""``python -m emberline --input FILE``: the chains of an alert file as JSON lines, then a line with the counters."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from emberline.config import Prefilter, Settings
from emberline.plans.run import run_files


def main() -> None:
    p = argparse.ArgumentParser(prog="emberline")
    p.add_argument("--input", required=True)
    p.add_argument("--window-minutes", type=int, default=60)
    p.add_argument("--severity-floor", default="medium")
    p.add_argument("--trusted-network", action="append", default=[])
    p.add_argument("--service-account", action="append", default=[])
    p.add_argument("--scanner-host", action="append", default=[])
    p.add_argument("--output", help="folder to write the chains to, instead of the screen")
    a = p.parse_args()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    rules = Prefilter(a.severity_floor, tuple(a.trusted_network), tuple(a.service_account), tuple(a.scanner_host))
    run = run_files(spark, a.input, Settings(window_minutes=a.window_minutes, prefilter=rules))
    lines = run.summaries().orderBy("first_time", "cluster_id").select(F.to_json(F.struct("*")).alias("value"))
    if a.output:
        lines.write.text(a.output)
    else:
        for row in lines.toLocalIterator():
            print(row.value)
    print(run.counters().select(F.to_json(F.struct(F.struct("*").alias("summary"))).alias("value")).first().value)


if __name__ == "__main__":
    main()
