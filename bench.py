"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from stratacode.plans.queries import QUERIES

sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
cpus = os.environ.get("BENCH_CPUS", "8")
spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))  # timed runs of a query, after one that compiles
MOST_SECONDS = 400  # later queries are timed once beyond
times, start = {}, time.perf_counter()
for name, query in QUERIES.items():
    runs = []
    for n in range(1 + RUNS):
        if runs and time.perf_counter() - start > MOST_SECONDS:
            break
        began = time.perf_counter()
        query(spark, sf).write.format("noop").mode("overwrite").save()
        if n:  # the first compiles code
            runs.append(time.perf_counter() - began)
    times[name] = round(statistics.median(runs), 3)
print(json.dumps({"metric": "total seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
spark.stop()
