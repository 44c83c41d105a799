"""Headline queries, each timed to its last row on local[$BENCH_CPUS] over $BENCH_SF_DIR; one JSON line.

Besides the registered queries: scans of stored logs, pristine (one version an id) and churned (three), narrow and wide, and
of each query the part of its time that goes into planning.
"""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "scan_aggregate", "range_top10", "range_between", "get_by_id", "find_by_status", "list_page", "projection_card", "order_customer", "customer_orders",
    "order_with_relations", "part_suppliers", "junction_pairs", "restrict_children", "live_latest", "as_of_scan", "storage_stats", "live_query_delta", "change_feed",
]
RUNS = 3


def stored_scans(spark, folder: str) -> dict:
    """Name -> query over logs that are written here first."""
    from quern import queries
    from quern.operators.access import Table

    log, place, out = queries.order_log(spark, folder), tempfile.mkdtemp(prefix="bench-"), {}
    kept = queries.orders(spark, folder).rows().selectExpr("*", "false AS _deleted")
    for name, df in (("pristine", kept), ("churned", log)):
        path = f"file://{place}/{name}"
        df.write.parquet(path)
        table = Table(queries.catalog(), "Order", spark.read.schema(df.schema).parquet(path))
        out[f"{name}_narrow"] = lambda t=table: t.scan(["o_totalprice"])
        out[f"{name}_wide"] = lambda t=table: t.all()
        out[f"{name}_count"] = lambda t=table: t.live_rows()
    return out


def main() -> None:
    from pyspark.sql import SparkSession

    from quern import queries

    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made = {name: (lambda n=name: queries.QUERIES[n](spark, folder)) for name in HEADLINE} | stored_scans(spark, folder)
    times, plans = {}, {}
    for name, make in made.items():
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            df = make()
            df._jdf.queryExecution().executedPlan()
            planned = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            took.append((time.perf_counter() - began, planned - began))
        times[name], plans[name] = (round(min(x[i] for x in took[1:]), 4) for i in (0, 1))
    line = {"metric": "headline_queries_total", "value": round(sum(times[n] for n in HEADLINE), 3), "unit": "sec", "queries": times, "planning": plans, "sf": Path(folder).name.removeprefix("sf")}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
