"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the local cores. Every query runs to a no-op sink, so all of its rows are
computed. It runs twice and the second, warm run is reported, like the published
figures. Stored summaries are also built and read back.
"""

from __future__ import annotations

import json
import os
import time

from demarca.plans.details import municipality_wide_from
from demarca.session import build_session
from demarca.sources.sinks import overwrite
from demarca.sources.summaries import build_summaries, summary_or_live
from workbench.catalogue import QUERIES
from workbench.kit import Tables
from workbench.q_finance import wide_sources
from workbench.scratch import scratch_folder

HEADLINE = [
    "treemap_by_state",
    "sector_grade_matrix",
    "crime_yearly",
    "crime_summary_live",
    "mortality_yearly",
    "municipality_panel",
    "tracts_with_counts",
    "tract_activity_opportunity",
    "income_survey_by_state",
    "labour_survey_by_state",
    "housing_finance_by_municipality",
    "traffic_by_municipality",
    "municipality_wide",
    "registry_points_per_area",
    "points_near_anchors",
    "licence_geocoding",
    "tile_rows_capped",
    "deduplicated_lines",
    "weighted_percentiles",
    "folded_text_flags",
]


#: Stored summaries, cheap ones first, as (name, query that builds it).
STORED = ["treemap_by_state", "mortality_yearly", "crime_yearly", "sector_grade_matrix"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        int(cpus),
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.dataFrameQueryContext.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        run(QUERIES[name](spark, sf))
        times[name] = timed(lambda: run(QUERIES[name](spark, sf)))
    root = scratch_folder(spark)
    builders = {n: (lambda n: lambda: QUERIES[n](spark, sf))(n) for n in STORED}
    times["refresh_all_stored"] = timed(lambda: build_summaries(builders, root, STORED))
    for name in STORED:
        read = summary_or_live(spark, f"{root}/{name}", builders[name])
        run(read)
        times[f"{name}_stored_read"] = timed(
            lambda: run(summary_or_live(spark, f"{root}/{name}", builders[name]))
        )
    sources = wide_sources(Tables(spark, sf))
    keep = {n: (lambda df: lambda: df)(df) for n, df in sources.items()}
    times["refresh_wide_sources"] = timed(lambda: build_summaries(keep, f"{root}/wide", list(keep)))

    def stored_wide():
        return municipality_wide_from({n: spark.read.parquet(f"{root}/wide/{n}") for n in keep})

    run(stored_wide())
    times["municipality_wide_stored_read"] = timed(lambda: run(stored_wide()))
    joined = f"{root}/wide/joined"
    times["refresh_wide_joined"] = timed(lambda: overwrite(stored_wide(), joined))
    run(spark.read.parquet(joined))
    times["municipality_wide_joined_stored_read"] = timed(lambda: run(spark.read.parquet(joined)))
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
