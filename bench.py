"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

A query's time covers building its plan, every counting pass it runs and writing the whole result to a
sink that discards it. The best of two runs is reported; the steps at the study's full sample size run
once, each stored as Parquet.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from panelkit.operators import profile, regress, resample  # noqa: E402
from panelkit.session import keep, keep_bucketed, local_session  # noqa: E402
from testbed import views  # noqa: E402
from testbed.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "metrics",
    "metrics_threshold",
    "metrics_carried",
    "yearly_panel",
    "grid_monthly",
    "grid_explode",
    "panel_enriched",
    "cohort",
    "metrics_wide",
    "summary_stats",
    "boxplot_metric",
    "boxplot_outliers",
    "hexbin_limits",
    "grouped_quantiles",
    "classified",
    "year_report",
    "resample",
    "sample_rows",
    "ols_coefs",
    "residuals",
    "mae",
    "confidence_band",
    "ratio_median",
    "coef_density",
    "smooth_line",
)


REPLICATES, SAMPLE, POINTS, SHOWN = 5000, 500, 512, 3000


def study_size(spark, sf_dir: str) -> dict[str, float]:
    """The subsampling part of the study at its own size: 5,000 replicates of 500 rows in each stratum."""
    times: dict[str, float] = {}

    def timed(name: str, make, store=keep):
        start = time.perf_counter()
        made = store(make())
        times[name] = round(time.perf_counter() - start, 3)
        return made

    by = ["formula", "veg_type"]
    rows = keep(views.study_rows(spark, sf_dir))
    block = F.floor(F.col("id") / 4096)
    drawn = timed("study_draw", lambda: resample.resample(rows, "veg_type", SAMPLE, REPLICATES, block, ["id"]), lambda d: keep_bucketed(d, ["sample_id", "veg_type"]))
    coefs = timed("study_fit", lambda: regress.fit_sample(drawn))
    residuals = timed("study_residuals", lambda: regress.sample_residuals(drawn, coefs))
    timed("study_mae", lambda: regress.mae(residuals))
    ranges = residuals.groupBy(*by).agg(F.min("x").alias("min"), F.max("x").alias("max"))
    timed("study_band", lambda: regress.confidence_band(coefs, ranges))
    ratios = timed("study_ratios", lambda: regress.ratio_median(drawn))
    timed(
        "study_density",
        lambda: profile.density_profile(ratios, ["metric", "veg_type"], "median", POINTS, ["metric"]),
    )
    key = ["formula", "sample_id", "id"]
    timed("study_shown", lambda: resample.sample_per_group(residuals, by, SHOWN, key))
    return times


def seconds(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds(spark, "grid_monthly", sf_dir)  # warm-up, not reported
    times = {n: round(min(seconds(spark, n, sf_dir) for _ in range(2)), 3) for n in HEADLINE}
    times |= study_size(spark, sf_dir)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
