"""Time headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) is the data folder, BENCH_CPUS (default 8) the
number of local cores.  Every query runs whole, into a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from rankweave.operators import resample as RS
from rankweave.plans import queries
from rankweave.plans import inference as INF
from rankweave.plans.aggregations import query_effects
from rankweave.plans.registry import Tables

HEADLINE = (
    "g01_coverage", "g06_winner_dedup", "j09_merged_pool", "j10_common_cohort", "j17_list_agreement",
    "g03_within_pool_metrics", "g05_pool_overlap", "g17_descriptor_summary", "f16_list_descriptors",
    "m01_training_pairs", "s03_strict_audit", "q01_pool_issues", "w03_midrank_score",
    "r04_transfer_intervals", "r14_transfer_loss", "t03_anchored_extension", "u05_list_jaccard",
)
# As many draws as published analyses use; the registered r queries draw fewer, for their SQL.
BOOTSTRAP_DRAWS = 10_000
FLIPS = 100_000
PERMUTATIONS = 10_000


def bootstrap_10k(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster bootstrap with 10,000 draws over every customer."""
    return RS.cluster_bootstrap(INF.historical_totals(Tables(spark, folder)), INF.METRICS, BOOTSTRAP_DRAWS, 17)


def sign_flip_10k(spark: SparkSession, folder: str) -> DataFrame:
    """Sign-flip test with 10,000 draws over every customer."""
    return RS.sign_flip(INF.historical_totals(Tables(spark, folder)), INF.METRICS, BOOTSTRAP_DRAWS, 61)


def omnibus_10k(spark: SparkSession, folder: str) -> DataFrame:
    """Permutation test of class means with 10,000 draws over every covered query."""
    rows = query_effects(Tables(spark, folder))
    return RS.omnibus_permutation(rows, "query_id", "e_mrr", "class", PERMUTATIONS, 71)


def r04_10k(spark: SparkSession, folder: str) -> DataFrame:
    """Transfer intervals of three pools and two metrics with 10,000 draws."""
    return INF.r04(Tables(spark, folder), BOOTSTRAP_DRAWS)


def r14_100k(spark: SparkSession, folder: str) -> DataFrame:
    """Sign-flip tests of transfer loss, three pools and two metrics, with 100,000 draws."""
    return INF.r14(Tables(spark, folder), FLIPS)


EXTRA = {"bootstrap_10k": bootstrap_10k, "sign_flip_10k": sign_flip_10k, "omnibus_10k": omnibus_10k,
         "r04_10k": r04_10k, "r14_100k": r14_100k}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("rankweave-bench")
        .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = {name: queries()[name] for name in HEADLINE} | EXTRA
    times: dict[str, float] = {}
    for name, run in known.items():
        start = time.perf_counter()
        run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
