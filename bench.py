"""Time the headline queries: one JSON line, seconds per query, best of two runs."""

from __future__ import annotations

import json
import os
import time

from hearthtab.plans.queries import QUERIES
from hearthtab.session import build_session

HEADLINE = (
    "recode_race_eth",
    "income_harmonized",
    "household_rollup",
    "person_with_household",
    "household_rollup_hot",
    "person_with_household_hot",
    "build_stage_tables",
    "ingest_fixed_width",
    "hhsize_by_year",
    "multifam_share_by_year",
    "multifam_share_by_race",
    "multifam_share_by_age",
    "multifam_share_tables",
    "gq_share_by_race",
    "multifam_hh_count",
    "multifam_hh_percent",
    "hh_components",
    "hh_components_normalized",
    "multifam_by_children",
    "rent_burden_bands",
    "rent_burden_by_city_all_years",
    "rent_per_family_bands_all_years",
    "ppbr_by_rent_burden",
    "lpm_base",
    "lpm_ses",
)
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "hearthtab-bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total of best-of-two wall times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
