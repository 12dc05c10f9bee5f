"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). `stage` is the time to write
the split and profile tables that the other queries read; each query is then written to a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from quillrec.plans import catalog
from quillrec.session import build_session
from quillrec.sources.domain import Domain

HEADLINE = (
    "src_4_parquet_scan",
    "prj_1_clean_ratings",
    "win_1_leave_one_out",
    "agg_1_user_stats",
    "agg_2_item_stats",
    "agg_8_genre_preference",
    "agg_17_quantiles",
    "rec_hot",
    "rec_itemcf",
    "rec_emb",
    "rec_simitem",
    "rec_content",
    "rec_kg_hybrid",
    "rec_merge7",
    "rnk_1_candidate_features",
    "rnk_8_mmr",
    "evl_1_metrics",
    "qry_cold",
    "qry_search_weighted",
    "str_4_profiles_from_log",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"}
    spark = build_session("bench", master=f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    start = time.perf_counter()
    domain = Domain(spark, folder)
    _ = domain.split, domain.user_profile, domain.item_profile
    times["stage"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = Path(folder).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
