"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from terrafold.plans.catalog import QUERIES
from terrafold.session import build_session

HEADLINE = [
    "pois_within_radius", "pois_in_boxes", "buildings_within_radius", "composed_pois", "filled_way_nodes", "road_segments", "cross_sections", "restricted_turns",
    "street_components", "block_faces", "building_blocks", "turn_aware_routes", "despiked_cells", "smoothed_cells", "interval_spread", "side_gaps", "building_attributes",
    "upserted_layer", "map_data_pois",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
