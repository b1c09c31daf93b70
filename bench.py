"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from canopyframe.plans.catalogue import QUERIES
from canopyframe.session import build_session

HEADLINE = (
    "flagship_stress_acres", "zones_end_to_end", "a3_weighted_blend", "a7_job_summary", "g21_connected_components", "g24_simplified_rings",
    "g25_gaussian_smoothing", "j1_pixel_window_containment", "j2_pixels_in_polygons", "g14_aoi_mask", "s18_overview_pyramid", "g26_web_map_tiles",
    "p10_response_overlap_weights", "p12_apply_weights", "p13_full_resampler", "p14_alternative_resampler", "p21_index_bundle", "p22_robust_scaling",
    "p25_scene_transform_chain", "a1_band_percentiles", "a10_dominant_indicator", "a12_proxy_labels", "a14_class_metrics", "x2_window_model_scoring",
    "a25_zone_kpis", "j12_point_probe", "j9_resolve_jobs", "t2_jobs_newest_first", "w6_progress_changes", "w7_rate_limited_requests", "u4_quality_report", "p27_label_for_days",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and the Python workers' machinery outside the timings.
    QUERIES["x3_block_transform"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
