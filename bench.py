"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "prj1_flatten_insight",
    "snk1_partitioned_write",
    "agg1_funnel_by_month",
    "agg2_ad_lifecycle",
    "agg16_fatigue_profile",
    "sta3_benjamini_hochberg",
    "sta8_spearman",
    "sta9_exact_auc",
    "sta5_cluster_bootstrap_multinomial",
    "seg5_placement_ranking",
    "seg5_age_gender_ranking",
    "rea3_reallocation_totals",
    "tri4_feature_frame",
    "tri9_decision_curve",
    "tri7_logistic_triage",
    "cre1_creative_dataset",
    "cre2_associations_ctr",
    "snk3_star_export",
]


def full_bootstrap(spark, sf_dir):
    """Device ranking at the published settings: 2000 replicates."""
    from bindings import tables as tb
    from spendlens.operators.segments import rank_segments

    df = tb.ads_by_placement(spark, sf_dir)
    return rank_segments(df, ["impression_device"], n_boot=2000).scored


def large_pictures(spark, sf_dir):
    """Seven features of one 320 x 320 picture for each embedding."""
    from pyspark.sql import functions as F

    from bindings import tables as tb
    from spendlens.functions.images import image_features

    side, small = 320, tb.pictures(spark, sf_dir)
    data = F.unhex(F.substring(F.repeat(F.hex("image.data"), side * side // 22 + 1), 1, side * side * 6))
    fields = {"height": F.lit(side), "width": F.lit(side), "data": data}
    kept = ["origin", "height", "width", "nChannels", "mode", "data"]
    image = F.struct(*[fields.get(c, F.col(f"image.{c}")).alias(c) for c in kept])
    return image_features(small.select("ad_id", image.alias("image")))


def main() -> None:
    from bindings import catalogue
    from spendlens.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    runs = {k: queries[k] for k in HEADLINE}
    runs["seg5_device_2000_replicates"] = full_bootstrap
    runs["img_320px_pictures"] = large_pictures
    queries["agg3_funnel_totals"](spark, sf_dir).collect()  # start the JVM's compilers
    times = {}
    for key, fn in runs.items():
        start = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - start, 3)
        print(f"{key}: {times[key]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
