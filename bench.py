"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from histomesh.checks import catalogue  # noqa: E402
from histomesh.session import local_session  # noqa: E402

HEADLINE = [
    "composition_matrix", "cn_enrichment", "transfer_labels", "label_patches", "transition_entropy", "g_function",
    "ripley_k_l", "kde_summary", "distance_features", "adjacency_matrix", "interaction_z", "extract_all_features",
    "pyramid_pool", "distance_attention", "classification_metrics", "bootstrap_ci", "concordance_index", "univariate_cox",
    "spearman_matrix", "tissue_mask",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    only = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus)
    # the JVM and the table readers warm up on the first table only
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in only:
        start = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 2)
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 2), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
