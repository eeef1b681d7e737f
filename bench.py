"""Headline queries, one JSON line: seconds per query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is evaluated whole into the no-op sink after one warm-up at a smaller scale.
"""

from __future__ import annotations

import json
import os
import sys
import time

from placewright import queries as library
from placewright.session import get_session

HEADLINE = [
    "expand_address", "expand_address_root", "tokenize", "normalized_tokens", "name_hashes", "blocking_pairs", "near_dupe_status", "tfidf_top5", "frequent_phrases", "dictionary_longest_match",
    "haversine_nearest", "point_in_polygon", "group_concat_distinct", "sort_unique", "connected_components",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    spark = get_session(f"local[{cpus}]", **{"spark.driver.memory": "12g", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        query = library.QUERIES[name]
        for at in [small] * os.path.isdir(small) + [sf]:
            begin = time.time()
            query(spark, at).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - begin, 3)
        print(name, took[name], file=sys.stderr)
    rows = spark.read.parquet(f"{sf}/orders.parquet").count()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "expansions_per_sec_per_core": round(rows / took["expand_address"] / int(cpus), 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
