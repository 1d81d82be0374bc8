"""Headline timings: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from namesieve.plans.catalogue import QUERIES
from namesieve.session import build_session

HEADLINE = (
    "normalize_strings",
    "lexical_shape",
    "classify_strings",
    "classify_rows",
    "dictionary_ngram_hits",
    "fuzzy_match",
    "token_rank_bands",
    "frequency_stats",
    "tag_sequences",
    "string_flags",
    "unmatched_tokens",
    "extract_tagged",
    "annotate_tagged",
    "stratified_split",
    "similar_pairs",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        spark__master=f"local[{cpus}]",
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions=cpus,
        spark__sql__files__maxPartitionBytes="8m",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    seconds: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
