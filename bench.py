"""Headline queries on one table folder; prints one JSON line.

BENCH_SF_DIR picks the folder, BENCH_CPUS the number of local cores, BENCH_QUERIES (comma separated) other queries.
"""

from __future__ import annotations

import json
import os
import time

from storyloom.plans.catalog import REGISTRY
from storyloom.session import build_session

HEADLINE = [
    "infill_prompt", "token_freq", "build_vocab", "encode_ids", "infill_examples", "encdec_examples", "chunks",
    "padded_batches", "ngram_counts", "topp", "batch_loss", "epoch_loss", "infill_loss", "bpe_merges", "bpe_encode",
    "infill_generate", "subset", "shards",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
