"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from inkwell import catalog  # noqa: E402
from inkwell.operators import indexing, merging, ranking, reports  # noqa: E402
from inkwell.plans import search as searching  # noqa: E402
from inkwell.plans import sync  # noqa: E402
from inkwell.plans.index import build_index, update_index  # noqa: E402
from inkwell.session import local_session, scratch_path  # noqa: E402
from inkwell.sources import api_pages, testtables  # noqa: E402
from inkwell.streaming import feed  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    times: dict[str, float] = {}

    def run(name, make):
        start = time.perf_counter()
        frame = make()
        if hasattr(frame, "write"):
            frame.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
        return frame

    # Starting the JVM's workers and reading the first footers belongs to no query.
    reports.document_count(testtables.archive(spark, sf_dir)).collect()

    archive = testtables.archive(spark, sf_dir)
    index = run("index_build", lambda: build_index(spark, archive, scratch_path(spark, "bench-index"), catalog.INDEX_BUCKETS))
    log = testtables.search_log(spark, sf_dir)
    run("search_log", lambda: searching.search_batch(index, log))
    run("search_one_first", lambda: searching.search(index, spark, "the that -tion after:2022"))
    run("search_one_again", lambda: searching.search(index, spark, "reading words tag:en"))
    run("search_newest", lambda: searching.search(index, spark, "tag:en before:2024"))
    run("merge_delta", lambda: catalog.QUERIES["merge_documents"](spark, sf_dir))
    run("merge_counts", lambda: catalog.QUERIES["merge_counts"](spark, sf_dir))
    run("prune", lambda: catalog.QUERIES["prune"](spark, sf_dir))
    run("tokenize", lambda: indexing.tokenize(index.documents))
    run("build_postings", lambda: indexing.build_postings(index.documents))
    run("stem_vocabulary", lambda: indexing.build_vocab(index.postings))
    run("newest_first", lambda: ranking.newest_first(index.documents, ranking.DEFAULT_LIMIT))
    run("archive_health", lambda: reports.archive_health(index.documents))
    run("document_ids", lambda: merging.live_ids(index.documents))
    tenth = testtables.posts(spark, sf_dir).where(F.substring("id", -1, 1) == "7").withColumn("title", F.concat("title", F.lit(" (edited)")))
    run("update_index_tenth", lambda: update_index(spark, index, tenth, scratch_path(spark, "bench-index")))
    landed = scratch_path(spark, "bench-landed")
    some = testtables.raw_json_posts(spark, sf_dir).where(F.col("n") % 10 == 7)
    testtables.landed_pages(some, "posts", landed)
    fed, marks = scratch_path(spark, "bench-feed"), scratch_path(spark, "bench-marks")
    run("feed_tenth", lambda: feed.stream_archive(spark, f"{landed}/posts/*", fed, marks, "post", testtables.SITE).awaitTermination())
    live = run("open_after_feed", lambda: feed.live_index(spark, index, fed))
    run("search_after_feed", lambda: searching.search(live, spark, "reading words tag:en"))
    whole = scratch_path(spark, "bench-landed")
    testtables.landed_pages(testtables.raw_json_posts(spark, sf_dir), "posts", whole)
    testtables.landed_pages(testtables.raw_json_pages(spark, sf_dir), "pages", whole)
    pages = api_pages.read_all_types(spark, whole)
    root = scratch_path(spark, "bench-synced")
    run("sync_full", lambda: sync.run_sync(spark, pages, root, testtables.SITE, now=catalog.WATERMARK))
    run("sync_changes", lambda: sync.run_sync(spark, pages, root, testtables.SITE, now=catalog.NOW))
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "inkwell_total", "value": total, "unit": "sec", "queries": times, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
