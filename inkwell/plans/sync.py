"""M3-M6: synchronisation runs over landed pages.

The first run writes a snapshot. Every later one appends a segment of what changed and what is gone, so the bytes
written follow the change; `fold` makes a new snapshot of snapshot and segments once these have grown.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.fields import DOC_TYPES
from inkwell.operators.cleaning import normalize_documents
from inkwell.operators.filters import changed_since
from inkwell.operators.merging import last_of_written, merge_counts, merge_documents, prune, removed_count, stale_ids
from inkwell.operators.reports import type_counts
from inkwell.session import settle
from inkwell.sources.api_pages import page_coverage, page_documents, read_ids
from inkwell.sources.archive import (
    CURRENT,
    LAST_SYNC,
    SEGMENT,
    live_segments,
    read_archive,
    read_documents,
    read_segments,
    read_state,
    state_value,
    write_documents,
    write_segment,
    write_state,
)

#: Segments are folded when they hold this share of the snapshot's rows.
FOLD_SHARE = 0.25
#: Or when there are this many, since each adds files to every read.
FOLD_SEGMENTS = 256
ARRIVAL = ["turn", "page", "item"]


class IncompleteLanding(ValueError):
    """Pages of a collection are missing, so nothing may be deleted or marked as seen."""


def require_complete(pages: DataFrame, what: str) -> None:
    """Every type has all the pages it announces, and at most one of them without a number."""
    rows = {r["type"]: r for r in page_coverage(pages).collect()}
    unnumbered = pages.where("page is null").groupBy("type").agg(F.count("*").alias("n")).where("n > 1").collect()
    lacking = [t for t in DOC_TYPES if t not in rows or rows[t]["n_missing"]] + [r["type"] for r in unnumbered]
    if lacking:
        raise IncompleteLanding(f"{what}: pages are missing or unnumbered for {', '.join(lacking)}")


def plan_sync(batch: DataFrame, watermark: str | None, full: bool) -> DataFrame:
    """M3: everything where asked for or where there is no watermark yet, else what changed."""
    return batch if full else changed_since(batch, watermark)


@dataclass(frozen=True)
class SyncPlan:
    documents: DataFrame
    counts: DataFrame
    batch: DataFrame
    #: The new rows of changed ids, one each, and the ids that a prune deletes.
    changed: DataFrame
    gone: DataFrame | None


def sync_archive(
    current: DataFrame,
    pages: DataFrame,
    site: str,
    watermark: str | None = None,
    full: bool = False,
    live_pages: DataFrame | None = None,
) -> SyncPlan:
    """The merged archive and `added`, `updated`, `removed`, all lazy over the batch, which is
    parsed once and stored.

    A full run rereads everything and deletes nothing; only `live_pages`, the id listing of a
    prune, removes documents, and it does so after the merge. Types follow each other in their
    fixed order, so of an id in two types the later one stays.
    """
    records = normalize_documents(page_documents(pages), site, keep_order=True)
    turn = F.array_position(F.array(*map(F.lit, DOC_TYPES)), F.col("type")).alias("turn")
    batch = settle(plan_sync(records, watermark, full).select("*", turn), "sync-batch")
    changed = last_of_written(batch, ARRIVAL)
    merged = merge_documents(current, batch, ARRIVAL, changed)
    counts = merge_counts(current, batch)
    if live_pages is None:
        return SyncPlan(merged, counts.withColumn("removed", F.lit(0).cast("long")), batch, changed, None)
    live = settle(read_ids(page_documents(live_pages)), "live-ids")
    removed = removed_count(merged, live).scalar()
    return SyncPlan(prune(merged, live), counts.withColumn("removed", removed), batch, prune(changed, live), stale_ids(current, live))


def _seq(state: DataFrame) -> int:
    """A number above all given so far, also where a clock was set back."""
    named = [*live_segments(state), state_value(state, CURRENT) or "-0"]
    return max(time.time_ns(), 1 + max(int(n.rpartition("-")[2]) for n in named))


def _note(spark: SparkSession, root: str, entries: dict[str, str | None], seq: int) -> None:
    """One small file, so that all entries count or none does."""
    write_state(spark.createDataFrame([(k, v, seq) for k, v in entries.items()], "key string, value string, seq long"), f"{root}/state")


def _commit(spark: SparkSession, root: str, plan: SyncPlan, counts: dict[str, int], watermark: str | None) -> None:
    """Documents first, then the state that names them: a snapshot where there is none, else a segment."""
    state = read_state(spark, f"{root}/state")
    seq = _seq(state)
    entries = {LAST_SYNC: watermark} if watermark else {}
    if not state_value(state, CURRENT):
        path = f"{root}/snapshot-{seq}"
        write_documents(plan.documents, path)
        entries[CURRENT] = path
    elif any(counts[k] for k in ("added", "updated", "removed")):
        # The number is padded, so that the order of the keys is that of the segments.
        path = f"{root}/changes-{seq:020d}"
        write_segment(plan.changed, plan.gone, path, seq)
        entries[f"{SEGMENT}{seq:020d}"] = path
    if entries:
        _note(spark, root, entries, seq)


def fold(spark: SparkSession, root: str) -> bool:
    """Write a new snapshot of the snapshot and its segments; False where there is nothing to fold.

    The state then names the new snapshot and none of the folded segments, by one write; their files stay for readers
    that began before.
    """
    state = read_state(spark, f"{root}/state")
    folded = live_segments(state)
    if not folded:
        return False
    seq = _seq(state)
    path = f"{root}/snapshot-{seq}"
    write_documents(read_archive(spark, root), path)
    _note(spark, root, {CURRENT: path} | dict.fromkeys(folded), seq)
    return True


def fold_if_grown(spark: SparkSession, root: str) -> bool:
    """`fold` once the segments hold `FOLD_SHARE` of the snapshot's rows or are too many, so a row is rewritten rarely."""
    state = read_state(spark, f"{root}/state")
    changes = read_segments(spark, state)
    if changes is None:
        return False
    # Both counts come from the footers of the files.
    held = read_documents(spark, state_value(state, CURRENT)).count()
    if len(live_segments(state)) < FOLD_SEGMENTS and changes.count() < FOLD_SHARE * held:
        return False
    return fold(spark, root)


def _now(now: str | None) -> str:
    return now or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def _seen(batch: DataFrame) -> dict[str, int]:
    """Documents per type."""
    seen = {r["type"]: r["n_docs"] for r in type_counts(batch).collect()}
    return {f"seen_{t}": seen[t] for t in DOC_TYPES}


def run_sync(
    spark: SparkSession, pages: DataFrame, root: str, site: str,
    full: bool = False, live_pages: DataFrame | None = None, now: str | None = None,
) -> dict[str, int]:
    """One stored run below `root`; returns `added`, `updated`, `removed` and the
    documents seen per type.

    The watermark is taken before anything is read and stored by the write that names the new
    documents, so a failed run leaves the old archive and the old watermark. A landing or an id
    listing with missing pages fails before anything is written.
    """
    started = _now(now)
    require_complete(pages, "landing")
    if live_pages is not None:
        require_complete(live_pages, "id listing")
    mark = state_value(read_state(spark, f"{root}/state"), LAST_SYNC)
    plan = sync_archive(read_archive(spark, root), pages, site, mark, full, live_pages)
    counts = plan.counts.first().asDict()
    _commit(spark, root, plan, counts, started)
    fold_if_grown(spark, root)
    return counts | _seen(plan.batch)


def run_page_sets(
    spark: SparkSession, page_sets: Sequence[DataFrame], root: str, site: str,
    full: bool = False, live_pages: DataFrame | None = None, now: str | None = None,
) -> dict[str, int]:
    """M5: commit landed page sets one after the other; returns the sums of what `run_sync` returns.

    Each set is parsed once and appended as a segment before the next one is read, so a set that
    can't be read leaves those before it in place and the bytes written follow the set. With
    `live_pages` a prune follows, when all pages of both are known to be there. The watermark moves
    only at the end. Running again repeats the merges and leaves the same archive. Of an id in
    several sets the last set decides.
    """
    started = _now(now)
    if live_pages is not None:
        require_complete(live_pages, "id listing")
    if not page_sets:
        raise IncompleteLanding("landing: no page set")
    mark = state_value(read_state(spark, f"{root}/state"), LAST_SYNC)
    totals: dict[str, int] = {}

    def commit(pages: DataFrame, live: DataFrame | None, watermark: str | None) -> None:
        plan = sync_archive(read_archive(spark, root), pages, site, mark, full, live)
        counts = plan.counts.first().asDict()
        _commit(spark, root, plan, counts, watermark)
        for k, n in (counts | _seen(plan.batch)).items():
            totals[k] = totals.get(k, 0) + n

    whole = None
    for pages in page_sets:
        parsed = settle(pages, "page-set")
        commit(parsed, None, None)
        whole = parsed if whole is None else whole.unionByName(parsed)
    require_complete(whole, "landing")
    commit(whole.limit(0), live_pages, started)
    fold_if_grown(spark, root)
    return totals
