"""Progress of long work and its cancelling, from outside the thread that waits for it."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Seconds between two looks at the jobs.
EVERY = 0.1


class Cancelled(RuntimeError):
    """The work was stopped because its cancel event was set."""


def task_counts(spark: SparkSession, tag: str) -> tuple[int, int]:
    """Tasks done, and tasks known so far, of all jobs with a tag. Spark forgets old jobs: then both shrink."""
    tracker = spark.sparkContext._jsc.sc().statusTracker()
    stages = {}
    for job in tracker.getJobIdsForTag(tag):
        info = tracker.getJobInfo(job)
        for stage in info.get().stageIds() if info.isDefined() else ():
            known = tracker.getStageInfo(stage)
            if known.isDefined():
                stages[stage] = (known.get().numCompletedTasks(), known.get().numTasks())
    return sum(done for done, _ in stages.values()), sum(total for _, total in stages.values())


@contextmanager
def watched(spark: SparkSession, progress: Callable[[int, int], None] | None = None, cancel: threading.Event | None = None) -> Iterator[None]:
    """Jobs that this thread starts in the block report to ``progress`` (tasks done, tasks known), and are stopped once ``cancel`` is set.

    Jobs are told by a tag of their own, so that other work in the session goes on. A block
    that was stopped raises Cancelled; one that ended before it could be is left as it is.
    ``progress`` is called from another thread; what it raises goes unheard.
    """
    if progress is None and cancel is None:
        yield
        return
    if cancel is not None and cancel.is_set():
        raise Cancelled
    tag, ended = f"filmcrate-{uuid.uuid4().hex}", threading.Event()

    def look() -> None:
        last = None
        while not ended.wait(EVERY):
            if cancel is not None and cancel.is_set():
                spark.sparkContext.cancelJobsWithTag(tag)
            counts = task_counts(spark, tag) if progress is not None else None
            if counts and counts != last:
                progress(*counts)
                last = counts

    watcher = threading.Thread(target=look, daemon=True)
    spark.sparkContext.addJobTag(tag)
    watcher.start()
    try:
        yield
    except Exception as exc:
        if cancel is not None and cancel.is_set():
            raise Cancelled from exc
        raise
    finally:
        ended.set()
        spark.sparkContext.removeJobTag(tag)
        watcher.join()
