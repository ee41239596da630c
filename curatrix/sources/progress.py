"""How far running jobs are, for whoever waits for them."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def now(spark: SparkSession) -> tuple[int, int]:
    """Tasks done and all tasks of the stages that run."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s is not None]
    return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)


@contextmanager
def watch(spark: SparkSession, hook: Callable[[int, int], None], every: float = 0.5) -> Iterator[None]:
    """Call ``hook(done, all)`` now and then while the body runs, and once with equal numbers at its end."""
    over = threading.Event()

    def look() -> None:
        while not over.wait(every):
            done, total = now(spark)
            if total:
                hook(done, total)

    thread = threading.Thread(target=look, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
    hook(1, 1)
