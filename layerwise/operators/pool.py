"""Several Spark jobs at a time, each with a deadline."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")
WORKERS = 5


def each(tasks: list[Callable[[], T]], workers: int = WORKERS, limit: float | None = None, missing: T | None = None) -> list[T | None]:
    """What the tasks return, in their order, `workers` of them running at a time.

    A task that takes over `limit` seconds from its start has its jobs cancelled by their tag, and gives `missing`; the
    others go on. Another failure of Spark's is raised once all have ended.
    """
    spark = SparkSession.active()
    if len(tasks) == 1 and limit is None:
        return [tasks[0]()]
    sc = spark.sparkContext

    def run(task: Callable[[], T]) -> T | None:
        tag, late = f"layerwise-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(limit, stop) if limit is not None else None
        sc.addJobTag(tag)
        try:
            if timer:
                timer.start()
            out = task()
            return missing if late.is_set() else out
        except Exception:  # a cancelled job comes back as Spark's error or as the bridge's
            if late.is_set():
                return missing
            raise
        finally:
            if timer:
                timer.cancel()
            sc.removeJobTag(tag)

    with ThreadPoolExecutor(max(1, workers)) as pool:
        made = [pool.submit(inheritable_thread_target(spark)(run), t) for t in tasks]
        return [m.result() for m in made]
