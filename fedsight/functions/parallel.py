"""Several jobs of one driver at the same time.

A fit leaves executors idle between its many short stages; fits of other
settings fill them. Each setting runs in a thread of its own that inherits the
caller's local properties and submits to a scheduler pool of its own, so under
``spark.scheduler.mode=FAIR`` settings share the cluster evenly (under FIFO the
earlier ones go first). At most ``parallel`` settings run at once, which bounds
what they hold in memory together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

S = TypeVar("S")
R = TypeVar("R")


def run_settings(spark: SparkSession, settings: Sequence[S], run: Callable[[S], R], parallel: int = 4,
                 name: Callable[[S], str] = str) -> list[R]:
    """``run`` of every setting, in the order of ``settings``; the results do
    not depend on ``parallel``. The first setting that fails ends the call with
    an error that names it; settings that have not begun are not run, those that
    have are waited for. No settings give an empty list."""
    if parallel < 1:
        raise ValueError(f"parallel must be 1 or more, not {parallel}")
    if not settings:
        return []

    def job(i: int, setting: S) -> R:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"setting-{i % parallel}")
        try:
            return run(setting)
        except Exception as e:
            raise RuntimeError(f"setting {name(setting)} failed: {e}") from e
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(min(parallel, len(settings))) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(job), i, s) for i, s in enumerate(settings)]
        done, waiting = wait(jobs, return_when=FIRST_EXCEPTION)
        if any(j.exception() for j in done):
            for j in waiting:
                j.cancel()
    for j in jobs:
        if not j.cancelled() and j.exception():
            raise j.exception()
    return [j.result() for j in jobs]
