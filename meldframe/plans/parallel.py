"""Driver-side parallel jobs in scheduler pools."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import SparkSession

log = logging.getLogger(__name__)

# Loggers that fill a notebook.
NOISY_LOGGERS = [
    "py4j",
    "py4j.java_gateway",
    "py4j.clientserver",
    "azure",
    "azure.core",
    "azure.identity",
    "azure.core.pipeline.policies.http_logging_policy",
    "msal",
    "msrest",
    "urllib3",
    "adal-python",
]


def quiet_azure_logging(level: int = logging.WARNING) -> None:
    for name in NOISY_LOGGERS:
        logging.getLogger(name).setLevel(level)


def run_parallel(
    fn: Callable[..., Any],
    jobs: Iterable[Mapping[str, Any]],
    max_workers: int = 4,
    pool: str | None = None,
    fail_fast: bool = False,
    *,
    spark: SparkSession | None = None,
) -> list[Any]:
    """``fn(**job)`` for each job, in threads; the results in the jobs' order, an exception in place of its result.

    With ``pool`` the jobs run in that scheduler pool, and each thread's own pool is put back. With
    ``fail_fast`` no job starts after a failure, and the first one in order is raised once the running
    ones have ended; jobs that never started have None. A session is only needed for a pool.
    """
    jobs = list(jobs)
    if max_workers < 1:
        raise ValueError("max_workers must be at least 1")
    if not jobs:
        return []
    context = None
    if pool is not None:
        from meldframe.session import get_spark

        context = get_spark(spark).sparkContext
        if context.getConf().get("spark.scheduler.mode", "FIFO").upper() != "FAIR":
            log.warning("pool %s has no effect: spark.scheduler.mode is not FAIR", pool)
    stopped = False

    def one(job: Mapping[str, Any]) -> Any:
        nonlocal stopped
        if stopped:
            return None
        before = context.getLocalProperty("spark.scheduler.pool") if context else None
        try:
            if context:
                context.setLocalProperty("spark.scheduler.pool", pool)
            return fn(**job)
        except Exception as error:  # noqa: BLE001  it is the job's result
            stopped = stopped or fail_fast
            log.warning("job %s failed: %s", job.get("name", job), error)
            return error
        finally:
            if context:
                context.setLocalProperty("spark.scheduler.pool", before)

    with ThreadPoolExecutor(min(max_workers, len(jobs))) as threads:
        results = list(threads.map(_inherits(one, spark), jobs))
    if fail_fast and (error := next((r for r in results if isinstance(r, Exception)), None)) is not None:
        raise error
    return results


def _inherits(fn: Callable[[Any], Any], spark: SparkSession | None) -> Callable[[Any], Any]:
    """``fn`` with the calling thread's local properties, where there is a session."""
    session = spark or SparkSession.getActiveSession()
    if session is None:
        return fn
    from pyspark import inheritable_thread_target

    return inheritable_thread_target(session)(fn)
