"""A time limit that holds: the jobs of a request are cancelled when its time is over."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from spanforge.plans.parser import QueryError

#: seconds between two cancellations: a request may have started another job since the first
AGAIN = 0.25


@contextmanager
def time_limit(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """Run the block's Spark jobs for ``seconds`` at most; beyond, ``QueryError``.  None: without a limit."""
    if seconds is None:
        yield
        return
    sc, tag, over, done = spark.sparkContext, f"limit-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            over.set()
            while True:
                sc.cancelJobsWithTag(tag)
                if done.wait(AGAIN):
                    return

    watcher = threading.Thread(target=watch, daemon=True)
    sc.addJobTag(tag)
    watcher.start()
    try:
        yield
    except QueryError:
        raise
    except Exception as e:
        if over.is_set():
            raise QueryError("the query took longer than its time limit", 0, 0) from e
        raise
    finally:
        done.set()
        sc.removeJobTag(tag)
        watcher.join()
    if over.is_set():
        raise QueryError("the query took longer than its time limit", 0, 0)
