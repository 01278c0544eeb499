"""Jobs that end at a deadline: what a search has by then is its answer, and names what is missing."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from threading import Event, Thread

from pyspark.sql import SparkSession


class Late(Exception):
    """The deadline passed before the work was done."""


class Deadline:
    """A moment, some seconds from now, at which the jobs of `run` are cancelled; None is never.

    The jobs have a tag of their own, so that others of the application go on. Until `run` returns, they are cancelled again and
    again, since an adaptive plan starts new ones.
    """

    def __init__(self, spark: SparkSession, seconds: float | None, every: float = 0.05) -> None:
        self.spark, self.every = spark, every
        self.end = None if seconds is None else time.monotonic() + seconds

    def left(self) -> float:
        return float("inf") if self.end is None else self.end - time.monotonic()

    def run[T](self, work: Callable[[], T]) -> T:
        """What work returns; Late if the deadline comes first, or has passed. Errors of the work before the deadline are its own."""
        if self.end is None:
            return work()
        if self.left() <= 0:
            raise Late
        context, tag, done = self.spark.sparkContext, f"deadline-{uuid.uuid4().hex}", Event()

        def watch() -> None:
            if done.wait(max(self.left(), 0)):
                return
            while not done.wait(self.every):
                context.cancelJobsWithTag(tag)

        watcher = Thread(target=watch, daemon=True)
        context.addJobTag(tag)
        watcher.start()
        try:
            return work()
        except Exception as error:
            if self.left() <= 0:
                raise Late from error
            raise
        finally:
            done.set()
            watcher.join()
            context.removeJobTag(tag)
