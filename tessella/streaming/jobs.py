"""Queries in the background: submit, poll, fetch once, cancel."""

from __future__ import annotations

import secrets
import threading
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from enum import Enum

from pyspark.sql import SparkSession


class Status(Enum):
    SUBMITTED = "SUBMITTED"
    PENDING = "PENDING"
    DONE = "DONE"
    FAILED = "FAILED"


class Jobs:
    """Requests by id; each runs in a thread under a tag of its own, so that it can be cancelled alone."""

    def __init__(self, spark: SparkSession, workers: int = 4):
        self.spark, self.pool = spark, ThreadPoolExecutor(workers)
        self.tasks: dict[str, Future] = {}
        self.started: set[str] = set()
        self.lock = threading.Lock()

    def submit(self, work: Callable[[SparkSession], object]) -> str:
        """Returns the request's id at once."""
        name = secrets.token_hex(16)

        def run():
            self.started.add(name)
            self.spark.addTag(name)
            try:
                return work(self.spark)
            finally:
                self.spark.removeTag(name)

        with self.lock:
            self.tasks[name] = self.pool.submit(run)
        return name

    def _task(self, name: str) -> Future:
        if name not in self.tasks:
            raise KeyError(f"no request {name}")
        return self.tasks[name]

    def status(self, name: str) -> Status:
        task = self._task(name)
        if task.done():
            return Status.FAILED if task.cancelled() or task.exception() else Status.DONE
        return Status.PENDING if name in self.started else Status.SUBMITTED

    def result(self, name: str, timeout: float | None = None):
        """Waits for the result, which is forgotten once it is read."""
        value = self._task(name).result(timeout)
        with self.lock:
            self.tasks.pop(name, None)
        return value

    def poll(self, name: str, every: float = 5.0):
        """As :meth:`result`, looking again after each interval."""
        while self.status(name) in (Status.SUBMITTED, Status.PENDING):
            threading.Event().wait(every)
        return self.result(name)

    def run(self, work: Callable[[SparkSession], object]):
        """Submits and waits."""
        return self.result(self.submit(work))

    def cancel(self, name: str) -> None:
        self._task(name).cancel()
        self.spark.interruptTag(name)
