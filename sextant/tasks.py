"""Queries that run beside the session's own: started, listed, canceled."""

from __future__ import annotations

import datetime
import threading
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "jobid int, query string, job_name string, started_at timestamp, duration double, status string, error_message string"


@dataclass
class Task:
    id: int
    query: str
    name: str
    started: datetime.datetime
    ended: datetime.datetime | None = None
    status: str = "in_progress"
    error: str | None = None
    thread: threading.Thread | None = None


class Tasks:
    def __init__(self, spark: SparkSession):
        self.spark, self.tasks = spark, {}

    def run(self, query: str, name: str | None = None) -> int:
        """Starts a SQL statement and returns its id."""
        n = len(self.tasks) + 1
        task = self.tasks[n] = Task(n, query, name or f"async_task_{n}", datetime.datetime.now(datetime.UTC))

        def work() -> None:
            self.spark.addTag(f"sextant-task-{n}")
            try:
                self.spark.sql(query).write.format("noop").mode("overwrite").save()
                task.status = "canceled" if task.status == "canceled" else "succeeded"
            except Exception as e:  # noqa: BLE001
                if task.status != "canceled":
                    task.status, task.error = "failed", str(e)
            finally:
                task.ended = datetime.datetime.now(datetime.UTC)
                self.spark.removeTag(f"sextant-task-{n}")

        task.thread = InheritableThread(target=work)
        task.thread.start()
        return n

    def wait(self, id: int, seconds: float | None = None) -> str:
        self.tasks[id].thread.join(seconds)
        return self.tasks[id].status

    def cancel_all(self) -> int:
        """Returns how many were running."""
        running = [t for t in self.tasks.values() if t.status == "in_progress"]
        for t in running:
            t.status = "canceled"
            self.spark.interruptTag(f"sextant-task-{t.id}")
        return len(running)

    def list(self) -> DataFrame:
        rows = [(t.id, t.query, t.name, t.started, (t.ended - t.started).total_seconds() if t.ended else None, t.status, t.error) for t in self.tasks.values()]
        return self.spark.createDataFrame(rows, SCHEMA)
