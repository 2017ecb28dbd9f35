"""Embedding and completion jobs: a backfill, then micro-batches of a stream, into a target table.

A job reads rows as they arrive, drops those that it has done with the same source, embeds or completes the
others, changed ones too, and appends them; of a row's results the last counts. Structured Streaming's
checkpoint replays what was missed; as a batch may run twice, its rows are written under its number, and a
second write replaces the first. Results lie in ``BUCKETS`` folders by the hash of their key, and a batch reads
those only that its own keys fall into.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sextant.arrow import exists
from sextant.operators import embed
from sextant.sources.tables import embeddable

INTERVAL = "10 seconds"
BUCKETS = 64
KINDS = (embed.EMBEDDING, embed.COMPLETION)


@dataclass
class Job:
    id: int
    kind: str
    source: DataFrame
    key: str
    column: str
    target_column: str
    path: str
    options: dict = field(default_factory=dict)
    label: str | None = None
    started: datetime.datetime | None = None
    finished: datetime.datetime | None = None
    canceled: datetime.datetime | None = None
    failure: str | None = None
    query: StreamingQuery | None = None
    done: Callable[[], None] | None = None

    @property
    def results(self) -> str:
        return f"{self.path}/results"

    @property
    def failures(self) -> str:
        return f"{self.path}/failures"


def status(failed: Column, canceled: Column, finished: Column, started: Column) -> Column:
    """Of the times: failed before canceled before enabled before in_progress before queued."""
    return F.when(failed.isNotNull(), "failed").when(canceled.isNotNull(), "canceled").when(finished.isNotNull(), "enabled").when(started.isNotNull(), "in_progress").otherwise("queued")


class Jobs:
    """The jobs of a session; a job with a label runs only where it is the same."""

    def __init__(self, spark: SparkSession, path: str, label: str | None = None):
        self.spark, self.path, self.label, self.jobs = spark, path, label, {}

    def _add(self, kind: str, source: DataFrame, key: str, column: str, target: str, label: str | None, options: dict) -> int:
        n = len(self.jobs) + 1
        self.jobs[n] = Job(n, kind, source, key, column, target, f"{self.path}/job-{n}", options, label)
        return n

    def add_embedding_job(self, source: DataFrame, key: str, column: str, target_column: str, model: str = "hash/64", runtime: str = "hash", label: str | None = None) -> int:
        """``source`` is a streaming or a plain DataFrame; returns the job's id."""
        return self._add(embed.EMBEDDING, source, key, column, target_column, label, {"model": model, "runtime": runtime})

    def add_completion_job(self, source: DataFrame, key: str, column: str, target_column: str, model: str = "hash/echo", system: str = "", runtime: str = "hash", kind: str = "string", label: str | None = None) -> int:
        return self._add(embed.COMPLETION, source, key, column, target_column, label, {"model": model, "runtime": runtime, "system": system, "kind": kind})

    def _batch(self, job: Job, df: DataFrame, number: int) -> None:
        text = F.col(job.column).cast("string")
        rows = embeddable(df, job.column).withColumn("src", F.xxhash64(text)).withColumn("bucket", F.pmod(F.xxhash64(F.col(job.key).cast("string")), F.lit(BUCKETS)).cast("int"))
        rows = rows.dropDuplicates([job.key])
        if exists(self.spark, job.results):
            mine = [r.bucket for r in rows.select("bucket").distinct().collect()]
            before = self.spark.read.parquet(job.results).where(F.col("bucket").isin(mine) & (F.col("batch") != number))
            latest = before.groupBy(job.key).agg(F.max_by("src", "batch").alias("_src"))
            rows = rows.join(latest, job.key, "left").where("_src is null or _src <> src").drop("_src")
        o = dict(job.options)
        if job.kind == embed.EMBEDDING:
            done, failed = rows.withColumn(job.target_column, embed.llm_embedding(F.col(job.column), **o)), None
        else:
            done, failed = embed.typed_completions(rows, job.column, job.target_column, o.pop("kind"), job.key, **o)
        words = F.coalesce(F.size(F.split(F.trim(text), r"\s+")), F.lit(0)).alias("tokens")
        done.select(job.key, job.target_column, "src", words, "bucket", F.lit(number).cast("long").alias("batch")).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch", "bucket").parquet(job.results)
        if failed is not None:
            failed.write.mode("overwrite").parquet(f"{job.failures}/batch={number}")

    def start(self, id: int, once: bool = True) -> Job:
        """Run a job: all that there is (``once``), or on and on, every ten seconds. Of another label's job nothing runs."""
        job = self.jobs[id]
        if job.label is not None and job.label != self.label or job.canceled is not None:
            return job
        job.started = datetime.datetime.now(datetime.UTC)
        try:
            if not job.source.isStreaming:
                self._batch(job, job.source, 0)
            else:
                writer = job.source.writeStream.foreachBatch(lambda df, n: self._batch(job, df, n)).option("checkpointLocation", f"{job.path}/checkpoint")
                job.query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)).start()
                if once:
                    job.query.awaitTermination()
            job.finished = datetime.datetime.now(datetime.UTC)
        except Exception as e:  # noqa: BLE001
            job.failure = str(e)
        return job

    def retry_failures(self, id: int) -> int:
        """Runs the failed rows of a plain source again; returns how many there were."""
        job = self.jobs[id]
        failed = self.failures(id).select(F.col("row_id").alias(job.key)).distinct()
        n = failed.count()
        if n and not job.source.isStreaming:
            self._batch(job, job.source.join(failed, job.key, "left_semi"), int(datetime.datetime.now().timestamp()))
        return n

    def cancel(self, id: int) -> None:
        job = self.jobs[id]
        job.canceled = datetime.datetime.now(datetime.UTC)
        if job.query is not None and job.query.isActive:
            job.query.stop()

    def resume(self, id: int, once: bool = True) -> Job:
        self.jobs[id].canceled = None
        return self.start(id, once)

    def results(self, id: int) -> DataFrame:
        """``key, target`` of every row, by its last source."""
        job = self.jobs[id]
        if not exists(self.spark, job.results):
            return self.spark.createDataFrame([], job.source.select(job.key).schema).withColumn(job.target_column, F.lit(None).cast("string"))
        return self.spark.read.parquet(job.results).groupBy(job.key).agg(F.max_by(job.target_column, "batch").alias(job.target_column))

    def failures(self, id: int) -> DataFrame:
        job = self.jobs[id]
        if not exists(self.spark, job.failures):
            return self.spark.createDataFrame([], "row_id string, value string, batch int")
        return self.spark.read.parquet(job.failures)

    def list(self, kind: str | None = None) -> DataFrame:
        """``id, kind, status, failure_reason`` of all jobs or those of a kind."""
        rows = [(j.id, j.kind, j.failure, j.canceled, j.finished, j.started) for j in self.jobs.values() if kind in (None, j.kind)]
        df = self.spark.createDataFrame(rows, "id int, kind string, failure_reason string, canceled timestamp, finished timestamp, started timestamp")
        return df.select("id", "kind", status(F.col("failure_reason"), F.col("canceled"), F.col("finished"), F.col("started")).alias("status"), "failure_reason")

    def status_of(self, id: int) -> str:
        return self.list().where(F.col("id") == id).first().status

    def usage(self) -> DataFrame:
        """``job_id, rows, failed, tokens`` of every job that has run: results that were made, rows that failed, words that were sent."""
        out = []
        for j in self.jobs.values():
            if j.finished is not None:
                made = self.spark.read.parquet(j.results).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).first() if exists(self.spark, j.results) else None
                out.append((j.id, made.n if made else 0, self.failures(j.id).count(), (made.t or 0) if made else 0))
        return self.spark.createDataFrame(out, "job_id int, rows long, failed long, tokens long")


def dedup_stream(df: DataFrame, keys: list[str], time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """The first row of each key; with ``time``, keys are remembered for ``delay`` only, so state stays bounded."""
    return df.dropDuplicates(keys) if time is None else df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
