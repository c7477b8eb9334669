"""Ingest jobs with a state for each: a job whose step fails is run again after that step's countdown, a few times at most,
and each job is in the target once, whatever restarts."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..sources import sink

REQUESTS = "job_id string, content string"
RESULT = "job_id string, status string, retries int, error string, result string"
RETRIES = 3
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Step(NamedTuple):
    """A part of a job: what it makes of the text before it, and the seconds to wait after it has failed. ``call`` must bear
    being asked again, as a lost executor does so too."""

    name: str
    call: Callable[[str], str]
    countdown: float


def steps(extract: Callable[[str], str], store: Callable[[str], str], countdowns: tuple[float, float] = (120, 60)) -> list[Step]:
    """The usual two: a model's extraction and the keeping of its result."""
    return [Step("extract", extract, countdowns[0]), Step("store", store, countdowns[1])]


class Jobs(StatefulProcessor):
    """A state holds a job's text and retries only while it waits; once it has ended, its status, so that the same
    request sent again is known (for ``forget`` seconds, or for good)."""

    def __init__(self, steps: list[Step], retries: int, forget: float | None):
        self.steps, self.retries, self.forget = steps, retries, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "content string, retries int")
        self.ended = handle.getValueState("ended", "status string", None if self.forget is None else int(self.forget * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        texts = [t for b in rows for t in b["content"] if isinstance(t, str)]
        if self.waiting.exists() or self.ended.exists():
            return
        if not any(texts):
            yield self._end(key, "failed", 0, "Empty content", None)
            return
        yield from self._run(key, min(t for t in texts if t), 0, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            content, retries = self.waiting.get()
            yield from self._run(key, content, retries, timerValues)

    def _run(self, key, content: str, retries: int, now) -> Iterator[pd.DataFrame]:
        """All steps from the first on; nothing of a run that failed is kept."""
        value = content
        for step in self.steps:
            try:
                value = step.call(value)
            except Exception as e:  # whatever a step raises is the job's failure, not the stream's
                if retries < self.retries:
                    self.waiting.update((content, retries + 1))
                    self.handle.registerTimer(now.getCurrentProcessingTimeInMs() + int(step.countdown * 1000))
                else:
                    yield self._end(key, "failed", retries, f"{step.name}: {str(e)[:100] or type(e).__name__}", None)
                return
        yield self._end(key, "completed", retries, None, value)

    def _end(self, key, status: str, retries: int, error: str | None, result: str | None) -> pd.DataFrame:
        self.waiting.clear()
        self.ended.update((status,))
        row = pd.DataFrame({"job_id": [key[0]], "status": [status], "retries": pd.array([retries], "Int32")})
        return row.assign(error=pd.Series([error], dtype="object"), result=pd.Series([result], dtype="object"))

    def close(self) -> None:
        pass


def results(requests: DataFrame, steps: list[Step], retries: int = RETRIES, forget: float | None = None) -> DataFrame:
    """(job_id, status, retries, error, result) of a stream of (job_id, content), a row for each job when it ends. Of
    requests with the same id the least text that is not empty counts if they come together, else the first; a job without
    text fails at once; requests without an id are left out."""
    d = requests.filter("job_id IS NOT NULL").select("job_id", "content")
    return d.groupBy("job_id").transformWithStateInPandas(Jobs(steps, retries, forget), RESULT, "Append", "ProcessingTime")


def start(spark: SparkSession, source: str, target: str, checkpoint: str, steps: list[Step], retries: int = RETRIES, forget: float | None = None,
          every: str = "10 seconds") -> StreamingQuery:
    """Requests from Parquet files in ``source``. A batch's rows are there when the list of its files is, which replaces
    that of an earlier attempt at the same batch; with the states in ``checkpoint``, each job is in the target once.
    Batches without a row leave nothing. The state store must be RocksDB; it is set here for the session."""
    spark.conf.set(PROVIDER, ROCKS)

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{target}/data-{uuid.uuid4().hex}"
        batch.write.parquet(folder)  # the one time that the steps are called
        sink.put_batch(spark, target, number, folder)

    stream = results(spark.readStream.schema(REQUESTS).parquet(source), steps, retries, forget)
    return stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def ended(spark: SparkSession, target: str) -> DataFrame:
    """The jobs that have ended."""
    files = sink.batch_files(spark, target)
    return spark.read.schema(RESULT).parquet(*files) if files else spark.createDataFrame([], RESULT)


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(job_id, content, retries) of the jobs that wait for their next run, from the states of the last batch."""
    d = spark.read.format("statestore").option("stateVarName", "waiting").load(checkpoint)
    return d.select(F.col("key.job_id").alias("job_id"), F.col("value.content").alias("content"), F.col("value.retries").alias("retries"))


def drain(query: StreamingQuery, done: Callable[[], bool], seconds: float = 600) -> None:
    """Wait until ``done`` says so, then end the stream; its failure is raised."""
    end = time.monotonic() + seconds
    try:
        while not done():
            if query.awaitTermination(1):
                raise RuntimeError("the stream ended before its jobs")
            if time.monotonic() > end:
                raise TimeoutError(f"jobs still wait after {seconds} s")
    finally:
        query.stop()
