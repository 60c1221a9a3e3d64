"""Watching a folder: a scan a tick, or one; the register decides what is new."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import intake
from ..sources import files


def name_of(checkpoint: str, number: int) -> str:
    """A batch's name in the register: the same when a stream runs it again, another for another stream."""
    return f"stream-{hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}-{number}"


def watch(spark: SparkSession, config: files.Config, as_of_year: int, checkpoint: str, **how) -> StreamingQuery:
    """A query that scans the folder every ``poll_interval_seconds``.

    The stream only ticks: a file that hasn't settled is seen again at the next tick, which a stream of files would not
    do. A tick that fails ends the query, and a restart goes on with what the register lacks.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    run = lambda batch, number: intake.scan(spark, config, as_of_year, batch=name_of(checkpoint, number), **how)
    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=f"{config.poll_interval_seconds} seconds").start()


def scan_available(spark: SparkSession, config: files.Config, as_of_year: int, checkpoint: str, **how) -> StreamingQuery:
    """A query that scans the folder once and ends. A file that hasn't settled is left to the next run, as it is the register that says what is new."""
    tick = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    run = lambda batch, number: intake.scan(spark, config, as_of_year, batch=name_of(checkpoint, number), **how)
    return tick.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(once=True).start()
