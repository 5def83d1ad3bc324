"""Scanning as a stream: new files are scanned once, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import file_findings
from ..sources.corpus import FILES


def read(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A stream of Parquet tables with the columns of files."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", per_batch).parquet(path)


def findings(files: DataFrame) -> DataFrame:
    """Stateless, so any output mode that appends will do; clusters of recipes need `write_batches`."""
    return file_findings(files, recipes=[])


def write(found: DataFrame, path: str, checkpoint: str):
    """Processes what is there and ends."""
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batches(files: DataFrame, path: str, checkpoint: str, recipes: list | None = None, every: str | None = None):
    """Findings of all detectors with recipes, a batch of files at a time; with `every` (an interval) it goes on, else it ends.

    A file lies whole in one batch, so its clusters are complete. Each batch is a folder of its own that is written over,
    so a batch that is repeated after a failure leaves no row twice.
    """

    def one(batch: DataFrame, number: int) -> None:
        file_findings(batch, recipes=recipes).write.mode("overwrite").parquet(f"{path}/batch={number}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def sessions(commits: DataFrame, gap: str = "600 seconds", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream of commits with an event time `at`."""
    return commits.withWatermark("at", late).groupBy("repo", F.session_window("at", gap)).agg(F.count("*").alias("commits"))


def tick(ticks: DataFrame, plan: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, every: str = "60 seconds"):
    """At each tick of a stream (timestamp) hands the entries of a plan that are due by then, and not completed, to `act`."""

    def one(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max(F.unix_timestamp("timestamp"))).first()[0]
        if now is not None:
            act(plan.where(~F.col("completed") & (F.col("target") <= now)), now)

    return ticks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


