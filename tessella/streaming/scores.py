"""Scoring a stream of predictions, and rolling its score table up.

Every row operator is stateless, so the same ``select`` runs on a streaming
DataFrame. Ranks and medians need all rows: the stream appends per-row scores
to a table, and a report is a batch aggregate over that table, or reads the
states that each batch leaves beside its rows and only those rows that its
medians fall on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.functions.grids import Grid
from tessella.functions.scores import object_scores, residual
from tessella.operators.metrics import summarize
from tessella.operators.states import INTERVAL, Resolution, intervals, moments, report


def score_stream(stream: DataFrame, density: str, y: str, grid: Grid, keep: Sequence[str], point: str | None = "mode") -> DataFrame:
    """A streaming table of per-row scores."""
    scored = object_scores(stream, density, y, grid, point)
    names = dict.fromkeys([*keep, y, *(["y_pred"] if point else []), "cde", "pit", "crps", "nll"])
    return scored.select(*names)


def append_scores(scores: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends micro-batches to a score table, each exactly once.

    A batch writes its own ``batch`` partition and overwrites it when replayed.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return scores.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_with_states(batch: DataFrame, path: str, epoch: int, by: Sequence[str], resolution: Resolution = Resolution()) -> None:
    """One batch of scores, with its states; a replayed batch overwrites its own.

    Rows are written in the order of their residual's interval, so that a
    report's filter on it skips most of a file.
    """
    e = residual(F.col("y"), F.col("y_pred"), "none")
    rows = batch.withColumn(INTERVAL, resolution.interval(e)).sortWithinPartitions(INTERVAL)
    rows.write.mode("overwrite").parquet(f"{path}/scores/batch={epoch}")
    written = batch.sparkSession.read.parquet(f"{path}/scores/batch={epoch}")
    moments(written, by).write.mode("overwrite").parquet(f"{path}/moments/batch={epoch}")
    intervals(written, by, resolution).write.mode("overwrite").parquet(f"{path}/counts/batch={epoch}")


def append_with_states(scores: DataFrame, path: str, checkpoint: str, by: Sequence[str], resolution: Resolution = Resolution()) -> StreamingQuery:
    """Appends micro-batches of scores with their states, each exactly once."""
    def write(batch: DataFrame, epoch: int) -> None:
        write_with_states(batch, path, epoch, by, resolution)

    return scores.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incremental_report(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """The report over all batches so far, from their states."""
    part = lambda name: spark.read.parquet(f"{path}/{name}")
    return report(part("scores"), part("moments"), part("counts"), by)


def roll_up(spark: SparkSession, path: str, by: Sequence[str] = (), **options) -> DataFrame:
    """The report over everything appended so far."""
    return summarize(spark.read.parquet(path), "y", "y_pred", by, written=True, **options)
