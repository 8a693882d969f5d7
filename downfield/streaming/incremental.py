"""Idempotent weekly upserts, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from downfield.operators.windows import KEY, ORDER, lead_targets

PERIOD = ("season", "week")


def replace_periods(df: DataFrame, new: DataFrame, period: Sequence[str] = PERIOD) -> DataFrame:
    """``new`` in place of the rows of its periods; the few periods are the broadcast side of the anti-join once known small."""
    return df.join(new.select(*period).distinct(), list(period), "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(df: DataFrame, new: DataFrame, targets: Sequence[str], keys: Sequence[str] = KEY, order: Sequence[str] = ORDER, period: Sequence[str] = PERIOD) -> DataFrame:
    """The dataset with re-delivered weeks replaced and leads computed again; last rows stay, with null targets."""
    names = [f"next_week_{t}" for t in targets]
    return lead_targets(replace_periods(df.drop(*names), new.drop(*names), period), targets, keys, order)


def write_batch(batch: DataFrame, path: str, period: Sequence[str] = PERIOD) -> None:
    """Overwrite just the partitions that a batch brings, so that a batch delivered twice changes nothing; empty ones are skipped."""
    if batch.isEmpty():
        return
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*period).parquet(path)


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], like.schema)


def stream_upserts(stream: DataFrame, path: str, checkpoint: str, period: Sequence[str] = PERIOD, available_now: bool = True) -> StreamingQuery:
    """Upsert what lands, each micro-batch's periods as whole partitions; a period is expected whole in one batch.

    Targets are not stored: a late week changes those of the week before, so they are leads over what is read.
    """
    writer = stream.writeStream.foreachBatch(lambda batch, _: write_batch(batch, path, period)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def with_targets(spark: SparkSession, path: str, targets: Sequence[str], keys: Sequence[str] = KEY, order: Sequence[str] = ORDER) -> DataFrame:
    return lead_targets(spark.read.parquet(path), targets, keys, order)


def weekly_round(dataset: DataFrame, new: DataFrame, targets: Sequence[str], models, predicted: DataFrame | None, name: str) -> tuple[DataFrame, object, DataFrame | None]:
    """One week: upsert, fit again, and compare what was predicted with what came; an empty week changes nothing."""
    if new.isEmpty():
        return dataset, models, None
    whole = upsert(dataset, new, targets)
    again = models.update(whole, [f"next_week_{t}" for t in targets]) if models is not None else None
    seen = None
    if predicted is not None:
        seen = predicted.join(new.select(name, *(F.col(t).alias(f"actual_{t}") for t in targets)), name, "left")
    return whole, again, seen
