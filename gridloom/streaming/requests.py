"""Requests as a stream: each micro-batch runs the batch plans. An addition; requests hold no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans import requests as plans

SCHEMA = "request_id string, map_id string, operation string, room_merge_list array<string>, division struct<id:string,A:array<double>,B:array<double>>"


def serve(spark: SparkSession, inbox: str, maps: DataFrame, outbox: str, checkpoint: str, config: Config | None = None, available_now: bool = True, detections: DataFrame | None = None, raw: DataFrame | None = None) -> StreamingQuery:
    """JSON request files that appear in a folder are answered as Parquet, one folder a batch."""

    def answer(batch: DataFrame, number: int) -> None:
        plans.run(batch, maps, config, detections, raw).write.mode("overwrite").parquet(f"{outbox}/batch={number}")

    writer = spark.readStream.schema(SCHEMA).json(inbox).writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
