"""Incremental prediction: new precursor files in, library files out, each input file exactly once."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from specloom.plans.commands import predicted
from specloom.schema import drop_helpers


def predict_stream(spark: SparkSession, precursors_dir: str, output_dir: str, checkpoint: str, max_files: int = 16, **options: Any) -> StreamingQuery:
    """Processes what is there and ends; a later call with the same checkpoint takes new files only. Each batch is written to
    a folder of its own, over any earlier try."""
    schema = spark.read.parquet(precursors_dir).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(precursors_dir)

    def write(batch: DataFrame, number: int) -> None:
        drop_helpers(predicted(batch, **options)).write.mode("overwrite").parquet(f"{output_dir}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
