"""Statements of scripts as they arrive; the same operators as in batch, which keep no state."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomline.operators.lineage import analysed, mapped, statements
from loomline.sources.scripts import stream_scripts


def stream_mapping(spark: SparkSession, folder: str, to: str, checkpoint: str) -> StreamingQuery:
    """Writes statements with their mapping rows to Parquet, each script once."""
    done = mapped(analysed(statements(stream_scripts(spark, folder))))
    return done.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
