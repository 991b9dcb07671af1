"""Quality of a growing folder: each new batch of files goes through the same aggregates as a table at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.profile import missing_counts
from ..sources.text import NO_TEXT


def text_stream(spark: SparkSession, folder: str, names: list[str], delimiter: str = ",") -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.readStream.schema(schema).options(header=True, sep=delimiter, escape='"', nullValue=NO_TEXT).csv(folder)


def watch_missing(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append missing counts of every batch, with its number, to a Parquet table; a batch that runs again replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        missing_counts(df).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch_no={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
