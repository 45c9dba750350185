"""Incremental ingest as a file stream: each file once, however often the job runs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest_new(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str) -> int:
    """Read the files of ``source`` that the checkpoint has not seen, write them to ``out``; the rows written now."""
    stream = spark.readStream.schema(schema).option("header", True).csv(source).withColumn("_file", F.input_file_name())
    written = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    written.awaitTermination()
    return sum(batch.numInputRows for batch in written.recentProgress)


def windowed_counts(events: DataFrame, time: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Rows of each key and window, late rows up to the watermark included; for streams and tables alike."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width), key).agg(F.count("*").alias("rows")).select(F.col("window.start").alias("start"), key, "rows")
