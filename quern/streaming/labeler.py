"""A Structured Streaming labeler: an extension, as rule labels need no state.

Answers are labelled as they come; ids seen within the watermark are labelled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions import answers as A


def answers_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """JSON-lines files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def labelled(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Final-rule labels of (example_id, ts, prompt, answer, gold_object, relation_key), each id once."""
    once = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["example_id"])
    clean = once.withColumn("answer_clean", A.clean_answer(F.col("answer"), F.col("prompt")))
    return clean.withColumn("label", A.label_final(F.col("answer_clean"), F.col("gold_object"), F.col("relation_key")))


def label_counts(stream: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Labels by event-time window and relation."""
    return labelled(stream, delay).groupBy(F.window("ts", window), "relation_key", "label").agg(F.count(F.lit(1)).alias("n"))


def write(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once; ends when what is there has been read."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
