"""File readers: topic twins, pages, snapshots (batch and streaming).

A topic twin is a folder of parquet files with ``(value STRING, offset
BIGINT)`` rows; the streaming reader takes new files as they land, like
a topic consumer taking new messages.  Schemas are always given, never
inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TOPIC_RECORD = T.StructType(
    [T.StructField("value", T.StringType()), T.StructField("offset", T.LongType())]
)


# Bounds one micro-batch (``availableNow`` splits a backlog accordingly),
# and so how many rows one key brings to one stateful call.
DEFAULT_MAX_FILES_PER_TRIGGER = 64


def stream_topic(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = DEFAULT_MAX_FILES_PER_TRIGGER
) -> DataFrame:
    reader = spark.readStream.schema(TOPIC_RECORD)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(path)


def read_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """SRC-6: the text of landed response pages (one JSON page per line, or
    one pretty-printed page per file with ``multi_line``)."""
    return spark.read.text(path, wholetext=multi_line)


def stream_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return stream_text(spark, path, multi_line, max_files_per_trigger=None)


def stream_text(spark: SparkSession, path: str, whole_text: bool = False,
                max_files_per_trigger: int | None = DEFAULT_MAX_FILES_PER_TRIGGER) -> DataFrame:
    """SRC-5 / SRC-7: raw text, one record per line or per file.

    ``wholetext`` goes as the keyword: ``text()``'s own default would
    override an option set before it.
    """
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.text(path, wholetext=whole_text)
