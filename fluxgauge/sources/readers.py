"""Batch and streaming readers. Every one declares its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluxgauge import schemas
from fluxgauge.functions import codec

# Topic names and partition count of the service.
MAIN_TOPIC = "telemetry.recorded"
DEAD_LETTER_TOPIC = "telemetry.recorded.dlq"
TOPIC_PARTITIONS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request bodies, one JSON document per line: ``body`` and the decoded ``request``
    (null when undecodable)."""
    return codec.decode_requests(spark.read.text(path).withColumnRenamed("value", "body"))


def topic_batch(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Everything in a topic at the moment of the call, complete from first to last offset."""
    return (
        spark.read.format("kafka")
        .options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest",
                    "endingOffsets": "latest", "includeHeaders": "true"})
        .load()
    )


def topic_stream(spark: SparkSession, servers: str, topic: str = MAIN_TOPIC, max_offsets: int | None = None) -> DataFrame:
    """A topic followed from its first offset; Spark's checkpoint keeps the position."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest",
               "includeHeaders": "true"}
    if max_offsets is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return spark.readStream.format("kafka").options(**options).load()


def topic_files(spark: SparkSession, path: str) -> DataFrame:
    """Topic records kept as parquet files, in the Kafka source's schema."""
    return spark.read.schema(schemas.TOPIC_RECORD).parquet(path)


def file_stream(spark: SparkSession, path: str, schema, name_filter: str | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder."""
    reader = spark.readStream.schema(schema)
    if name_filter is not None:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def jdbc_table(spark: SparkSession, url: str, name: str, partition_column: str | None = None,
               bounds: tuple[int, int] | None = None, partitions: int | None = None, **properties: str) -> DataFrame:
    """A relational table, read in parallel ranges of ``partition_column`` when it is given."""
    options = {"url": url, "dbtable": name, "fetchsize": "10000", **properties}
    if partition_column is not None:
        lower, upper = bounds
        options |= {"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
                    "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**options).load()


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")
