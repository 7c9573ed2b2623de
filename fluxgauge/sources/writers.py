"""Sinks. All are safe to repeat: a batch id names what the batch wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgauge.sources.readers import MAIN_TOPIC


def write_folder(df: DataFrame, folder: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write one folder; writing it again replaces just that folder."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(folder)


def write_batch(df: DataFrame, path: str, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
    """Write one batch to its own folder; running the batch again replaces just that folder."""
    write_folder(df, f"{path}/batch_id={batch_id}", partition_by)


def _folder(spark: SparkSession, path: str):
    """The path and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    folder, system = _folder(spark, path)
    system.delete(folder, True)


def remove_batch(spark: SparkSession, path: str, batch_id: int) -> None:
    """Delete one batch's folder, if it is there."""
    remove_folder(spark, f"{path}/batch_id={batch_id}")


def folder_names(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of the folders ``name=n`` under a path, by one listing of names; none if the path is not there."""
    root, system = _folder(spark, path)
    if not system.exists(root):
        return []
    names = [f.getPath().getName() for f in system.listStatus(root)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{name}="))


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether the write of a folder was completed."""
    marker, system = _folder(spark, f"{folder}/_SUCCESS")
    return system.exists(marker)


def written_batches(spark: SparkSession, path: str, before: int | None = None, since: int | None = None) -> list[int]:
    """Ids of the batches whose write was finished, ascending; only folders in the range are asked for their marker."""
    return [b for b in folder_names(spark, path, "batch_id")
            if (before is None or b < before) and (since is None or b >= since) and finished(spark, f"{path}/batch_id={b}")]


def read_batches(spark: SparkSession, path: str, schema: str, before: int | None = None, since: int | None = None,
                 only: list[int] | None = None) -> DataFrame:
    """Rows of all finished batches, of those from ``since`` on and before ``before``, or of the given ones; no other
    folder is listed.

    A table belongs to one stream: its folders carry that stream's batch ids.
    """
    wanted = written_batches(spark, path, before, since) if only is None else only
    if not wanted:
        return spark.createDataFrame([], f"{schema}, batch_id BIGINT")
    folders = [f"{path}/batch_id={b}" for b in wanted]
    return spark.read.schema(f"{schema}, batch_id BIGINT").option("basePath", path).parquet(*folders)


def append_audit(df: DataFrame, path: str, batch_id: int) -> None:
    """Accepted readings, laid out by day so that duplicate checks prune.

    Rebalancing gathers a day's rows into few files and splits a day that is too large.
    """
    write_batch(df.withColumn("day", F.to_date("date")).hint("rebalance", "day"), path, batch_id, ("day",))


def publish(records: DataFrame, servers: str, topic: str = MAIN_TOPIC) -> None:
    """Send keyed records; the idempotent producer settings match the service's."""
    (
        records.write.format("kafka")
        .options(**{"kafka.bootstrap.servers": servers, "topic": topic, "includeHeaders": "true",
                    "kafka.acks": "all", "kafka.retries": "3", "kafka.enable.idempotence": "true"})
        .save()
    )
