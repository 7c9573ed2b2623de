"""Tables that streams keep on shared storage, one folder per batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgauge import schemas
from fluxgauge.sources.writers import append_audit, finished, folder_names, read_batches, remove_batch, remove_folder, write_batch, write_folder
from fluxgauge.streaming import bloom

_AUDIT = f"{schemas.TELEMETRY}, day DATE"

Segment = tuple[int, int]  # level and last batch

@dataclass(frozen=True)
class AuditTable:
    """Every accepted reading, in segments by day: one per batch, merged ``fan`` at a time into larger and larger ones.

    A segment counts once its entry in the manifest is complete. The entry has the segment's days and, for a merged
    segment, Bloom filters of each day's (device, date) pairs (the few that single batches wrote are not worth theirs), so
    the duplicate check opens only the day folders that may hold one of a batch's pairs. A merged segment's entry replaces those it covers; if a merge ends half-way, the old ones still count. With n
    batches there are at most ``fan`` segments on each of log(n) levels, and every row is rewritten once a level.
    """

    path: str
    fan: int = 10

    @property
    def _manifest(self) -> str:
        return f"{self.path}-manifest"

    def _folder(self, level: int, upto: int) -> str:
        return f"{self.path}-merged/level={level}/upto={upto}" if level else f"{self.path}/batch_id={upto}"

    def _entries(self, spark: SparkSession, before: int | None = None) -> tuple[list[Segment], list[Segment]]:
        """Segments of batches before ``before``: those that count, and those that a merged one has replaced."""
        found = [(level, upto) for level in folder_names(spark, self._manifest, "level")
                 for upto in folder_names(spark, f"{self._manifest}/level={level}", "upto")
                 if (before is None or upto < before) and finished(spark, f"{self._manifest}/level={level}/upto={upto}")]
        covered = [(level, upto) for level, upto in found
                   if any(high > level and last - self.fan**high < upto <= last for high, last in found)]
        return [s for s in found if s not in covered], covered

    def segments(self, spark: SparkSession, before: int | None = None) -> list[Segment]:
        return self._entries(spark, before)[0]

    def _read(self, spark: SparkSession, folders: dict[Segment, list[str]]) -> DataFrame:
        """Rows of the given folders inside each segment ("" for all), with ``day``."""
        out = spark.createDataFrame([], _AUDIT)
        for root in (self.path, f"{self.path}-merged"):
            paths = [self._folder(*s) + f for s, inside in folders.items() for f in inside if bool(s[0]) == (root != self.path)]
            if paths:
                ids = "batch_id BIGINT" if root == self.path else "level INT, upto BIGINT"
                part = spark.read.schema(f"{_AUDIT}, {ids}").option("basePath", root).parquet(*paths)
                out = out.unionByName(part.drop("batch_id", "level", "upto"))
        return out

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        return self._read(spark, {s: [""] for s in self.segments(spark, before)}).drop("day")

    def read_batch(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What a batch added; only until later batches merge it."""
        return read_batches(spark, self.path, _AUDIT, only=[batch_id]).drop("batch_id", "day")

    def may_hold(self, spark: SparkSession, pairs: DataFrame, before: int) -> dict[Segment, list[str]]:
        """Day folders of earlier segments that may hold one of the pairs (device_id, date, day)."""
        segments = self.segments(spark, before)
        if not segments:
            return {}
        entries = spark.read.schema(f"{bloom.ENTRY}, level INT, upto BIGINT").option("basePath", self._manifest).parquet(
            *[f"{self._manifest}/level={level}/upto={upto}" for level, upto in segments])
        hits = bloom.hits(pairs.select("day", bloom.pair_hash("device_id", "date").alias("hash")), entries, ["level", "upto"])
        days = hits.groupBy("level", "upto").agg(F.collect_set(F.col("day").cast("string")).alias("days"))
        return {(r["level"], r["upto"]): [f"/day={d}" for d in sorted(r["days"])] for r in days.collect()}  # no more than segments times days

    def possible(self, spark: SparkSession, pairs: DataFrame, before: int) -> DataFrame:
        """Rows of earlier batches among which all earlier copies of the given pairs are."""
        return self._read(spark, self.may_hold(spark, pairs, before)).drop("day")

    def _describe(self, spark: SparkSession, segment: Segment) -> None:
        rows = self._read(spark, {segment: [""]}).select("day", bloom.pair_hash("device_id", "date").alias("hash"))
        entry = bloom.filters(rows) if segment[0] else bloom.days(rows)
        write_folder(entry, f"{self._manifest}/level={segment[0]}/upto={segment[1]}")

    def append(self, rows: DataFrame, batch_id: int) -> None:
        append_audit(rows, self.path, batch_id)
        self._describe(rows.sparkSession, (0, batch_id))

    def merge(self, spark: SparkSession, before: int) -> None:
        """Merge every complete group of ``fan`` segments of batches before ``before``, then remove what is replaced.

        Called before a batch writes, so that a repeated batch never finds its own rows in a merged segment.
        """
        level, segments = 0, self.segments(spark, before)
        while any(found >= level for found, _ in segments):
            width = self.fan ** (level + 1)
            groups: dict[int, list[Segment]] = {}
            for segment in segments:
                if segment[0] == level and (segment[1] // width + 1) * width <= before:
                    groups.setdefault(segment[1] // width, []).append(segment)
            for group, members in groups.items():
                merged = (level + 1, (group + 1) * width - 1)
                rows = self._read(spark, {s: [""] for s in members})
                write_folder(rows.hint("rebalance", "day"), self._folder(*merged), ("day",))
                self._describe(spark, merged)
            if groups:
                segments = self.segments(spark, before)
            level += 1
        for level, upto in self._entries(spark, before)[1]:
            remove_folder(spark, f"{self._manifest}/level={level}/upto={upto}")
            remove_folder(spark, self._folder(level, upto))


@dataclass(frozen=True)
class ProjectionTable:
    """The latest reading per device, kept as changes with a full copy every few batches.

    A batch writes only the devices it touched, so its cost follows the batch, not the
    number of devices. Reading folds the last full copy and the changes after it.
    """

    path: str
    full_every: int = 50

    def _last_full(self, spark: SparkSession, before: int) -> int:
        """The last full copy that was really written; a batch that failed left none."""
        full = [b for b in folder_names(spark, self.path, "batch_id") if b < before and b % self.full_every == 0]
        return next((b for b in reversed(full) if finished(spark, f"{self.path}/batch_id={b}")), 0)

    def read(self, spark: SparkSession, before: int) -> DataFrame:
        """State before a batch. Among equal dates the later batch stays."""
        recent = read_batches(spark, self.path, schemas.PROJECTION, before, self._last_full(spark, before))
        age = F.struct("latest_date", "batch_id")
        return recent.groupBy("device_id").agg(
            F.max_by("latest_measurement", age).alias("latest_measurement"),
            F.max("latest_date").alias("latest_date"),
            F.max_by("updated_at", age).alias("updated_at"),
        )

    def current(self, spark: SparkSession) -> DataFrame:
        """State after the last batch; finding that batch reads folder names only."""
        written = folder_names(spark, self.path, "batch_id")
        return self.read(spark, written[-1] + 1 if written else 0)

    def write(self, folded: DataFrame, batch_id: int, updated_at: Column) -> None:
        """``folded`` is the batch's latest reading per device."""
        changes = folded.select("device_id", "latest_measurement", "latest_date", updated_at.alias("updated_at"))
        if batch_id % self.full_every == 0:
            stored = self.read(changes.sparkSession, batch_id)
            age = F.struct("latest_date", "new")
            changes = (
                stored.withColumn("new", F.lit(0)).unionByName(changes.withColumn("new", F.lit(1)))
                .groupBy("device_id").agg(
                    F.max_by("latest_measurement", age).alias("latest_measurement"),
                    F.max("latest_date").alias("latest_date"),
                    F.max_by("updated_at", age).alias("updated_at"),
                )
            )
        write_batch(changes, self.path, batch_id)


@dataclass(frozen=True)
class BatchTable:
    """Any other rows a stream keeps."""

    path: str
    schema: str

    def read(self, spark: SparkSession, numbered: str | None = None) -> DataFrame:
        """All rows; ``numbered`` names the column that receives the batch id, if it is wanted."""
        rows = read_batches(spark, self.path, self.schema)
        return rows.withColumnRenamed("batch_id", numbered) if numbered else rows.drop("batch_id")

    def read_batch(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return read_batches(spark, self.path, self.schema, batch_id + 1, batch_id).drop("batch_id")

    def last_before(self, spark: SparkSession, batch_id: int) -> int | None:
        """The last earlier batch whose write was finished."""
        names = folder_names(spark, self.path, "batch_id")
        return next((b for b in reversed(names) if b < batch_id and finished(spark, f"{self.path}/batch_id={b}")), None)

    def remove_before(self, spark: SparkSession, batch_id: int) -> None:
        """Drop batches that a later one replaces."""
        for old in folder_names(spark, self.path, "batch_id"):
            if old < batch_id:
                remove_batch(spark, self.path, old)

    def read_sum(self, spark: SparkSession, by: list[str], value: str) -> DataFrame:
        """What all batches added to a key."""
        return self.read(spark).groupBy(*by).agg(F.sum(value).alias(value))

    def remove(self, spark: SparkSession, batch_id: int) -> None:
        """Drop rows that only their own batch needed."""
        remove_batch(spark, self.path, batch_id)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        write_batch(rows, self.path, batch_id)
