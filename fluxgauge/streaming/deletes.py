"""Batch tables whose rows can be deleted: delete files beside the batch folders, merged when rows are read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgauge.sources.writers import finished, folder_names, read_batches, remove_folder, write_batch, write_folder, written_batches


@dataclass(frozen=True)
class DeletableTable:
    """Rows with a key, in one folder per batch, of which runs delete some.

    A delete writes only the keys that go. A rewrite writes the rows that stay of the folders that lost some, as a later
    generation; the generation with the greatest number that is finished counts, so a rewrite that ends half-way changes
    nothing, and folders without deletes are never touched. A generation carries the number of the first delete run that
    it does not hold yet. A batch that is repeated after a restart writes its first folder again; its deletes still hold.
    """

    path: str
    schema: str
    key: str

    @property
    def _deletes(self) -> str:
        return f"{self.path}-deletes"

    @property
    def _rewritten(self) -> str:
        return f"{self.path}-rewritten"

    def write(self, rows: DataFrame, batch_id: int) -> None:
        write_batch(rows, self.path, batch_id)

    def _generations(self, spark: SparkSession) -> dict[int, int]:
        """The generation that counts, of every batch; 0 is the folder that the batch itself wrote."""
        latest = {b: 0 for b in written_batches(spark, self.path)}
        for generation in sorted(folder_names(spark, self._rewritten, "generation")):
            for batch in folder_names(spark, f"{self._rewritten}/generation={generation}", "batch_id"):
                if finished(spark, f"{self._rewritten}/generation={generation}/batch_id={batch}"):
                    latest[batch] = max(generation, latest.get(batch, 0))
        return latest

    def _stored(self, spark: SparkSession, generations: dict[int, int]) -> DataFrame:
        """Rows with batch_id and generation, deleted ones too."""
        first = [b for b, g in generations.items() if g == 0]
        parts = [read_batches(spark, self.path, self.schema, only=first).withColumn("generation", F.lit(0))] if first else []
        for generation in sorted({g for g in generations.values() if g}):
            folder = f"{self._rewritten}/generation={generation}"
            of = [b for b, g in generations.items() if g == generation]
            parts.append(read_batches(spark, folder, self.schema, only=of).withColumn("generation", F.lit(generation)))
        out = parts[0] if parts else spark.createDataFrame([], f"{self.schema}, batch_id BIGINT, generation INT")
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _deleted(self, spark: SparkSession) -> DataFrame:
        """of_batch, of_key and the run of every delete."""
        key = next(c for c in spark.createDataFrame([], self.schema).schema.fields if c.name == self.key)
        return read_batches(spark, self._deletes, f"of_batch BIGINT, of_key {key.dataType.simpleString()}").withColumnRenamed("batch_id", "run")

    def _alive(self, spark: SparkSession, generations: dict[int, int]) -> DataFrame:
        rows, gone = self._stored(spark, generations), self._deleted(spark)
        same = (F.col("batch_id") == F.col("of_batch")) & (F.col(self.key) == F.col("of_key")) & (F.col("run") >= F.col("generation"))
        return rows.join(gone, same, "left_anti").drop("generation")

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows that are left, with ``batch_id``, the batch that wrote them."""
        return self._alive(spark, self._generations(spark))

    def delete(self, gone: DataFrame, run: int) -> None:
        """Delete rows, given by ``batch_id`` and the key. The same run again replaces its own deletes."""
        write_batch(gone.select(F.col("batch_id").alias("of_batch"), F.col(self.key).alias("of_key")), self._deletes, run)

    def rewrite(self, spark: SparkSession) -> list[int]:
        """Merge all deletes into the folders that they touch; returns these batches. Old generations of them are removed
        after the new one is complete, and delete files when all are merged."""
        runs = written_batches(spark, self._deletes)
        if not runs:
            return []
        generations = self._generations(spark)
        pending = [(r["of_batch"], r["run"]) for r in self._deleted(spark).select("of_batch", "run").distinct().collect()]  # folders times runs
        touched = sorted({b for b, run in pending if run >= generations.get(b, 0)})
        target = runs[-1] + 1
        if touched:
            alive = self._alive(spark, {b: generations[b] for b in touched})
            for batch in touched:
                write_folder(alive.where(F.col("batch_id") == batch).drop("batch_id"), f"{self._rewritten}/generation={target}/batch_id={batch}")
        for batch in touched:
            old = generations[batch]
            if old:
                remove_folder(spark, f"{self._rewritten}/generation={old}/batch_id={batch}")
        for run in runs:
            remove_folder(spark, f"{self._deletes}/batch_id={run}")
        return touched
