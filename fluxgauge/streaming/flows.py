"""The two streams of the service: readings in, and events to the read model.

Both work batch by batch. Every write goes to a folder named by the batch id, so a batch
that is repeated after a failure replaces its own output and nothing is kept twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fluxgauge import schemas
from fluxgauge.functions import codec, headers, ids
from fluxgauge.operators import blocks, dead_letter, dedup, events, fallback, metrics, projection, validate
from fluxgauge.streaming import repeats
from fluxgauge.streaming.delivery import Sink, with_fallback, with_retries
from fluxgauge.streaming.tables import AuditTable, BatchTable, ProjectionTable

COUNTER_ROW = "metric STRING, labels MAP<STRING, STRING>, value BIGINT, ts TIMESTAMP"
_REQUEST_COLUMNS = "device_id BIGINT, measurement DECIMAL(38,9), date TIMESTAMP, arrival_seq BIGINT"
_RECORD = ("key", "value", "topic", "partition", "offset", "timestamp", "headers")
_ARRIVAL = "device_id BIGINT, date TIMESTAMP, measurement DECIMAL(10,2), arrival_seq BIGINT"
DECODED_ROW = (
    f"{_ARRIVAL}, broken STRUCT<key: BINARY, value: BINARY, topic: STRING, partition: INT, offset: BIGINT, "
    "timestamp: TIMESTAMP, headers: ARRAY<STRUCT<key: STRING, value: BINARY>>>, reason STRING, "
    f"{repeats.PUBLISHED}"
)
FLAG_ROW = f"{_ARRIVAL}, out_of_order BOOLEAN"
REJECT_ROW = f"{_REQUEST_COLUMNS}, {schemas.REJECT}"


def batch_time() -> Column:
    """The present as a literal, so that all steps of a batch judge by the same moment."""
    return F.timestamp_micros(F.lit(time.time_ns() // 1000))


def _write_counters(table: BatchTable, df: DataFrame, counts: dict[str, int], batch_id: int, now: Column) -> None:
    """One row per counter: what the batch added, and when."""
    rows = [(name, metrics.TAGS.get(name, {}), int(count or 0)) for name, count in counts.items()]
    named = df.sparkSession.createDataFrame(rows, COUNTER_ROW.rpartition(", ")[0])
    table.write(named.withColumn("ts", now), batch_id)


@dataclass
class WriteSide:
    """Validate, drop repeats, keep accepted readings, publish their events."""

    root: str
    publish: Sink
    now: Callable[[], Column] = batch_time
    producer: str | None = None   # a producer with new batch numbers needs a new name; its tables' root by default
    audit: AuditTable = field(init=False)
    rejects: BatchTable = field(init=False)
    fallback: BatchTable = field(init=False)
    counters: BatchTable = field(init=False)
    firsts: BatchTable = field(init=False)

    def __post_init__(self) -> None:
        self.audit = AuditTable(f"{self.root}/audit")
        self.firsts = BatchTable(f"{self.root}/firsts", f"{_ARRIVAL}, day DATE")
        self.rejects = BatchTable(f"{self.root}/rejects", REJECT_ROW)
        self.fallback = BatchTable(f"{self.root}/fallback", schemas.FALLBACK)
        self.counters = BatchTable(f"{self.root}/write-counters", COUNTER_ROW)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """``batch``: device_id, measurement, date, arrival_seq."""
        spark, now = batch.sparkSession, self.now()
        checked = validate.classify(batch, now)
        seen = Observation()
        observed = checked.observe(
            seen, metrics.received(checked).alias("received"), F.count_if(F.col("failure").isNull()).alias("valid"))
        self.rejects.write(validate.rejects(observed, now).select(*batch.columns, "status", "message", "timestamp"), batch_id)
        found = seen.get

        valid = validate.valid(checked)
        # one row per pair, stored before it is looked up, so the input is read once more and not for every step
        first = dedup.first_arrivals(valid).withColumns({
            "day": F.to_date("date"), "measurement": F.col("measurement").cast(schemas.TABLE_DECIMAL)})
        self.firsts.write(first.select("device_id", "date", "measurement", "arrival_seq", "day"), batch_id)
        self.audit.merge(spark, batch_id)
        firsts = self.firsts.read_batch(spark, batch_id)
        earlier = self.audit.possible(spark, firsts, batch_id)
        self.audit.append(dedup.audit_rows(dedup.not_stored(firsts, earlier), now), batch_id)
        self.firsts.remove(spark, batch_id)

        # Read back what was written: later steps see exactly the stored rows.
        accepted = self.audit.read_batch(spark, batch_id)
        published = events.envelope(accepted, F.col("recorded_at"))
        records = events.topic_records(published, F.col("recordedAt"), headers.producer_batch(self.producer or self.root, batch_id))
        deliver = with_fallback(self.publish, self.fallback.write)
        deliver(records, fallback.rows(published, now), batch_id)
        duplicates = found["valid"] - accepted.count()
        _write_counters(self.counters, batch, {
            metrics.RECEIVED: found["received"], metrics.DUPLICATES: duplicates}, batch_id, self.now())


@dataclass
class ReadSide:
    """Decode events, set broken records aside, keep the latest reading per device."""

    root: str
    now: Callable[[], Column] = batch_time
    wait: Callable[[float], None] = time.sleep
    block_width: int = blocks.ARRIVALS_PER_BLOCK   # in offsets; wider if the topic's offsets have gaps
    projection: ProjectionTable = field(init=False)
    dead_letters: BatchTable = field(init=False)
    flags: BatchTable = field(init=False)
    decoded: BatchTable = field(init=False)
    fresh: BatchTable = field(init=False)
    published: BatchTable = field(init=False)
    counters: BatchTable = field(init=False)

    def __post_init__(self) -> None:
        self.projection = ProjectionTable(f"{self.root}/projection")
        self.dead_letters = BatchTable(f"{self.root}/dead-letters", schemas.TOPIC_RECORD)
        self.flags = BatchTable(f"{self.root}/flags", FLAG_ROW)
        self.decoded = BatchTable(f"{self.root}/decoded", DECODED_ROW)
        self.fresh = BatchTable(f"{self.root}/fresh", DECODED_ROW)
        self.published = BatchTable(f"{self.root}/published", repeats.PUBLISHED)
        self.counters = BatchTable(f"{self.root}/read-counters", COUNTER_ROW)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Fold a batch, with retries. Faulty records are dead letters one by one; a fault of the tables says nothing
        about records, so it is raised and the stream's checkpoint repeats the batch, which replaces its own folders."""
        with_retries(self.fold, batch, batch_id, self.wait)

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        """``batch``: topic records. Devices keep their order through their partition's offsets. Records that their
        producer has published before are left out."""
        spark = batch.sparkSession
        # Decode once; every later step reads the narrow decoded rows.
        decoded = codec.decode_events(batch)
        stored = codec.table_decimal(F.col("event.measurement"))
        reason = F.when(F.col("event").isNull(), "cannot decode event")
        for name in ("deviceId", "date", "measurement"):
            reason = reason.when(F.col(f"event.{name}").isNull(), f"{name} is missing")
        reason = reason.when(stored.isNull(), "measurement does not fit")
        producer, producer_batch = headers.producer_of(F.col("headers"))
        seen = Observation()
        self.decoded.write(decoded.select(
            F.col("event.deviceId").alias("device_id"), F.col("event.date").alias("date"),
            stored.alias("measurement"),
            ids.arrival(F.col("partition"), F.col("offset")).alias("arrival_seq"),
            F.when(reason.isNotNull(), F.struct(*[F.col(name) for name in _RECORD])).alias("broken"),
            reason.alias("reason"),
            F.coalesce("partition", F.lit(0)).alias("partition"), producer.alias("producer"),
            producer_batch.alias("producer_batch"),
            F.coalesce("event.eventId", F.sha2("value", 256)).alias("record_id"),
        ).observe(seen, F.count("*").alias("n"), F.count("producer").alias("numbered")), batch_id)
        staged = self.decoded.read_batch(spark, batch_id)
        repeated = 0
        if seen.get["numbered"]:
            left = Observation()
            before = self.published.last_before(spark, batch_id)
            known = repeats.nothing(spark) if before is None else self.published.read_batch(spark, before)
            self.fresh.write(repeats.unseen(staged, known).observe(left, F.count("*").alias("n")), batch_id)
            self.published.write(repeats.open_batches(staged, known), batch_id)
            if before is not None:
                self.published.remove_before(spark, before)
            staged = self.fresh.read_batch(spark, batch_id)
            repeated = seen.get["n"] - left.get["n"]

        faulty = staged.where(F.col("broken").isNotNull()).select("broken.*", "reason")
        _, dead = dead_letter.route(faulty, F.col("reason"))
        dead = dead.drop("reason")
        sent = Observation()
        self.dead_letters.write(dead.observe(sent, F.count("*").alias("n")), batch_id)

        arrived = staged.where(F.col("broken").isNull()).select("device_id", "date", "measurement", "arrival_seq")
        late = Observation()
        flagged = projection.with_out_of_order(arrived, self.projection.read(spark, batch_id), self.block_width).drop("stored_date")
        self.flags.write(flagged.observe(late, F.count_if("out_of_order").alias("n")), batch_id)
        self.projection.write(projection.latest(arrived), batch_id, self.now())
        _write_counters(self.counters, batch, {
            metrics.OUT_OF_ORDER: late.get["n"], metrics.DLQ_SENT: sent.get["n"],
            metrics.REPEATED: repeated}, batch_id, self.now())
        self.decoded.remove(spark, batch_id)
        self.fresh.remove(spark, batch_id)


def start(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str,
          available_now: bool = False, interval: str = "2 seconds", name: str | None = None) -> StreamingQuery:
    """Run a batch function over a stream; the checkpoint commits a batch after it succeeded."""
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    if name is not None:
        writer = writer.queryName(name)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def run_once(stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that is there now."""
    start(stream, process, checkpoint, available_now=True).awaitTermination()
