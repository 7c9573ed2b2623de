"""Records whose delivery kept failing: routed with their reason, listed, published again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgauge.functions import codec, headers, outcome
from fluxgauge.sources.readers import DEAD_LETTER_TOPIC


def route(records: DataFrame, failure: Column) -> tuple[DataFrame, DataFrame]:
    """Split records into good ones and dead letters.

    ``failure`` is the text of the failing rule, null for a good record. A row rule fails
    the same way on every attempt, so the record carries one header pair per delivery up
    to the retry limit, as it would after real retries. Key and value stay unchanged.
    """
    judged = records.withColumn("_failure", failure)
    good = judged.where(F.col("_failure").isNull()).drop("_failure")
    text = F.col("_failure")
    pairs = [
        pair
        for attempt in range(1, outcome.MAX_RETRIES + 1)
        for pair in (headers.header(headers.RETRY_COUNT, F.lit(str(attempt))),
                     headers.header(headers.EXCEPTION_MESSAGE, text))
    ]
    bad = (
        judged.where(text.isNotNull())
        .withColumns({"headers": headers.append(F.col("headers"), *pairs), "topic": F.lit(DEAD_LETTER_TOPIC)})
        .drop("_failure")
    )
    return good, bad


def messages(records: DataFrame) -> DataFrame:
    """Dead letters as messages: the event, why and how often it failed, and when.
    Records that cannot be decoded are left out; ``undecodable`` lists them."""
    return codec.decode_events(records).where(F.col("event").isNotNull()).select(
        "event",
        headers.error_message(F.col("headers")).alias("errorMessage"),
        headers.retry_count(F.col("headers")).alias("retryCount"),
        "timestamp",
        "partition",
        "offset",
    )


def undecodable(records: DataFrame) -> DataFrame:
    return codec.decode_events(records).where(F.col("event").isNull()).drop("event")


def in_topic_order(df: DataFrame) -> DataFrame:
    return df.orderBy("partition", "offset")


def errors(listed: DataFrame) -> DataFrame:
    """How often each error occurs, and the highest retry count seen with it."""
    return listed.groupBy("errorMessage").agg(F.count("*").alias("n"), F.max("retryCount").alias("max_retries"))


def reprocess(listed: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Events to publish again. With a ledger (``eventId`` of earlier runs) a second run
    publishes nothing twice; without one every run publishes everything."""
    events = listed.select("event.*")
    return events if ledger is None else events.join(ledger.select("eventId").distinct(), "eventId", "left_anti")


def reprocess_summary(events: DataFrame) -> DataFrame:
    counted = events.agg(F.count("*").alias("reprocessed_count"))
    return counted.withColumn("message", outcome.count_message(
        F.col("reprocessed_count"), outcome.REPROCESSED, outcome.NOTHING_TO_REPROCESS))


def retry_schedule(
    failed: DataFrame, retries: Column, failed_at: Column, max_retries: int | None = outcome.MAX_RETRIES
) -> DataFrame:
    """One row per retry of each failed record: its delay, the delay so far, when it is due.

    The delivery policy makes ``max_retries`` retries at most, and none beyond them is scheduled. With None, every retry
    that the record's header tells of is numbered.
    """
    made = retries if max_retries is None else F.least(retries, F.lit(max_retries))
    attempts = F.when(retries > 0, F.sequence(F.lit(1), made))
    rows = failed.withColumn("_failed_at", failed_at).withColumn("attempt", F.explode(attempts))
    # The delays form a geometric series, so the running total needs no window.
    total = (
        outcome.backoff_ms(F.col("attempt") + 1) - F.lit(outcome.FIRST_DELAY_MS)
    ) / F.lit(outcome.DELAY_FACTOR - 1)
    return rows.withColumns({
        "delay_ms": outcome.backoff_ms(F.col("attempt")),
        "elapsed_ms": total.cast("bigint"),
    }).withColumn("due_at", F.timestamp_micros(F.unix_micros("_failed_at") + F.col("elapsed_ms") * 1000)).drop("_failed_at")


# Buckets of the no-loss check: their digests are all that is compared while nothing is wrong.
BUCKETS = 1 << 16

_PLACES = ("accepted", "published", "fallback", "dead_letter")


def _tagged(frames: tuple[DataFrame, ...], buckets: int) -> DataFrame:
    """Ids of all four sets with their place and the bucket and number of their hash."""
    union = None
    for place, frame in enumerate(frames):
        rows = frame.select("event_id", F.lit(place).alias("place"), F.xxhash64(F.col("event_id").cast("string")).alias("_hash"))
        union = rows if union is None else union.unionByName(rows)
    return union.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))


def _digests(tagged: DataFrame) -> DataFrame:
    """Count, sum and exclusive or of the hashes per bucket, accepted against kept. They
    combine before the shuffle, so ids stay where they are."""
    sign = F.when(F.col("place") == 0, 1).otherwise(-1).cast("bigint")
    low, high = F.col("_hash").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("_hash", 32)
    return tagged.groupBy("_bucket").agg(
        *[F.count_if(F.col("place") == i).alias(name) for i, name in enumerate(_PLACES)],
        F.sum(sign * low).alias("_low"), F.sum(sign * high).alias("_high"), F.bit_xor("_hash").alias("_xor"))


def _differs() -> Column:
    balanced = F.col("accepted") == F.col("published") + F.col("fallback") + F.col("dead_letter")
    return ~(balanced & (F.col("_low") == 0) & (F.col("_high") == 0) & (F.col("_xor") == 0))


def _faulty(tagged: DataFrame) -> DataFrame:
    suspects = tagged.join(_digests(tagged).where(_differs()).select("_bucket"), "_bucket", "left_semi")
    per_id = suspects.groupBy("event_id").agg(
        F.count_if(F.col("place") == 0).alias("_accepted"), F.count_if(F.col("place") > 0).alias("places"))
    fault = (
        F.when((F.col("_accepted") > 0) & (F.col("places") == 0), "lost")
        .when((F.col("_accepted") > 0) & (F.col("places") > 1), "kept_twice")
        .when(F.col("_accepted") == 0, "unknown")
    )
    return per_id.select("event_id", fault.alias("fault"), "places").where(F.col("fault").isNotNull())


def faults(
    accepted: DataFrame, published: DataFrame, fallback: DataFrame, dead: DataFrame, buckets: int = BUCKETS
) -> DataFrame:
    """Ids that are lost, kept twice or unknown: every accepted id belongs in exactly one of
    the three places.

    A digest per bucket of ids tells which buckets are in order; ids are shuffled and compared
    in the others only. A fault escapes if all three digests of its bucket agree by chance,
    about once in 2^64. An id that was accepted twice and kept once is not told of. Null is an
    id like any other.
    """
    return _faulty(_tagged((accepted, published, fallback, dead), buckets))


def reconcile(
    accepted: DataFrame, published: DataFrame, fallback: DataFrame, dead: DataFrame, buckets: int = BUCKETS
) -> DataFrame:
    """How many ids each set holds, and how many are lost, kept twice or unknown (see ``faults``)."""
    tagged = _tagged((accepted, published, fallback, dead), buckets)
    kinds = ("lost", "kept_twice", "unknown")
    none = F.lit(0).cast("bigint")
    sizes = _digests(tagged).agg(*[F.coalesce(F.sum(n), none).alias(n) for n in _PLACES])
    wrong = _faulty(tagged).agg(*[F.count_if(F.col("fault") == k).alias(k) for k in kinds])
    both = sizes.withColumns({k: none for k in kinds}).unionByName(wrong.withColumns({n: none for n in _PLACES}))
    return both.agg(*[F.sum(c).alias(c) for c in (*_PLACES, *kinds)])
