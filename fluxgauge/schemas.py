"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

REQUEST = "deviceId BIGINT, measurement DECIMAL(38,9), date TIMESTAMP"

TELEMETRY = (
    "device_id BIGINT, measurement DECIMAL(10,2), date TIMESTAMP, "
    "recorded_at TIMESTAMP, arrival_seq BIGINT"
)

PROJECTION = (
    "device_id BIGINT, latest_measurement DECIMAL(10,2), "
    "latest_date TIMESTAMP, updated_at TIMESTAMP"
)

FALLBACK = (
    "event_id STRING, device_id BIGINT, measurement DECIMAL(10,2), "
    "date TIMESTAMP, failed_at TIMESTAMP"
)

EVENT = (
    "eventId STRING, deviceId BIGINT, measurement DECIMAL(38,9), "
    "date TIMESTAMP, recordedAt TIMESTAMP"
)

TOPIC_RECORD = (
    "key BINARY, value BINARY, topic STRING, partition INT, offset BIGINT, "
    "timestamp TIMESTAMP, headers ARRAY<STRUCT<key: STRING, value: BINARY>>"
)

DEVICE_RESPONSE = "deviceId BIGINT, measurement DECIMAL(10,2), date TIMESTAMP"

REJECT = "status INT, message STRING, timestamp TIMESTAMP"

METRIC_SAMPLE = "metric STRING, labels MAP<STRING, STRING>, ts TIMESTAMP, value DOUBLE"

SPAN = (
    "trace_id STRING, span_id STRING, parent_id STRING, name STRING, service STRING, "
    "start TIMESTAMP, duration_ms DOUBLE, tags MAP<STRING, STRING>"
)

OUTCOME = (
    "ts TIMESTAMP, seq BIGINT, kind STRING, elapsed_ms DOUBLE, "
    "from_state STRING, to_state STRING"
)

# The unlimited decimal a device sends, and the one the tables store.
WIRE_DECIMAL = "decimal(38,9)"
TABLE_DECIMAL = "decimal(10,2)"
