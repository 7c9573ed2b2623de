"""Common table expressions of the checking SQL: the derived views, written independently."""

from __future__ import annotations

RAW = """raw AS (
  SELECT (event_id + (event_id * 7919) % 211) * 10000000 + event_id AS arrival_seq, event_id,
         user_id AS device_id, CAST(value AS DECIMAL(10,2)) AS measurement,
         date_trunc('hour', ts) AS date, ts,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END AS route
  FROM events)"""

ACC = f"""{RAW},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY device_id, date ORDER BY arrival_seq) AS rn FROM raw),
acc AS (SELECT * FROM ranked WHERE rn = 1)"""

LATEST = f"""{ACC},
latest AS (
  SELECT device_id, measurement AS latest_measurement, date AS latest_date FROM (
    SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY date DESC) AS newest FROM acc) t
  WHERE newest = 1)"""

AS_OF = "TIMESTAMP '2024-01-25 00:00:00'"
RECORDED_AT = "TIMESTAMP '2024-02-01 00:00:00'"

REQ = f"""{RAW},
req AS (
  SELECT arrival_seq, event_id,
         CASE WHEN event_id % 97 <> 0 THEN device_id END AS device_id,
         CASE WHEN event_id % 101 = 0 THEN CAST(measurement AS DECIMAL(38,9)) + 100000000
              WHEN event_id % 89 <> 0 THEN CAST(measurement AS DECIMAL(38,9)) END AS measurement,
         CASE WHEN event_id % 83 <> 0 THEN date END AS date, ts, k, route
  FROM raw),
cls AS (
  SELECT *,
         CASE WHEN device_id IS NULL THEN 'deviceId: deviceId is required'
              WHEN measurement IS NULL THEN 'measurement: measurement is required'
              WHEN date IS NULL THEN 'date: date is required'
              WHEN date > {AS_OF} THEN 'date cannot be in the future' END AS detail,
         abs(measurement) >= 99999999.995 AS overflow
  FROM req),
ok AS (SELECT * FROM cls WHERE detail IS NULL AND NOT overflow),
bad AS (
  SELECT event_id, CAST(CASE WHEN detail IS NOT NULL THEN 400 ELSE 500 END AS BIGINT) AS status,
         coalesce(detail, 'Internal server error') AS message, device_id, measurement, date
  FROM cls WHERE detail IS NOT NULL OR overflow),
acc_req AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id, date ORDER BY arrival_seq) AS rn FROM ok) t
  WHERE rn = 1)"""


def event_id(device: str = "device_id", date: str = "date") -> str:
    digest = f"sha256(CAST({device} AS VARCHAR) || ':' || CAST(epoch_us({date}) AS VARCHAR))"
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return " || '-' || ".join(f"substr({digest}, {start}, {size})" for start, size in cuts)


def topic_partition(key: str = "CAST(device_id AS VARCHAR)") -> str:
    return f"CAST(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % 3 AS BIGINT)"


FALLBACK = f"""{ACC},
fallback AS (
  SELECT {event_id()} AS event_id, device_id, measurement, date, ts + INTERVAL 5 SECOND AS failed_at, k
  FROM acc WHERE route = 1)"""

# Dead letters: k sets the deliveries, some values or counts are broken.
DLQ = f"""{ACC},
dlq AS (
  SELECT {event_id()} AS event_id, device_id, measurement, date, ts, k,
         CASE WHEN k % 4 = 0 THEN 'Unknown error' ELSE 'cannot store reading: ' || CAST(k % 3 AS VARCHAR) END AS error_message,
         CAST(CASE WHEN k % 10 = 9 THEN 0 ELSE k % 4 END AS BIGINT) AS retry_count,
         date_trunc('millisecond', ts) AS record_ts, {topic_partition()} AS part, event_id AS off, k % 25 = 24 AS broken
  FROM acc WHERE route = 2),
msg AS (SELECT * FROM dlq WHERE NOT broken)"""

SPANS = """spans AS (
  SELECT lpad(hex(l_orderkey), 32, '0') AS trace_id, lpad(hex(line), 16, '0') AS span_id,
         CASE WHEN line > 1 THEN lpad(hex(line // 2), 16, '0') END AS parent_id,
         'step-' || CAST(line AS VARCHAR) AS name, 'service-' || service AS service, start, duration_ms,
         CASE WHEN status = 'O' THEN 'true' ELSE 'false' END AS error
  FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(sum(l_quantity) AS DOUBLE) AS duration_ms,
               min(l_returnflag) AS service, max(l_linestatus) AS status, min(l_shipdate) AS start
        FROM lineitem GROUP BY 1, 2) t)"""

TRACES = f"""{SPANS},
traces AS (
  SELECT trace_id, count(*) AS span_count, max(duration_ms) AS longest_ms, sum(duration_ms) AS total_ms,
         min(start) AS started_at, count(DISTINCT service) AS services,
         CAST(sum(CASE WHEN error = 'true' THEN 1 ELSE 0 END) AS BIGINT) AS error_count
  FROM spans GROUP BY trace_id)"""

LOGS = r"""logs AS (
  SELECT o_orderkey AS line_no,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%g') || ' ' || CASE WHEN o_orderstatus = 'F' THEN 'ERROR' ELSE ' INFO' END
         || ' [telemetry-service,' || CASE WHEN o_orderkey % 11 = 0 THEN ','
              ELSE lpad(hex(o_orderkey), 32, '0') || ',' || lpad(hex(o_custkey), 16, '0') END
         || '] handler : order ' || CAST(o_orderkey AS VARCHAR) AS line
  FROM orders),
parsed AS (
  SELECT line_no, CAST(substr(line, 1, 23) AS TIMESTAMP) AS logged_at,
         regexp_extract(line, '(INFO|ERROR)', 1) AS level,
         nullif(regexp_extract(line, '\[[^,]*,([^,]*),', 1), '') AS trace_id,
         nullif(regexp_extract(line, '\[[^,]*,[^,]*,([^\]]*)\]', 1), '') AS span_id,
         regexp_extract(line, '\] (.*)$', 1) AS message
  FROM logs)"""
