"""Row-by-row comparison of a query with its SQL in DuckDB."""

import datetime
import glob
import math
import os

import duckdb

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


TYPES = {"long": "BIGINT", "integer": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def connect(sf_dir=SF_DIR):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None:
        return ("", "null")
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, float):
        return ("f", "nan" if math.isnan(value) else repr(value))
    if isinstance(value, datetime.datetime):
        return ("t", value.replace(tzinfo=None).isoformat())
    return (type(value).__name__, str(value))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark, con, build, sql, sf_dir=SF_DIR):
    """Empty text when the query and the SQL agree in columns, types and rows."""
    df = build(spark, sf_dir)
    ours = [tuple(row) for row in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    types = sorted((d[0], str(d[1])) for d in cursor.description)
    if types != sorted((f.name, TYPES[f.dataType.typeName()]) for f in df.schema.fields):
        return f"types {types} != {df.dtypes}"
    left, right = rows_of(df.columns, ours), rows_of(names, theirs)
    if left == right:
        return "" if left else "both sides are empty"
    first = next(((a, b) for a, b in zip(left, right) if a != b), ("", ""))
    return f"{len(left)} rows != {len(right)} rows; {sorted(names)}\n{first[0]}\n{first[1]}"
