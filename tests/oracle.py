"""Run a query and its SQL twin, and compare them as multisets of rows."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return str(value) if not isinstance(value, (bool, int, float, type(None))) else value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_cell(row[i]) for i in order]) for row in rows)


KINDS = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double",
         "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


def compare(frame, con, sql):
    """The first difference found, or None."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in result.description}
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    ours = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    if ours != kinds:
        return f"types {({k: (ours[k], kinds[k]) for k in ours if ours[k] != kinds[k]})}"
    left = _rows(frame.columns, frame.collect())
    right = _rows(names, result.fetchall())
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    return next((f"{a} != {b}" for a, b in zip(left, right) if a != b), None)
