"""Compares a query with its SQL in DuckDB on one folder of tables."""

import glob
import math
import os

import duckdb


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 9)
    return str(v)


def rows(table):
    names = sorted(table.column_names)
    return sorted((tuple(_plain(r[n]) for n in names) for r in table.select(names).to_pylist()), key=lambda r: [(x is None, str(x)) for x in r])


def sql_rows(sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(folder + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con.execute(sql).to_arrow_table() if hasattr(con, "to_arrow_table") else con.execute(sql).fetch_arrow_table()
