"""Compare registered queries with their SQL in DuckDB.

    python tests/oracle_tool.py [data folder] [name prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SAME_TYPE = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE",
             "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "~" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(v)


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def compare(df, con, sql: str) -> tuple[str, int]:
    """('' or the first difference, row count)."""
    cols = sorted(df.columns)
    spark_rows = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    rows = rel.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", len(spark_rows)
    at = [names.index(c) for c in cols]
    duck_rows = sorted(tuple(canon(r[i]) for i in at) for r in rows)
    if spark_rows != duck_rows:
        only_s = [r for r in spark_rows if r not in set(duck_rows)][:3]
        only_d = [r for r in duck_rows if r not in set(spark_rows)][:3]
        return f"rows {len(spark_rows)} vs {len(duck_rows)}\n   {cols}\n   spark {only_s}\n   duck  {only_d}", len(spark_rows)
    kinds = {d[0]: str(d[1]) for d in con.execute(sql).description}
    off = {f.name: (f.dataType.simpleString(), kinds[f.name]) for f in df.schema.fields
           if SAME_TYPE.get(f.dataType.simpleString(), "?") != kinds[f.name]}
    return (f"TYPES {off}" if off else ""), len(spark_rows)


def main() -> int:
    from tidewatch.catalog import load
    from tidewatch.session import build_session
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    queries, oracles = load()
    con, bad = connect(sf_dir), 0
    for name, run in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                diff, n = compare(df, con, oracles[name])
            else:
                diff, n = "", len(df.collect())
        except Exception as e:  # report and go on
            diff, n = f"ERROR {type(e).__name__}: {str(e)[:900]}", -1
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name} rows={n} {time.time() - t:.1f}s{'' if name in oracles else ' (no sql)'} {diff}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
