"""Compare registered queries with their SQL: ``python tests/parity.py SF [NAME...]``."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings graph_nodes graph_node_snapshots function_nodes code_blocks agent_events agent_decisions cfm_vectors cfm_calibration judged_nodes eval_items mix_targets".split()


def plain(v):
    if v is None or isinstance(v, (int, str, bool)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return tuple(plain(x) for x in v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def sql_rows(sf, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if Path(sf, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def compare(spark, sf, name, query, sql):
    """None if equal, else a short account of the difference."""
    df = query(spark, sf)
    got = rows_of(df.columns, df.collect())
    names, want = sql_rows(sf, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want = rows_of(names, want)
    if got != want:
        a, b = set(got), set(want)
        return f"{len(got)} and {len(want)} rows; only Spark {list(a - b)[:3]}; only SQL {list(b - a)[:3]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as e
    from graphloom.session import build_session

    sf = sys.argv[1]
    spark = build_session("parity", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("ERROR")
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or qs:
        began = time.time()
        try:
            if name in sqls:
                why = compare(spark, sf, name, qs[name], sqls[name])
            else:
                why = None
                print(f"      rows {qs[name](spark, sf).count()}", end=" ")
        except Exception as x:
            why = f"{type(x).__name__}: {str(x)[:1500]}"
        bad += why is not None
        print(f"{'ok  ' if why is None else 'DIFF'} {name} {time.time() - began:.1f}s {why or ''}", flush=True)
    sys.exit(bool(bad))
