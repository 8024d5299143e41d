"""Run registered queries next to their SQL twins: python tests/oracle_check.py [-d DIR] [names...]"""

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float):
        return repr(round(v, 9))
    return str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, con, name, d):
    import __spark_entry__ as e
    t = time.time()
    df = e.queries()[name](spark, d)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time() - t
    sql = e.oracle_sql().get(name)
    if sql is None:
        return None, t1, len(got[1]), "rows only"
    t = time.time()
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    t2 = time.time() - t
    note = f"duckdb {t2:.1f}s"
    if got[0] != want[0]:
        return False, t1, len(got[1]), f"columns {got[0]} vs {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return False, t1, len(got[1]), f"rows {len(got[1])} vs {len(want[1])}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
    return True, t1, len(got[1]), note


def connect(d):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def main():
    from ripple.session import build_session
    import __spark_entry__ as e
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                         "spark.ui.enabled": "false", "spark.log.level": "ERROR"})
    con = connect(a.d)
    bad = []
    for name in a.names or e.queries():
        try:
            ok, t, n, note = compare(spark, con, name, a.d)
        except Exception as ex:
            ok, t, n, note = False, 0, 0, f"{type(ex).__name__}: {str(ex)[:1500]}"
        print(f"{'rows' if ok is None else 'ok  ' if ok else 'FAIL'} {name:28s} {t:6.1f}s {n:8d}  {note}", flush=True)
        if ok is False:
            bad.append(name)
    print("failed:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
