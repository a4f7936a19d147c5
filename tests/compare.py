"""Run catalog queries and their check statements side by side and compare the rows.

    python tests/compare.py SF_DIR [name ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "labels", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def difference(spark, con, sf_dir, name):
    """None where both sides agree, else what differs."""
    import __spark_entry__ as contract

    df = contract.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(contract.oracle_sql()[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"{len(got[1])} != {len(want[1])} rows; only here {sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"
    return None


if __name__ == "__main__":
    from inkwell.catalog import QUERIES
    from inkwell.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), connect(sf_dir)
    for name in names:
        t = time.time()
        try:
            found = difference(spark, con, sf_dir, name)
        except Exception as e:  # a report over all queries goes on
            found = f"{type(e).__name__}: {str(e)[:500]}"
        print(f"{'ok  ' if found is None else 'DIFF'} {name} {time.time() - t:.1f}s {found or ''}", flush=True)
