"""Run registered queries against DuckDB: python tests/compare.py [sf] [name part ...]"""

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, round(v, 2) if isinstance(v, float) else v if v is not None else 0) for v in row)


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: [str(k) for k in _key(r)])


def _near(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-4)
    return a == b


def compare(spark, con, build, sql, sf_dir):
    """Returns (verdict, detail): exact, near (rounding only), or diff."""
    df = build(spark, sf_dir)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return ("rows" if got else "EMPTY"), f"{len(got)} rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = _rows(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return "DIFF", f"columns {df.columns} vs {names}"
    if len(got) != len(want):
        return "DIFF", f"{len(got)} vs {len(want)} rows; {got[:2]} / {want[:2]}"
    if got == want:
        return ("exact" if got else "EMPTY"), f"{len(got)} rows"
    pairs = [(g, w) for g, w in zip(got, want) if g != w]
    if all(_near(a, b) for g, w in pairs for a, b in zip(g, w)):
        return "near", f"{len(pairs)} of {len(got)} rows: {pairs[0]}"
    bad = [(g, w) for g, w in pairs if not all(_near(a, b) for a, b in zip(g, w))]
    return "DIFF", f"{len(bad)} of {len(got)} rows: {bad[:2]} columns {sorted(names)}"


def main():
    import __spark_entry__ as entry
    from stocktide.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    tally = {}
    for name, build in entry.queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        t = time.time()
        try:
            verdict, detail = compare(spark, con, build, oracles.get(name), sf_dir)
        except Exception as e:  # report and go on
            verdict, detail = "FAIL", (str(e).split("JVM stacktrace")[0][:700] or traceback.format_exc()[-700:])
        tally[verdict] = tally.get(verdict, 0) + 1
        if verdict != "exact" or os.environ.get("VERBOSE"):
            print(f"{verdict:6} {time.time() - t:5.1f}s {name}: {detail}", flush=True)
        elif time.time() - t > 6:
            print(f"slow   {time.time() - t:5.1f}s {name}", flush=True)
    print(tally)


if __name__ == "__main__":
    main()
