"""Compare queries() with oracle_sql(): row counts, column names and sorted values. `python tests/oracle.py [SF] [NAME...]`."""

import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, decimal.Decimal):
        return round(float(x), 9)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def truth(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def compare(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    names, values = truth(sf_dir, sql)
    want = rows(names, values)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} rows differ, first {bad[0][0]} against {bad[0][1]}" if bad else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    os.environ["PYTHONPATH"] = os.getcwd() + ":" + os.environ.get("PYTHONPATH", "")
    session = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    oracle, failed = entry.oracle_sql(), 0
    for name, q in entry.queries().items():
        if len(sys.argv) > 2 and not any(a in name for a in sys.argv[2:]) or len(sys.argv) <= 2 and name[:2] == "op" and name[2].isdigit() or name == "pipeline":
            continue
        t = time.time()
        try:
            said = compare(session, name, q, oracle[name], sf) if name in oracle else f"(rows only: {q(session, sf).count()})"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:400]}"
        failed += bool(said) and said[0] != "("
        print(f"{name}: {said or 'ok'} [{time.time() - t:.1f} s]", flush=True)
    print("failed:", failed)
