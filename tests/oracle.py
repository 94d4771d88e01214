"""Compare a registered query with its SQL on the same parquet tables."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from larder.binding import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_norm(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(type(x)), x) if not isinstance(x, (list, dict)) else (False, "l", str(x)) for x in r])


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> list[str]:
    """Differences as text; empty when both agree."""
    started = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - started
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want_types = [str(d[1]) for d in rel.description]
    want = rel.fetchall()
    problems = []
    if sorted(df.columns) != sorted(want_cols):
        return [f"columns {sorted(df.columns)} != {sorted(want_cols)}"]
    # A value hash sees 1 and 1.0 or true and 1 as different, so kinds must agree too.
    kinds = {"bigint": "int", "int": "int", "double": "float", "string": "str", "boolean": "bool"}
    spark_types = {f.name: kinds.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    duck_kinds = {"BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool"}
    for c, t in zip(want_cols, want_types):
        if duck_kinds.get(t, t) != spark_types[c]:
            problems.append(f"type of {c}: spark {spark_types[c]} duckdb {t}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    a, b = _rows(df.columns, got), _rows(want_cols, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        problems.append(f"{len(bad)} rows differ, columns {sorted(df.columns)}; first: {bad[0]}")
    print(f"{'ok ' if not problems else 'BAD'} {name:36s} rows={len(got):7d} spark={spent:5.2f}s", *problems, sep="\n      " if problems else " ", flush=True)
    return problems


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from larder.session import build_session

    sf_dir = "/root/testdata/sf0.01"
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, sqls = queries(), oracle_sql()
    failed = []
    for name, q in qs.items():
        if argv and not any(a in name for a in argv):
            continue
        try:
            if name in sqls:
                if compare(spark, con, name, q, sqls[name], sf_dir):
                    failed.append(name)
            else:
                t = time.time()
                n = q(spark, sf_dir).count()
                print(f"--- {name:36s} rows={n:7d} spark={time.time() - t:5.2f}s (no oracle)", flush=True)
        except Exception as e:
            failed.append(name)
            print(f"ERR {name}: {type(e).__name__} {str(e)[:700]}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
