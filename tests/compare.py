"""Side-by-side run of a query and its SQL, as the correctness gate does it."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(type(x).__name__ if not isinstance(x, (int, float)) else ""), x if isinstance(x, (int, float, str)) else str(x)) for x in r))


def differences(spark_df, con, sql: str, show: int = 3) -> list[str]:
    names = sorted(spark_df.columns)
    got = [tuple(_plain(r[n]) for n in names) for r in spark_df.collect()]
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    if sorted(cols) != names:
        return [f"columns {names} != {sorted(cols)}"]
    at = [cols.index(n) for n in names]
    want = [tuple(_plain(r[i]) for i in at) for r in cur.fetchall()]
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)} rows", f"spark {got[:show]}", f"sql {want[:show]}"]
    bad = []
    for g, w in zip(_sorted(got), _sorted(want)):
        if g != w or any(type(a) is not type(b) and not (a is None or b is None) for a, b in zip(g, w)):
            bad.append(f"spark {g} != sql {w}")
            if len(bad) >= show:
                break
    return ([f"columns {names}"] + bad) if bad else []


def main(argv: list[str]) -> int:
    root = str(Path(__file__).resolve().parents[1])
    sys.path.insert(0, root)
    import __spark_entry__ as entry
    from tabprofile.session import build_session

    folder = argv[0]
    wanted = argv[1:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not wanted or any(n == w or n.startswith(w.rstrip("*")) and w.endswith("*") for w in wanted)]
    failed = 0
    for n in names:
        start = time.time()
        try:
            df = queries[n](spark, folder)
            if n in sqls:
                problems = differences(df, con, sqls[n])
                status = "ok" if not problems else "DIFF"
            else:
                rows = df.collect()
                problems, status = [f"{len(rows)} rows, e.g. {rows[:2]}"[:300]], "rows"
        except Exception as e:
            problems, status = [str(e)[:1200]], "ERR"
        failed += status in ("DIFF", "ERR")
        print(f"{status:5} {n} {time.time() - start:.2f}s", flush=True)
        for p in problems:
            print("      ", p[:1200], flush=True)
    print(f"{len(names)} queries, {failed} bad")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
