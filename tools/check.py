"""Run registered queries against their SQL on the same files and report differences.

usage: python tools/check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from panelspark import queries  # noqa: E402
from panelspark.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False):
        vals = []
        for v in row:
            if v is None or (not isinstance(v, (str, list)) and pd.isna(v)):
                vals.append("NULL")
            elif isinstance(v, pd.Timestamp):
                vals.append(str(v.date()))
            elif hasattr(v, "isoformat"):
                vals.append(v.isoformat()[:10])
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                vals.append(str(bool(v)))
            elif isinstance(v, (int, float)) or hasattr(v, "dtype"):
                vals.append(repr(float(v)))
            else:
                vals.append(str(v))
        out.append(tuple(vals))
    return sorted(out)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    reg = queries.load()
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name, e in reg.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t0 = time.time()
        try:
            got = e.run(spark, sf).toPandas()
            t1 = time.time()
            if e.sql is None:
                print(f"rows {name:34s} {len(got):7d} rows {t1 - t0:6.2f}s (no SQL)", flush=True)
                continue
            exp = con.execute(e.sql).df()
            t2 = time.time()
            if sorted(got.columns) != sorted(exp.columns):
                raise AssertionError(f"columns {sorted(got.columns)} vs {sorted(exp.columns)}")
            a, b = canon(got), canon(exp)
            if a == b:
                tag = "ok  " if len(a) else "EMPTY"
                bad += not len(a)
                print(f"{tag} {name:34s} {len(a):7d} rows {t1 - t0:6.2f}s sql {t2 - t1:5.2f}s", flush=True)
            else:
                bad += 1
                sa, sb = set(a), set(b)
                print(f"DIFF {name}: {len(a)} vs {len(b)} rows; only spark {len(sa - sb)}, only sql {len(sb - sa)}", flush=True)
                print("   cols ", sorted(got.columns))
                for r in sorted(sa - sb)[:3]:
                    print("   spark", r)
                for r in sorted(sb - sa)[:3]:
                    print("   sql  ", r)
        except Exception as ex:  # report and go on with the next query
            bad += 1
            msg = str(ex).split("JVM stacktrace")[0][:700]
            print(f"FAIL {name}: {type(ex).__name__}: {msg}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
