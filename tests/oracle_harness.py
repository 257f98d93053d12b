"""Run a registered Spark query and its DuckDB oracle and compare them.

Mirrors the driver's check: row count, column names, and an order-insensitive
comparison of values (doubles rounded to 6 places).
"""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(x)) for x in row)


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    import __spark_entry__ as E

    q = E.queries()[name]
    sql = E.oracle_sql().get(name)
    sdf = q(spark, sf_dir)
    s_cols = list(sdf.columns)
    s_rows = [tuple(r) for r in sdf.collect()]
    out = {"name": name, "spark_rows": len(s_rows), "spark_cols": sorted(s_cols)}
    if sql is None:
        out["oracle"] = None
        return out
    con = con or duck(sf_dir)
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    out.update(oracle_rows=len(d_rows), oracle_cols=sorted(d_cols))
    out["cols_match"] = sorted(s_cols) == sorted(d_cols)
    if not out["cols_match"]:
        out["match"] = False
        return out
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_order = [d_cols.index(s_cols[i]) for i in order]
    a = sorted((tuple(_norm(r[i]) for i in order) for r in s_rows), key=_key)
    b = sorted((tuple(_norm(r[i]) for i in d_order) for r in d_rows), key=_key)
    out["match"] = a == b
    if not out["match"]:
        diff_a = [r for r in a if r not in b][:3]
        diff_b = [r for r in b if r not in a][:3]
        out["spark_only"] = diff_a
        out["oracle_only"] = diff_b
    return out


if __name__ == "__main__":
    import json

    from aspectra.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session()
    import __spark_entry__ as E

    con = duck(sf)
    names = names or list(E.queries())
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf, con)
        except Exception as e:  # report and continue
            r = {"name": n, "error": repr(e)[:400]}
        ok = r.get("match", r.get("oracle", "x") is None and "error" not in r)
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + json.dumps(r, default=str, ensure_ascii=False)[:900], flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
