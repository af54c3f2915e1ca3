"""Side-by-side check of a Spark query and its DuckDB oracle, in the way the
driver compares them: row count, column names, and an order-insensitive hash
of the values (columns sorted by name)."""

from __future__ import annotations

import datetime
import decimal
import hashlib
import math

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(float(v))
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return repr(v) if not isinstance(v, str) else v


def digest(columns: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(str(_norm(r[i])) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


_DUCK_TO_SPARK = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double",
                  "DATE": "date", "BOOLEAN": "boolean", "HUGEINT": "hugeint", "FLOAT": "float"}


def _duck_type(t) -> str:
    t = str(t)
    if t.startswith("DECIMAL"):
        return t.lower().replace(" ", "")
    return _DUCK_TO_SPARK.get(t, t)


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, con=None) -> dict:
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    out = {"name": name, "spark_rows": len(s_rows), "columns": s_cols}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duckdb_connection(sf_dir)
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_types = {c[0]: _duck_type(c[1]) for c in res.description}
    d_rows = res.fetchall()
    s_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out["type_diffs"] = {c: (s_types[c], d_types.get(c)) for c in s_types if s_types[c] != d_types.get(c)}
    out["duck_rows"] = len(d_rows)
    out["cols_match"] = sorted(s_cols) == sorted(d_cols)
    out["hash_match"] = out["cols_match"] and digest(s_cols, s_rows) == digest(d_cols, d_rows)
    out["status"] = "ok" if (out["hash_match"] and len(s_rows) == len(d_rows)) else "MISMATCH"
    if out["status"] == "ok" and out["type_diffs"]:
        out["status"] = "TYPES"
    if out["status"] != "ok":
        out["duck_columns"] = d_cols
        s_set = {tuple(_norm(r[s_cols.index(c)]) for c in sorted(s_cols)) for r in s_rows}
        if out["cols_match"]:
            d_set = {tuple(_norm(r[d_cols.index(c)]) for c in sorted(d_cols)) for r in d_rows}
            out["only_spark"] = sorted(s_set - d_set, key=str)[:3]
            out["only_duck"] = sorted(d_set - s_set, key=str)[:3]
    return out


def main(argv: list[str] | None = None) -> int:
    """``python -m vintage.plans.check SF_DIR [QUERY ...]``: compare every
    (or the named) registered query with its oracle; exit 1 on a mismatch."""
    import json
    import sys

    from vintage.plans.catalog import REGISTRY
    from vintage.session import local_session

    args = sys.argv[1:] if argv is None else argv
    sf_dir, names = args[0], args[1:] or list(REGISTRY)
    spark = local_session()
    con = duckdb_connection(sf_dir)
    bad = 0
    for n in names:
        fn, sql = REGISTRY[n]
        r = compare(spark, sf_dir, n, fn, sql() if sql else None, con)
        bad += r["status"] not in ("ok", "rows-only")
        print(json.dumps({k: v for k, v in r.items() if k != "columns"}, default=str), flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
