"""Compare Spark queries with their SQL in DuckDB: python tests/check.py [sf] [name ...]"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(pdf: pd.DataFrame) -> list[str]:
    pdf = pdf[sorted(pdf.columns)]
    out = []
    for row in pdf.itertuples(index=False, name=None):
        cells = []
        for v in row:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                cells.append("NULL")
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                cells.append(str(bool(v)))
            elif hasattr(v, "__float__") and not isinstance(v, str):
                cells.append(f"{float(v):.9g}")
            else:
                cells.append(str(v))
        out.append("|".join(cells))
    return sorted(out)


def kind(dtype: str) -> str:
    if dtype in ("tinyint", "smallint", "int", "integer", "bigint", "number"):
        return "int"
    if dtype in ("float", "double"):
        return "float"
    return {"varchar": "string", "bool": "boolean"}.get(dtype, dtype.split("(")[0].split(" ")[0])


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    frame = query(spark, sf_dir)
    got = frame.toPandas()
    if sql is None:
        return f"rows-only {len(got)}"
    want = con.execute(sql).df()
    kinds = {k: v for k, v in zip([c[0] for c in con.execute(sql).description], [str(c[1]) for c in con.execute(sql).description])}
    odd = [
        f"{c} {s} vs {kinds.get(c)}" for c, s in frame.dtypes if c in kinds and kind(s) != kind(kinds[c].lower())
    ]
    if odd:
        return f"TYPES {odd}"
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return f"ok {len(a)}"
    left, right = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
    return f"DIFF spark={len(a)} sql={len(b)}\n   spark-only {left[:3]}\n   sql-only   {right[:3]}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from codelineage.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            result = compare(spark, con, sf_dir, name, queries[name], oracle.get(name))
        except Exception as error:  # report and go on
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:24s} {time.time() - start:6.1f}s {result}", flush=True)
