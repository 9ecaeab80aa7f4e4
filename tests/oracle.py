"""Compare a query with its SQL on DuckDB: same columns, same rows in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def rows_of(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(spark, run, sql, sf_dir):
    """'' if both agree, else what differs."""
    frame = run(spark, sf_dir)
    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
        result = db.sql(sql)
        names, want = result.columns, result.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    a, b = rows_of(frame.columns, [tuple(r) for r in frame.collect()]), rows_of(names, want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"{sorted(names)}: {x} and {y}"
    return ""
