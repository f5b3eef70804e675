"""Spark rows against DuckDB rows, as unordered values."""

import os

import duckdb


def tables(sf):
    db = duckdb.connect()
    for name in os.listdir(sf):
        path = f"{sf}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf}/{name}") else "")
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return db


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return None if value != value else value
    return value


def rows(frame):
    columns = sorted(frame.columns)
    frame = frame[columns].astype(object)
    return sorted((tuple(None if plain(v) is None or str(v) in ("<NA>", "nan", "None", "NaT") else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(plain(v)) for v in row) for row in frame.itertuples(index=False)), key=repr)


def same(df, sql, sf):
    got, want = df.toPandas(), tables(sf).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
