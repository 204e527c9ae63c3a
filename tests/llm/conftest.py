from __future__ import annotations

import glob
import os

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"

#: Columns whose names operators use themselves.
EXTRA = {"size": 1, "ids": "x", "k1": 2, "line": 3, "gone": False, "token": "t", "toxic_score": 0.5, "_row": 4, "h": 5, "id": 6, "doc": 7, "th": 8, "_gone": 9, "_cut": 10, "cut": 11, "text_": "y"}


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null id, null, empty and blank texts, a very long text, repeated rows, clashing columns."""
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(60_000))
    rows = [(None, "no id here but some words to read"), (1, None), (2, ""), (3, "  \n \t"), (4, long), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (6, "a b c d e f g h"), (7, "日本語のテキスト 😀\n\n"), (8, "x")]
    names = ["doc_id", "text", *EXTRA]
    return spark.createDataFrame([(*r, *EXTRA.values()) for r in rows], "doc_id long, text string, size int, ids string, k1 int, line int, gone boolean, token string, toxic_score double, _row int, h int, id int, doc int, th int, _gone int, _cut int, cut int, text_ string").select(*names)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("false")


def duck(sql: str, **tables):
    """Rows of the SQL over the small tables, as sorted tuples by column name; tables: pandas or Arrow tables that stand in."""
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    for name, t in tables.items():
        con.register(name, t)
    got = con.sql(sql)
    cols = sorted(got.columns)
    return sorted((tuple(plain(r[got.columns.index(c)]) for c in cols) for r in got.fetchall()), key=repr)


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
