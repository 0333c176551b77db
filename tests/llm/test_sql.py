"""The training-data queries with SQL give DuckDB's rows."""

import os

import duckdb
import pytest

from placelark.llm.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
#: Nulls, no words, words that differ only in case or white space, copies, repeated windows and lines, letters beyond ASCII, capitals, symbols.
LONG = " ".join(f"w{i}" for i in range(60))
ODD = [
    (1, None, "a"),
    (2, "", None),
    (3, " \t\x0b \n\n", "b"),
    (4, LONG, "a"),
    (5, LONG.upper().replace(" ", "\t "), "a"),
    (6, LONG.replace("w59", "zz"), "a"),
    (7, LONG + "\n" + LONG, "b"),
    (8, "é ÉCOLE 千代田区 " * 30, "b"),
    (9, "SHOUTED WORDS " * 4 + LONG.upper().replace("W", "LOUD"), "b"),
    (10, "a # b $ c % d & " * 20, None),
    (11, "\n".join(["one same line of words"] * 9 + [LONG]), "c"),
    (12, "w1 w2 w3", "c"),
    (13, "W1 w2  w3", "c"),
    (14, " ".join(["no", "break"] * 30) + " " + "x" * 500, "c"),
]


@pytest.fixture(scope="module", params=["tables", "odd"])
def tables(request, spark, tmp_path_factory):
    if request.param == "tables":
        return DIR
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(ODD, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, tables, name):
    con = duckdb.connect()
    path = f"{tables}/documents.parquet"
    con.execute(f"create view documents as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want = con.sql(SQL[name])
    cols = sorted(want.columns)
    df = QUERIES[name](spark, tables)
    assert sorted(df.columns) == cols
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, want.select(*cols).fetchall()))
