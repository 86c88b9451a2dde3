"""Every query over the driver's tables against its SQL."""

import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from folioframe import catalog, engine
from folioframe.functions import text

SF = "/root/testdata/sf0.001"


def plain(x):
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else repr(round(x, 6)) if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL | engine.ORACLE_SQL))
def test_query(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = (catalog.QUERIES | engine.QUERIES)[name](spark, SF)
    got = db.execute((catalog.ORACLE_SQL | engine.ORACLE_SQL)[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    rows = df.collect()
    assert rows, "a query without rows tells nothing"
    ours = sorted(plain([r[c] for c in order]) for r in rows)
    theirs = sorted(plain([r[columns.index(c)] for c in order]) for r in got.fetchall())
    assert ours == theirs


def test_every_occurrence(spark, tmp_path):
    spark.createDataFrame([(k, 1, 7, 5, "N") for k in range(5)], "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = catalog.QUERIES["win_occurrence"](spark, str(tmp_path)).collect()
    assert sorted((r.l_orderkey, r.occurrence) for r in rows) == [(k, k + 1) for k in range(5)]


def test_truncation_of_every_text(spark, tmp_path):
    """A character of two, three or four bytes cut at any of its bytes, in any language."""
    texts = ["a" * n + c * 40 for c in ("é", "한", "\U0001f600") for n in range(115, 121)] + ["short é", "", None, "x" * 120, "é" * 60, " " * 121]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.preview for r in catalog.QUERIES["sca_truncate_bytes"](spark, str(tmp_path)).collect()}
    cut = lambda x: x if x is None or len(x.encode()) <= 120 else x.encode()[:120].decode("utf-8", "replace").strip() + "..."
    assert got == {i: cut(x) for i, x in enumerate(texts)}


def test_digest_of_lines_that_end_in_their_number(spark, tmp_path):
    """Only blanks are trimmed, not the digits of a line's place."""
    texts = ["call 555-8630", "a\n1 b 1\n 2c2 ", " 0 ", "", None, "\n1\n\t2"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text_digest, r.paragraphs) for r in catalog.QUERIES["agg_snapshot_digest"](spark, str(tmp_path)).collect()}
    lines = {i: [x.strip(" ") for x in t.split("\n")] for i, t in enumerate(texts) if t is not None}
    assert got == {i: (hashlib.sha256("\n".join(x).encode()).hexdigest(), len(x)) for i, x in lines.items()}


def test_matrix_keeps_the_digits_of_its_cells(spark):
    row = spark.createDataFrame([("10,1 , 20;0 , 11,22",)], "c string").select(text.matrix(F.col("c")).alias("m")).first()
    assert [list(r) for r in row.m] == [["10", "1", "20"], ["0", "11", "22"]]


def test_occurrences_are_of_the_text_with_its_blank(spark, tmp_path):
    """A word that only begins like the text is no occurrence of it."""
    said = [(1, 0, "user", "partion"), (1, 1, "assistant", "a Part of"), (2, 0, "user", "part one"), (2, 1, "user", "party"), (2, 2, "user", "the part "), (3, 0, "user", None), (13, 0, "user", "part-time")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    theirs = db.execute(engine.ORACLE_SQL["win_4_occurrence"]).fetchall()
    ours = engine.QUERIES["win_4_occurrence"](spark, str(tmp_path)).select("doc_id", "section_idx", "all_p_idx", "new_text").collect()
    assert theirs and sorted(map(tuple, ours)) == sorted(theirs)
