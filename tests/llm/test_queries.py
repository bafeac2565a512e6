"""The registered queries of the subpackage: SQL where there is one, contracts on the smallest tables."""

import os
import zlib

import duckdb
import pytest

from tallyvine.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, found = queries.QUERIES[name](spark, DATA), con.sql(queries.SQL[name])
    names = sorted(df.columns)
    assert sorted(found.columns) == names
    at = [found.columns.index(c) for c in names]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, (tuple(r[k] for k in at) for r in found.fetchall())))


@pytest.mark.parametrize("name", ["op3_language", "op7_toxicity"])
def test_held_out_rows_and_accuracy(spark, name):
    rows = queries.QUERIES[name](spark, DATA).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    parts, rest = {"op3_language": (5, 0), "op7_toxicity": (3, 1)}[name]
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    if name == "op3_language":
        assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    else:
        toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
        clean = [r for r in held if toxic.get(r.doc_id) == 0]
        assert sum(r.predicted for r in clean) <= 0.15 * len(clean)


def test_empty_tables(spark, tmp_path):
    """Every query over tables without rows gives no rows."""
    for name in ("documents", "labels", "pages"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and clashing columns give a row for each row."""
    long = " ".join(f"word{i % 977}" for i in range(200_000))  # 1.5 million characters
    texts = [(1, "A plain text about nothing much at all.", "en"), (1, "A plain text about nothing much at all.", "en"), (2, None, None), (3, "", "de"), (4, long, "en"), (5, "x" * 120_000, "fr"), (None, "no id here", "en"), (6, "password = hunter2hunter2", None), (None, None, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, score string, spans int, media string, _range int, node int"
    spark.createDataFrame([(i, t, lang, None, None, "s", 1, "m", 1, 1) for i, t, lang in texts], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, None, 1), (None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, None, t, "x") for i, t, _ in texts], "page_id long, url string, html string, refers_to string").write.parquet(f"{tmp_path}/pages.parquet")
    for name, query in queries.QUERIES.items():
        rows = query(spark, str(tmp_path)).collect()
        key = "page_id" if name == "op8_warc" else "doc_id"
        assert sorted((r[key] for r in rows), key=str) == sorted((i for i, _, _ in texts), key=str), name
