"""Registered queries against their SQL, on the smallest tables and on awkward rows."""

import pytest

from sightline.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = {"op2_jaccard_join": "documents", "op2_jaccard_links": "documents", "op7_warc_normaliser": "pages", "op8_norm_bucket_topk": "embeddings", "op9_line_dedup": "documents", "op11_summa_negatives": "embeddings", "op12_prefix_trie": "conversations"}


def agree(spark, name, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW {TABLES[name]} AS SELECT * FROM read_parquet('{sf}/{TABLES[name]}.parquet{'/*.parquet' if sf != SF else ''}')")
    df = queries.QUERIES[name](spark, str(sf))
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert got and sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_smallest(spark, name):
    agree(spark, name, SF)


def test_awkward_documents(spark, tmp_path):
    texts = [None, "", " \n\t", "One line that Repeats\nb", "b\n one line that repeats \x0b", "b\n\nÉcole ÉCOLE und so\nb", "ÉCOLE école und so", "a b", "a b", "a b c", "A B C a b c"]
    texts += [" ".join(f"w{i}" for i in range(k, k + 80)) for k in (0, 2, 4, 40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op2_jaccard_join", "op2_jaccard_links", "op9_line_dedup"):
        agree(spark, name, tmp_path)


def test_awkward_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.5]), (100, [1.0, -0.5]), (200, None), (300, [nan, 1.0]), (400, [inf, 1.0]), (500, [None, 1.0]), (600, [0.0, 0.0])] + [(i, [0.3, 0.1]) for i in range(1, 25)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    agree(spark, "op8_norm_bucket_topk", tmp_path)


def test_awkward_pages(spark, tmp_path):
    rows = [(1, "http://a", None), (2, None, ""), (9, "http://b", "x" * 100), (4, "http://c", "x" * 100), (5, "http://d", "x" * 99), (6, "http://e", "x" * 99), (7, "http://f", "é" * 50), (8, "http://f", "é" * 50)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    agree(spark, "op7_warc_normaliser", tmp_path)
