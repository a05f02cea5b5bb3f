"""Near copies just at the threshold, and rows that share an id."""

import duckdb

from parchmint.llm import minhash


def test_near_duplicates_at_the_threshold(spark):
    """200 pairs of Jaccard 40 / 50, just the threshold: each one is found."""
    rows = []
    for g in range(200):
        words = [f"g{g}w{i}" for i in range(49)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join([*words[:24], "new", *words[25:]]))]
    got = dict(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {i: i - i % 2 for i in range(400)}


def test_near_duplicates_of_one_id_and_two_texts(spark):
    """Rows of one doc_id are one document, linked by either text; each row has its result once, null ids none."""
    a, b = (" ".join(f"{c}{i}" for i in range(200)) for c in "ab")
    rows = [(5, a), (5, b), (7, b + " end"), (3, a + " end"), (9, "x y z"), (9, None), (None, a), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r[0]), r[1]) for r in got if r[0] is not None) == [("3", 3), ("5", 3), ("5", 3), ("7", 3), ("9", 9), ("9", 9)]
    assert [r[1] for r in got if r[0] is None] == [None, None]


def test_near_copies_sql(spark):
    """The join of bands finds what every pair of sets, compared exactly, has."""
    where = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{where}/documents.parquet'")
    want = con.execute(minhash.ORACLE_NEAR_COPIES).fetchall()
    got = minhash.near_copies(spark, where).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(d != c for d, c in want)
