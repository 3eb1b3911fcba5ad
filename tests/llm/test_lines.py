from pyspark.sql import functions as F

from keyrill.llm import lines
from tests.oracle import SF, rows_of

LINE = "a line that every site prints somewhere"


def docs(spark):
    rows = [(i, f"own {i}\n  {LINE} \nshort\n\nend", f"s{i % 4}") for i in range(12)] + [(50, None, "s1"), (51, "", None), (52, LINE, None), (0, LINE, "s9")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("hash", F.lit("clash"))


def test_both_ways_agree(spark):
    for sf in (None, SF):
        df = docs(spark) if sf is None else spark.read.parquet(f"{sf}/documents.parquet")
        how = {"min_sites": 4 if sf is None else 8}
        a, b = lines.remove_lines(df, **how), lines.remove_lines(df, broadcast_lines=0, **how)
        assert a.columns == b.columns and rows_of(a) == rows_of(b)


def test_cases(spark):
    rows = lines.remove_lines(docs(spark), min_sites=4).collect()
    assert {(r.doc_id, r.text, r.n_removed) for r in rows if r.doc_id in (0, 1, 50, 51, 52)} == {
        (0, f"own 0\n  {LINE} \nshort\n\nend", 0), (0, LINE, 0), (1, "own 1\nshort\n\nend", 1), (50, None, 0), (51, "", 0), (52, "", 1),
    }
    rows = lines.remove_lines(docs(spark), min_sites=6).collect()
    assert all(r.n_removed == 0 for r in rows)
    assert lines.remove_lines(docs(spark).limit(0)).count() == 0
    assert "hash" in rows[0].__fields__
