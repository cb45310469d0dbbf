"""Documents read back by their lines give the rows of the SQL on odd texts too; stored chunks are joined in order."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from weftlight.plans import catalogue
from weftlight.sources import sinks

ROWS = [
    (1, "a\n\n b \n"),
    (2, None),
    (3, ""),
    (4, " \t\r\f\n\n"),
    (5, "a\n\x0b\nb"),  # a blank line to Java, not to SQL
    (6, "a\n \n \n\x1c\n\x85\nb\r\n\r\n"),
    (7, "one\ntwo"),  # rows of one id, also equal ones, are not merged
    (7, "three"),
    (8, "same\ntext"),
    (8, "same\ntext"),
    (None, "no id"),
]


def test_odd_texts(spark, tmp_path):
    file = f"{tmp_path}/documents.parquet"
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in ROWS], pa.int64()), "text": [r[1] for r in ROWS]}), file)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{file}'")
    want = con.execute(catalogue.ORACLE_SQL["document_read_back"]).fetchall()
    got = catalogue.QUERIES["document_read_back"](spark, str(tmp_path)).select("doc_id", "text").collect()
    assert len(want) == len(ROWS)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_stored_chunks_come_in_order(spark):
    chunks = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (2, 0, "d"), (1, 1, "b")], "doc_id long, ordinal int, text string")
    assert sorted(map(tuple, sinks.read_back(chunks).collect())) == [(1, "a\n\nb\n\nc"), (2, "d")]
