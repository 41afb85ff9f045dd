import duckdb
import pytest

import __spark_entry__ as entry
from tests.oracle import compare

ODD_TEXTS = (
    "", "\n", "a\n", "a\n\n", " \t ", "a \t b", "eins\r\nzwei\r", "a   b", " a ", "a\fb\f", "a\u0085b c", "\u001fa\u000b",
    "Seite 1 von 2\nangebot 5\nAngebot 7 Seite 1\nansicht von innen", "UID-Nr: 1\nIBAN: 2\nKontoinhaber: x\n---\n--- a", "Seite 1  von\t2", "pos. anzahl einzelpreis", "\u0130ban: 1", None,
)


@pytest.mark.parametrize("name", ["normal_lines", "page_furniture", "amount_triggers_in_text"])
def test_odd_texts_equal_their_sql(spark, tmp_path, name):
    rows = [(i, text) for i, text in enumerate(ODD_TEXTS)] + [(1, "zweiter Text"), (1, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    ok, message, _, _ = compare(con, spark, str(tmp_path), name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message
