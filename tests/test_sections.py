"""Sections of texts with odd letters and line ends, against their SQL in DuckDB."""

import duckdb
import pytest

from scholium import plans as catalogue

TEXTS = [
    "3 Größe und Maß\nText\n4 GRÖẞE UND MAẞ\nText",
    "12 ﬁgures of ŉ and ᾳ\nText\nGRÖẞE ÜBER\nText\nŉ ABC ﬁ\nText\nÜBER GRÖßE\nText",
    "5 İstanbul and ΑΣ\nText\nİZMİR ΑΣ ΟΔΟΣ\nText",
    "6 Data \nText\n \n7 One\rtwo\nText\nDATA \nText\nData  \nResults\x0b\n\x0b8 Nine\nMethod\x85",
    "9 Straße\nText\n9 STRASSE\nText\n9 straße\r\nText",
    "",
    None,
]


@pytest.mark.parametrize("name", ["section_bodies", "sections_by_line"])
def test_sections_of_odd_texts_equal_their_sql(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()) == want
