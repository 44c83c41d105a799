"""The training-data queries that have SQL, against DuckDB on the smallest tables; and all the others' columns."""

import duckdb
import pytest

from quern.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"

#: The columns that each query returns.
COLUMNS = {
    "op1": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3": "doc_id n_shingles component_id kept",
    "op4": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op5": "page_id payload_bytes payload_digest record_type refers_to",
    "op6": "page_id host path rule verdict",
    "op7": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op8": "doc_id size source_size target taken",
    "op9": "doc_id held_out lang_pred score",
    "op10": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = db.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(str(tuple(r)) for r in got.select(*want.columns).collect()) == sorted(map(str, want.fetchall()))


def test_columns(spark):
    assert len(QUERIES) == 10
    for name, query in QUERIES.items():
        if (n := name.split("_")[0]) in COLUMNS and name not in ORACLE_SQL:
            out = query(spark, FOLDER)
            assert out.columns == COLUMNS[n].split(), name
            assert out.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
