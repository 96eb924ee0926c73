"""Every query of the subpackage over the smallest tables: SQL where there is some, and the columns asked for."""

from pathlib import Path

import duckdb
import pytest
from millrace.llm.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the harness tables aren't here")
COLUMNS = {
    "op1_pii": "doc_id bigint, text string, n_found bigint",
    "op2_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op3_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op4_piece_tokens": "doc_id bigint, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string",
    "op5_chat_format": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op6_quality": "doc_id bigint, p_at_least array<double>, expected_grade double, kept boolean",
    "op7_mpeg_audio": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
    "media_sha256 string, feature string",
    "op9_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    mine = QUERIES[name](spark, DATA)
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in mine.dtypes) == COLUMNS[name]
    rows = mine.collect()
    con = duckdb.connect()
    n_docs = con.execute(f"SELECT count(*) FROM '{DATA}/documents.parquet'").fetchone()[0]
    if name not in ("pipeline", "op5_chat_format", "op10_packing"):
        assert len(rows) == n_docs
    assert rows
    if name in ORACLE_SQL:
        for f in Path(DATA).glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        theirs = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in theirs.description]
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(theirs.fetchall())
