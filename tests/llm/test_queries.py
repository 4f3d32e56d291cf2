"""The registered queries over whole small tables: DuckDB's rows where SQL states them, else the columns asked for."""

import duckdb
import pytest

from quillon.llm.queries import ORACLES, QUERIES

from ..test_catalog import BASE, TABLES, canonical

COLUMNS = {
    "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op2_vectors": "vec_id n_links component_id kept",
    "op3_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4_suffix": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op6_minhash": "doc_id n_shingles component_id kept",
    "op7_langid": "doc_id held_out lang_pred score",
    "op8_fingerprint": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op9_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_toxicity": "doc_id held_out score predicted",
    "op11_hosts": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op12_divergence": "lang source part item value rank",
    "op13_dialogue": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, BASE)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
        cur = con.execute(ORACLES[name])
        assert got == canonical([c[0] for c in cur.description], cur.fetchall())
