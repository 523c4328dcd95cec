"""The registered corpus queries: SQL where there is some, else that they run and return their contract's columns."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
import checkall
from millrace.llm.queries import QUERIES, SQL

COLUMNS = {
    "op1_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op2_language_id": "doc_id held_out lang_pred score",
    "op3_curve_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op5_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op7_jaccard_join": "doc_id n_shingles component_id",
    "op8_entropy_mixing": "doc_id size source_size target taken",
    "op9_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op10_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op11_bottom_k": "doc_id n_shingles component_id kept",
    "op12_conversation_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op13_spelling_variants": "word form root n n_near form_n",
}


def test_all_are_registered():
    assert set(COLUMNS) == set(QUERIES) and {*QUERIES, "pipeline"} <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, sf_dir, name):
    assert checkall.compare(spark, duck, sf_dir, name) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_columns(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).columns[:len(COLUMNS[name].split())] == COLUMNS[name].split()
