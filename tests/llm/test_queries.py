"""Queries with SQL side by side with DuckDB, on given and on awkward tables; all queries on awkward and empty ones."""

import pytest
from side_by_side import compare, duck

from txrisk.llm.queries import oracle_sql, queries

COLUMNS = {
    "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2": "doc_id n_lines n_dropped kept_sha256",
    "op3": "page_id url text n_chars",
    "op4": "doc_id n_tokens log_probability mean_log_probability",
    "op5": "doc_id held_out score predicted",
    "op6": "page_id payload_bytes payload_digest record_type refers_to",
    "op7": "doc_id n_shingles component_id kept",
    "op8": "doc_id held_out lang_pred score",
    "op9": "doc_id piece start length ids_crc32 sequence_id offset",
    "op10": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op11": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op12": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op13": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    assert compare(spark, duck(sf), queries()[name], oracle_sql()[name], sf) == ""


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql_on_awkward_tables(spark, awkward, name):
    con = duck(awkward, "documents pages benchmark labels".split())
    assert compare(spark, con, queries()[name], oracle_sql()[name], awkward) == ""


@pytest.mark.parametrize("name", sorted(queries()))
def test_columns_and_rows(spark, awkward, empty, name):
    got = queries()[name](spark, awkward)
    assert got.columns == COLUMNS[name.split("_")[0]].split()
    rows = got.filter("piece = 0") if "piece" in got.columns else got
    of_pages, of_parts = name.startswith(("op3", "op6")), name.startswith("op11")
    assert rows.count() == (9 if of_pages else 2 * 600 if of_parts else 22)
    assert queries()[name](spark, empty).count() == 0
