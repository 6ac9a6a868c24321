"""The registered queries with SQL against DuckDB, the others for their columns."""

import pytest
from conftest import SF
from oracle_check import connect, difference

from dockpulse.llm.queries import QUERIES, SQL

COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_digests": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op6_suffix_sort": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op7_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op8_html_text": ["page_id", "url", "text", "n_chars"],
    "op10_simhash": ["doc_id", "fingerprint", "component_id"],
}


@pytest.mark.parametrize("name", SQL)
def test_query_equals_its_sql(spark, name):
    problem = difference(QUERIES[name](spark, SF).toPandas(), connect(SF).execute(SQL[name]).df())
    assert problem is None, problem


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    found = QUERIES[name](spark, SF)
    assert found.columns == COLUMNS[name]
    assert found.count() >= (50 if name == "op8_html_text" else 200)


def test_all_queries_are_known():
    assert QUERIES.keys() == COLUMNS.keys() | SQL.keys()
