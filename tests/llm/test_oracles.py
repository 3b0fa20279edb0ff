"""The problems' queries that SQL can express, against DuckDB; the others are run to their last row."""

from __future__ import annotations

import pytest

from kumikata.llm import queries
from tests.oracle import same

COLUMNS = {
    "p1_found": ["first_id", "opp_id", "year_id", "method_id"], "p2_found": ["key_a", "key_b"], "p3_found": ["node_id", "node_key"], "p4_found": ["match_id", "first_idx", "last_idx"], "p5_found": ["athlete_id"],
    "p6_found": ["name_a", "name_b"], "p7_found": ["step1", "step2", "step3"], "p10_found": ["doc_id_a", "doc_id_b"],
}
#: What no two rows share, of the queries without SQL.
KEYS = {
    "p1_survivors": ["group"], "p1_records": ["first_id"], "p4_runs": ["match_id", "first_idx"], "p5_ranking": ["rank"], "p6_persons": ["name"], "p7_patterns": ["step1", "step2", "step3"], "p8_containers": ["doc_id", "piece"],
    "p8_unused": ["containers"], "p9_chosen": ["doc_id"], "p9_shares": ["source"], "p9_marginals": ["marginal", "value"], "p10_forms": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_are_those_of_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), sf, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(queries.ORACLES)))
def test_columns_and_no_row_twice(spark, sf, name):
    frame = queries.QUERIES[name](spark, sf)
    assert frame.columns == COLUMNS[name]
    rows = frame.collect()
    assert rows and len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - set(COLUMNS)))
def test_others_give_each_key_once(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf).collect()
    keys = [tuple(r[k] for k in KEYS[name]) for r in rows]
    assert rows and len(keys) == len(set(keys))
