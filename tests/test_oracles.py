import pytest

from clausemill import registry
from oracle import compare

#: Share their operators with g5 or d11 and take as long.
SLOW = {"g1_question_scores", "g6_compare_configs", "d10_rerank", "d12_refusal_gate", "d13_refusals_by_clause", "ask"}


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - SLOW))
def test_oracle(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name])


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
