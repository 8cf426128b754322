import pytest

from lodeweave.plans import registry

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_its_sql(name, against_sql):
    against_sql(registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["agentic_answer", "arm_typed_graph_chunks", "chunk_pack_greedy", "hash_embed"])
def test_query_without_sql_runs(name, spark):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry_points_import():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
