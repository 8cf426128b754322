from lodeweave.plans import registry

from .conftest import DATA


def test_pairs_are_found_once(spark):
    """What reads the near pairs several times reads them written."""
    plan = registry.QUERIES["adjudicated_pairs"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
