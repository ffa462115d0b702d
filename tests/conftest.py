import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reeltally.plans.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "reeltally-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def executed_plans(spark):
    """Calling it gives the physical plans of everything that Spark has executed since the test began, streams and written steps included."""
    store = spark._jsparkSession.sharedState().statusStore()

    def newest(after):
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        seen, out = store.executionsList(), {}
        for i in range(seen.size() - 1, -1, -1):
            one = seen.apply(i)
            if one.executionId() <= after:
                break
            out[one.executionId()] = one.physicalPlanDescription()
        return out

    begun = max(newest(-1), default=-1)
    return lambda: list(newest(begun).values())
