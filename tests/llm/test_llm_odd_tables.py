import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ambarina.llm.queries import QUERIES  # noqa: E402
from folders import SMALL, odd  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="no tables")


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_every_query_runs(spark, tmp_path_factory, kind):
    d = odd(spark, tmp_path_factory.mktemp(kind), kind)
    for name, q in QUERIES.items():
        n = q(spark, d).count()
        if kind == "empty":
            assert n == 0, name
