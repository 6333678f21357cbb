import os

import pytest

from ambarina.plans import training
from ambarina.plans.queries import QUERIES

from folders import SMALL, odd

pytestmark = pytest.mark.skipif(not os.path.exists(SMALL), reason="no tables")


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_every_query_runs(spark, tmp_path_factory, kind):
    d = odd(spark, tmp_path_factory.mktemp(kind), kind)
    for name, q in (QUERIES | training.QUERIES).items():
        n = q(spark, d).count()
        if kind == "empty" and not name.startswith(("summary_totals", "summary_document", "size_totals", "case_status_rollup", "run_rollup", "semantic_tags")):
            assert n == 0, name
