"""Every query of the core against its SQL."""

import pytest

from docmill.plans.catalogue import QUERIES, SQL
from tests import oracle

SF = f"{oracle.DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    oracle.same(QUERIES[name](spark, SF), con, SQL[name])


def test_production_caps_are_registered():
    assert {"page_concat_full", "text_truncate_full", "extract_analyse"} <= set(QUERIES) & set(SQL)
