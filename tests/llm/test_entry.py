"""Every query of the subpackage runs on the smallest tables with the columns that are asked for."""

import pytest

from docmill.llm import entry
from tests import oracle

SF = f"{oracle.DATA}/sf0.001"
COLUMNS = {
    "p1_found": ["text_id", "line_no", "noise"], "p2_found": ["text_id", "kind"], "p3_found": ["id", "field", "label"], "p4_found": ["text_id", "level"],
    "p5_found": ["tab", "first_id", "dup_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "lang"],
}


@pytest.mark.parametrize("name", entry.QUERIES)
def test_query(spark, name):
    df = entry.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS.get(name, df.columns)
    if name in entry.SQL:
        oracle.same(df, oracle.connect(SF), entry.SQL[name])
    elif name in COLUMNS:
        rows = df.drop("ids").collect()
        assert rows and len(rows) == len(set(rows))
    else:
        assert df.count() > 0
