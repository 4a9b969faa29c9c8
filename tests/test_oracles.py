"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from quillmine.checks import all_checked
from quillmine.checks.compare import compare

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
@pytest.mark.parametrize("name", list(all_checked()))
def test_query(spark, name):
    item = all_checked()[name]
    df = item.build(spark, FOLDER)
    if item.oracle is None:
        assert df.count() > 0
    else:
        assert compare(df, item.oracle, FOLDER) == ""


@pytest.mark.skipif(not os.path.isdir(FOLDER.replace("0.001", "0.01")), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["cand_route", "title_join"])
def test_query_on_more_rows(spark, name):
    """Ties and near ties of scores only show on more rows."""
    folder = FOLDER.replace("0.001", "0.01")
    assert compare(all_checked()[name].build(spark, folder), all_checked()[name].oracle, folder) == ""
