import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_every_value_of_a_row_is_stretched(spark):
    rows = entry.queries()["contrast_stretch_image"](spark, SF).collect()
    assert rows and all(len(r.stretched.split(",")) == 64 for r in rows)
