"""Every registered query of the library against its DuckDB SQL."""

import pytest
from compare import duck, spark_rows

from specloom.plans import bridge

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(bridge.QUERIES))
def test_same_rows(spark, name):
    assert spark_rows(bridge.QUERIES[name](spark, SF)) == duck(bridge.ORACLE_SQL[name], SF)
