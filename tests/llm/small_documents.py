"""A fixture the operator tests import (a second conftest would hide the one above)."""

import pytest


@pytest.fixture(scope="module")
def documents(spark):
    """The smallest documents table as plain rows."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
