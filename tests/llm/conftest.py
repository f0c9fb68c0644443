"""Small tables of awkward rows."""

import pytest
from awkward_rows import AWKWARD, CLASHING


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward documents with columns named like inner ones."""
    rows = [(i, t, "en", "src", 0, *["x"] * len(CLASHING.split(", "))) for i, t in AWKWARD]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
