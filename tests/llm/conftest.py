import pytest
from pyspark.sql import functions as F


@pytest.fixture
def wide(spark):
    """Adds columns whose names clash with those the operators use inside."""

    def add(df):
        return df.withColumns({c: F.lit("clash") for c in ("n", "text_", "band", "rep", "_id", "stats", "words", "rank", "score", "run", "forms", "site", "doc", "h1", "shard", "v2", "block", "piece_no", "line", "at") if c not in df.columns})

    return add
