import pytest


@pytest.fixture(scope="session")
def clash():
    """Adds columns whose names the operators use inside."""

    from pyspark.sql import functions as F

    def add(df):
        for c in ("key", "path", "bucket", "tab", "__key", "__text", "cls", "band", "n", "v", "u", "component", "shard", "salted", "way", "star", "container", "piece", "__rn"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit("x"))
        return df

    return add
