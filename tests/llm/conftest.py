import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark):
    """Frames of (doc_id, text) with extra columns whose names clash with the operators' own."""

    def build(*rows):
        frame = spark.createDataFrame(list(rows), "doc_id long, text string")
        clash = ["fingerprint", "component_id", "score", "shard", "size", "row", "tokens", "words", "features", "spans", "key", "fp"]
        return frame.withColumns({c: F.lit("x") for c in clash} | {"lang": F.lit("en"), "source": F.lit("s")})

    return build
