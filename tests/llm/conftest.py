import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Columns whose names clash with those the operators use inside.
CLASHES = ("id", "n", "token", "rid", "pos", "line", "h1", "key", "block", "component", "digest", "score", "kept", "a", "b", "d1")


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, clash=True):
        full = [(i, t, *(rest + (None,) * (2 - len(rest))), None if t is None else len(t)) for i, t, *rest in (tuple(r) for r in rows) for rest in [tuple(rest)]]
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
        return df

    return make


@pytest.fixture(scope="session")
def vocab():
    from lynceus.llm.settings import vocabulary

    return vocabulary
