import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs_of(spark):
    """DataFrame with the columns of documents from (doc_id, text[, lang]) rows;
    extra columns with names that operators use inside may be added."""
    def make(rows, *extra):
        from pyspark.sql import functions as F
        df = spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None) for r in rows], DOCS)
        return df.withColumns({c: F.lit("clash") for c in extra}) if extra else df
    return make
