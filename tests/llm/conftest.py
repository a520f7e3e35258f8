import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or (id, text) pairs, with the columns of the table and extra ones that clash."""

    def make(texts, extra=()):
        rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], DOC)
        for c in extra:
            df = df.withColumn(c, F.lit("clash"))
        return df

    return make
