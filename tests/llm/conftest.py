import pytest


def make_docs(spark, rows, extra=False):
    """documents with (doc_id, text[, source]); extra adds columns whose names clash with inner ones."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        for name in ("stats", "findings", "w_", "key_", "d", "t", "h", "set_key", "size", "contamination", "hash_", "order_", "blob"):
            df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture
def docs(spark):
    return lambda rows, extra=False: make_docs(spark, rows, extra)
