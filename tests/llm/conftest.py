import pytest


@pytest.fixture
def documents(spark):
    """Documents from ``(doc_id, text)``; source and language alternate, ``n_chars`` clashes."""

    def make(rows, **extra):
        shape = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(i, t, "en", f"src{n % 3}" if n % 5 else None, 0) for n, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(full, shape)
        for name in ("shard", "slot", "rate", "h1", "words", "pos", "score", "size", "_salt", "node"):
            df = df.withColumn(name, df["n_chars"])
        return df

    return make
