import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """documents([(doc_id, text), ...]) with the columns of the table and some whose names operators use inside."""

    def make(rows, source=None, lang=None):
        from pyspark.sql import functions as F

        full = [(i, t, lang(i) if lang else "en", source(i) if source else "s", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in ("_text", "_key", "_digest", "score", "key", "kept", "_dropped", "_rank", "ids", "id", "part", "first"):
            df = df.withColumn(name, F.lit("clash"))
        return df

    return make


#: Null, empty, blank, long, repeated and tied texts; doc_ids null and repeated.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "a b"), (6, "a b c d e f g h i j"), (7, "word " * 60_000), (7, "a b"),
    (8, "A  B\nC"), (9, "a b\u00a0c \u0301x \ue000\x01 y \u00df\u0130"), (10, "a b c d e f g h i j"), (None, "a b c d e f g h i j"), (None, None),
    (11, "caf\u00e9 \u4f60\u597d 123 don't !!! \U0001f600"),
]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
