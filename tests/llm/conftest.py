import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may have them too.
CLASHES = ["size", "h", "key", "score", "found", "node", "pii", "copies", "predicted", "held_out", "bands", "block", "data", "kept", "label", "y", "t", "n", "n_tokens", "_own", "_t", "_id", "h1", "id", "lang_pred", "row", "clean", "new", "low"]

WORDS = "the quick brown fox jumps over a lazy dog while seven bright birds sing near old river stones under pale morning light".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, empty, long, equal and repeated texts, and columns with clashing names."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 120), "en", "a", 1), (2, prose(2, 120), "en", "a", 1), (3, None, "en", "b", None), (4, "", None, None, 0), (5, " \n\t ", "fr", "b", 3), (None, prose(3, 90), "en", "a", 2),
        (None, None, None, None, None), (6, long, "en", "c", 9), (7, long, None, "c", 9), (8, "the", "en", "a", 3), (8, "the", "en", "a", 3), (9, "été à la forêt ñ ß 日本語 🙂", "fr", None, 5),
        (10, prose(4, 300), "de", "a", 1), (11, prose(4, 300) + " tail", "de", "a", 1), (12, "a@b.co +1 (555) 123-4567 4111 1111 1111 1111 10.0.0.1", "en", "b", 7), (13, "\x00\x01 control \x7f", "en", "b", 2),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for i, c in enumerate(CLASHES):
        df = df.withColumn(c, F.lit(i))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
