import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Odd rows: nulls in every column, empty and long texts, ties, repeats."""
    long = " ".join(f"word{i % 977} the" for i in range(20_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", 5),
        (2, "der schnelle braune fuchs springt über den faulen hund und läuft weg", "de", "a", 5),
        (3, "the quick brown fox jumps over the lazy dog and runs away", "en", "b", 5),
        (4, None, None, None, None), (5, "", "en", None, 0), (6, " \n\t ", None, "b", 3), (7, "12 34 $$ !!", "en", "c", 3),
        (8, long, "en", "a", len(long)), (9, long + " tail", "en", "a", None), (10, long, "en", "c", 1),
        (11, "x", "en", "b", 1), (11, "x", "en", "b", 1), (None, "no identifier but some text", "en", "b", 1),
        (12, "über die brücke ging der alte mann nach hause", "de", "b", 1), (13, "über die brücke", None, "c", 1),
        (14, "emoji \U0001f642 and　wide  spaces 's 'LL​", "en", "c", 1), (15, "a" * 3000, "en", "c", 1),
    ]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def clash(documents):
    """The same rows with columns named like results and internals."""
    from pyspark.sql import functions as F
    extra = ["score", "lang_pred", "keep_id", "kept", "group_size", "text_sha256", "copies", "size", "target", "taken",
             "source_size", "n_tokens", "ids", "license", "coverage", "matches", "node", "key", "component_id"]
    return documents.select("*", *[F.lit("clash").alias(c) for c in extra])
