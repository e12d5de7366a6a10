import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, cluster string, _id string, key string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties, and extra columns whose names the operators use themselves."""
    base = " ".join(f"word{i} of a plain text that goes on" for i in range(30))
    shared = "This very line stands in many documents of the set."
    rows = [
        (1, f"{base}\n{shared}", "en", "a"),
        (2, f"{base}\n{shared}\nend", "en", "a"),
        (3, shared + "\n" + "x y z " * 40, None, "a"),
        (4, "", "en", None),
        (5, None, "en", "b"),
        (None, f"{base}\n{shared}", "de", "b"),
        (None, None, None, None),
        (6, "short", "en", "b"),
        (7, base, "en", "a"),
        (7, base, "en", "a"),
        (8, "überall stehen Wörter, 你好 世界 \U0001f600 " * 3, "de", "b"),
        (9, "long " + " ".join(f"w{i % 977}x{i}" for i in range(20000)), "en", "c"),
        (10, "\n \n\t\n", "en", "c"),
    ]
    return spark.createDataFrame([(*r, None, "kept", "kept", "kept", "kept") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
