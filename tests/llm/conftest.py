import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, pii string, size int, row int, text_ string, bucket int, fingerprint string, component_id string, kept string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns named like outputs."""
    words = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    near = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", " \t\n", "one", "one two three", near, near, near.replace("word7 ", "other "), words, "ÄÖ 你好世界 🙂 é", "!!! ???", "a\n\na\n\n", "x" * 5000, "12345 67890"]
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}", None, None, "p", 1, 2, "t", 3, "f", "c", "k") for i, t in enumerate(texts)]
    rows.append(rows[6])  # a repeated row
    rows.append((None, near, None, None, *[None] * 10))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
