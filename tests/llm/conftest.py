import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, kept string, key string, value string"
LINE = "This very line is found in several of the documents."
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
BODY = " ".join(f"plain{i} text{i * 7 % 31}" for i in range(60)) + "."

#: Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names.
ROWS = [
    (1, f"{LINE}\n{BODY}", "en", "a"),
    (2, f"{LINE}\n{BODY}", "en", "b"),
    (3, f"  {LINE.upper()}\t\nother text of its own, long enough to count as a line", "en", None),
    (4, None, None, None),
    (5, "", "en", "a"),
    (5, "", "en", "a"),
    (6, " \n\t\n", "en", "é"),
    (7, LONG, "en", "a"),
    (8, LONG + " end", "en", "b"),
    (9, "one two three", "en", "c"),
    (10, "ONE two\nthree", "en", "c"),
    (11, "one two three", "en", "c"),
    (12, "émile 日本語 😀 " * 40, "fr", "c"),
    (None, f"{BODY}\nnothing", "en", "a"),
    (13, BODY + " <|endoftext|> a b  c\0d", "en", ""),
    (14, BODY.replace("plain30 ", "changed30 "), "en", ""),
    (15, "x" * 5000, "en", "a"),
    (16, "ab" * 700 + "\n" + LINE, "en", "a"),
]


@pytest.fixture(scope="module")
def rows():
    return [dict(zip(("doc_id", "text", "lang", "source"), r)) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    made = [(*r, len(r[1] or ""), "x", None, "y", "z") for r in ROWS]
    return spark.createDataFrame(made, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
