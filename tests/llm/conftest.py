import pytest

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text) rows, with columns whose names the operators use themselves."""

    def make(rows, parts=3):
        clash = "doc_id BIGINT, text STRING, score DOUBLE, selected BOOLEAN, removed_lines INT, lang STRING, n INT"
        return spark.createDataFrame([(i, t, 0.5, True, 9, "en", 1) for i, t in rows], clash).repartition(parts)

    return make


#: Null, empty and blank texts, ties, repeated rows, null ids and a long text.
AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t"),
    (4, "plain words of one small text\nand a second line"),
    (5, "plain words of one small text\nand a second line"),
    (5, "plain words of one small text\nand a second line"),
    (None, "a text without an id"),
    (7, "It's <|endoftext|> 12 ½ 日本語 é É \U0001f600"),
    (8, "long " * 60_000 + "end"),
    (9, "x" * 300_000),
]
