import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, chunk string, held_out string, keys string"

ODD = [
    (7, None), (8, ""), (9, " \n\t "), (10, "word"), (10, "word"), (11, "été ½ 日本 🙂 <|endoftext|> it's"),
    (12, "abc " * 30000), (None, "no id here but some words to read"), (13, "x" * 5000),
]


@pytest.fixture(scope="module")
def docs_of(spark):
    """Documents with further columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), 0.5, "c", "h", "k") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
