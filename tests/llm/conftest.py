import pytest


@pytest.fixture
def texts_table(spark):
    """``make(rows)`` gives documents of (doc_id, text), with further columns whose names clash with operators' own."""

    def make(rows):
        full = [(i, t, "en", "src0", None if t is None else len(t), "x", "y") for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, ids string")

    return make


#: Nulls, empty and blank texts, ties, repeated rows, odd spaces, letters and signs.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "no id"), (5, "don't WE'RE he'd'sfoo ''s 's"), (6, "x" * 3000), (7, "ab" * 900 + "c"),
    (8, "Ünïcode 中文字 ½ ² 12345 … 🙂🙂  　 tail  \n\n"), (9, "<|endoftext|>a<|endoftext|><|startoftext|> b"), (10, "word " * 700), (11, "\x1c\x85a\x1fb c"),
]
