"""Letter runs longer than a word's bound."""

from pitspark.llm import language_id
from test_operators import DOCS, small_field


def test_language_of_a_long_run_counts_every_letter(spark):
    _, field = small_field()
    tail = "schungßen" * 71
    docs = spark.createDataFrame([(1, "thaingwer" * 7 + "t" + tail), (2, "tha" * 400)], DOCS)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, field).collect()}
    assert got == {1: "cc", 2: "aa"}
    for n in (1, 63, 64, 65, 128, 129):
        words = language_id.words_of("é" * n + " b")
        assert "".join(words[:-1]) == "é" * n and max(map(len, words)) <= 64 and words[-1] == "b"
