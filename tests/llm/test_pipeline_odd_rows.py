"""The pipeline's stages on nulls, empty and very long texts, repeated ids and rows, extra columns and empty tables."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from test_operators import brute_components, brute_hits, brute_lines, odd_rows

COLUMNS = list(corpus_pipeline.COLUMNS)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_removed string, component_id string, class int, _gone int"
BENCHMARK = [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, None), (3, "river stone")]


def tables(spark, folder, rows):
    wide = [(i, t, "en", "s", None if t is None else len(t), "x", "y", 1, 2) for i, t in rows]
    spark.createDataFrame(wide, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_on_odd_rows(spark, tmp_path):
    """Without labels the classifier keeps every row, so each later stage can be held against plain Python."""
    repeated = "one line of words here\nand a second line\nand the third line\nand a last line of its own"
    rows = [*odd_rows(), (500, repeated), (501, f"{repeated} 501"), (None, repeated), (502, "by the river stone"), (503, " ".join(f"w{i}" for i in range(1, 20))), (503, "another text under this id")]
    folder = tables(spark, tmp_path / "t", rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = texts_of(docs)
        after = stage(spark, docs, folder)
        got = Counter(texts_of(after)) if name != "byte_level_bpe" else None
        if name == "quality_classifier":
            assert after.columns == COLUMNS and got == Counter(before)
        elif name == "line_dedup":
            assert after.columns == COLUMNS
            assert got == Counter((d, t) for d, t, _, gone in brute_lines(before) if not gone or t.strip())
        elif name == "ngram_jaccard_join":
            assert after.columns == COLUMNS
            gone = {d for d, _, c in brute_components(before, 5, 80, 100) if d is not None and d != c}
            assert got == Counter(r for r in before if r[0] not in gone)
        elif name == "benchmark_decontamination":
            assert after.columns == COLUMNS
            assert got == Counter((d, t) for d, t in before if not brute_hits(t, BENCHMARK)[1])
        else:
            ids = after.collect()
            assert len(ids) == len(before) and after.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"]
            assert all(r.n_tokens == len(r.ids) for r in ids)
        docs = spark.createDataFrame(after.collect(), after.schema) if name != "byte_level_bpe" else docs


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, None), (1, None), (2, "")]])
def test_whole_pipeline_on_hardly_any_rows(spark, tmp_path, rows):
    out = corpus_pipeline.run(spark, tables(spark, tmp_path / "t", rows)).collect()
    assert Counter(r.doc_id for r in out) == Counter(d for d, _ in rows) and all(r.n_tokens == 0 for r in out)
