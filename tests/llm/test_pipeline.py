"""The pipeline's stages against plain Python, on a small copy of the tables."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import public_tokenizers
import tiktoken

from pitspark.llm import quality_classifier
from pitspark.llm.batches import fold_is
from pitspark.llm.bpe import load_ranks, parse_ranks
from test_operators import brute_components, brute_hits, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages_match_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = stage(spark, docs, SF)
        got = {r.doc_id: r for r in after.collect()}
        assert name == "byte_level_bpe" or after.dtypes == docs.dtypes and after.columns == columns
        if name == "quality_classifier":
            model = quality_classifier.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~fold_is(5, 0))
            score = {d: model.score(quality_classifier.np.array([quality_classifier.figures(t.encode())]))[0] for d, t in before}
            assert set(got) == {d for d, s in score.items() if s >= 0.3}
        elif name == "line_dedup":
            want = {d: t for d, t, _, gone in brute_lines(before) if not gone or t.strip()}
            assert {d: r.text for d, r in got.items()} == want
            assert all(r.n_chars == len(r.text) for r in got.values())
        elif name == "ngram_jaccard_join":
            assert set(got) == {d for d, _, c in brute_components(before, 5, 80, 100) if d == c}
        elif name == "benchmark_decontamination":
            assert set(got) == {d for d, t in before if not brute_hits(t, benchmark)[1]}
        else:
            flat = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parse_ranks(load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), special_tokens={})
            for d, t in before:
                assert got[d].ids == flat.encode_ordinary(t) and got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        docs = spark.createDataFrame(after.collect(), after.schema) if name != "byte_level_bpe" else docs


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, SF).count() == 0
