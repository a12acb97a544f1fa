"""The corpus pipeline: each stage takes the documents that the one before it kept.

Part of subpackage ``pitspark.llm``. Every stage but the last returns the columns of ``documents`` (doc_id, text,
lang, source, n_chars, as far as its input has them); each stage's result is written as Parquet and read again.

Other columns of the input are left out, whatever their names. A null text is scored as an empty one, has no lines,
no shingles, no benchmark words and no tokens. Rows without an id are never copies of another row and lose only what
they repeat themselves. Rows that share an id are judged row by row, but the near-duplicate stage keeps or drops an
id with all its rows; repeated rows lose their repeated lines like any copy. Very long texts are handled whole. Empty
tables go through as empty ones; without labels of one kind the classifier keeps every row."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.llm import bpe, decontamination, line_dedup, ngram_join, quality_classifier
from pitspark.llm.batches import fold_is
from pitspark.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with(docs: DataFrame, found: DataFrame, columns: dict) -> DataFrame:
    """``docs`` with some columns replaced, in the columns of documents."""
    return found.select(*[columns.get(c, F.col(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns if c in COLUMNS])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is under 0.3. A score belongs to a text, so it is computed
    next to the other columns, without a join."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~fold_is(5, 0))
    rows = _with(docs, docs, {})
    return quality_classifier.keep(rows, model, 0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts. A document that had words and has none left goes."""
    done = line_dedup.replace_text(docs)
    left = done.where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return _with(docs, left, {"n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one whose doc_id names the component. Five-word shingles,
    similarity 0.8. Rows without an id stay."""
    linked = ngram_join.link_documents(docs, 5, 80, 100)
    gone = linked.where("component_id != doc_id").select(F.col("doc_id").alias("_gone"))
    return _with(docs, docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti"), {})


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a hit word."""
    return _with(docs, decontamination.keep_clean(_with(docs, docs, {}), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), {})


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded_same): token ids, and whether they decode to the text."""
    coded = bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_free),
    ("byte_level_bpe", tokens),
]

#: The classifier's scores can't be written in SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result goes to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
