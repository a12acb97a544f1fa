"""Removal of repeated lines by overlapping three-line windows, in DataFrame operations only.

Lines are what "\\n" separates. A window is three consecutive lines of one document, at least one of which
has a non-space character. A window repeats if the same three lines start earlier: in a document with a
smaller doc_id, or higher up in the same one. The lines of all repeated windows are removed: covered
positions are merged into stretches, and what lies between the stretches is kept.

Windows are compared by two 64-bit hashes over the three lines. A repeat inside a document is found by
sorting its own windows, so one row per document and window content enters the global step. There a window's
first document and number of documents are aggregated in part before the shuffle, and only windows of
several documents are joined back; a window that a third of all documents share is split by the skew join.

Texts with fewer than three lines have no window and stay. Null texts stay null. Rows with the same doc_id
and text are the same document and keep the same lines; other texts under one id don't precede each other.
Rows without an id neither remove lines nor lose any to other rows. An empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.llm.batches import docs_only

WINDOW = 3


def _window_hashes(lines: Column, size: int) -> Column:
    """Array of (h1, h2, pos), one per window with a non-blank line."""

    def at(i: Column) -> Column:
        parts = [F.get(lines, i + k) for k in range(size)]
        return F.struct(F.xxhash64(F.lit(1), *parts).alias("h1"), F.xxhash64(F.lit(2), *parts).alias("h2"), i.alias("pos"), _any_word(parts).alias("has"))

    def _any_word(parts: list[Column]) -> Column:
        has = F.lit(False)
        for p in parts:
            has = has | p.rlike(r"[^\x20\x09-\x0D]")
        return has

    n = F.size(lines)
    starts = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, at), lambda w: w["has"])


def _mark_inner(ordered: Column) -> Column:
    """``inner`` where the document has the same window higher up; the windows come in hash order."""
    return F.transform(
        ordered,
        lambda w, i: F.struct(
            w["h1"].alias("h1"), w["h2"].alias("h2"), w["pos"].alias("pos"),
            F.coalesce((i > 0) & (F.get(ordered, i - 1)["h1"] == w["h1"]) & (F.get(ordered, i - 1)["h2"] == w["h2"]), F.lit(False)).alias("inner"),
        ),
    )


def repeated_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, _text, at): for documents with repeated windows, the sorted starts of these."""
    lines = docs_only(docs).where("text is not null").select("doc_id", F.xxhash64("text").alias("_text"), F.split("text", "\n").alias("lines"))
    # Arrays that a lambda refers to are columns of their own, else they are computed again per element.
    ordered = lines.select("doc_id", "_text", F.array_sort(_window_hashes(F.col("lines"), size)).alias("ordered"))
    marked = ordered.select("doc_id", "_text", F.explode(_mark_inner(F.col("ordered"))).alias("w")).select("doc_id", "_text", "w.*")
    outer = marked.where("not inner and doc_id is not null").select("doc_id", "_text", "h1", "h2", "pos")
    first = outer.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h1", "h2", "first")
    later = outer.join(first, ["h1", "h2"]).where("doc_id > first").select("doc_id", "_text", "pos")
    inner = marked.where("inner").select("doc_id", "_text", "pos")
    return later.unionByName(inner).groupBy("doc_id", "_text").agg(F.sort_array(F.collect_set("pos")).alias("at"))


def _between(n: Column, at: Column, size: int) -> Column:
    """Stretches (start, end) of lines that no window starting at one of ``at`` covers."""
    edges = F.transform(
        F.sequence(F.lit(0), F.size(at)),
        lambda i: F.struct(F.coalesce(F.get(at, i - 1) + size, F.lit(0)).alias("start"), F.coalesce(F.get(at, i), n).alias("end")),
    )
    return F.filter(edges, lambda e: e["end"] > e["start"])


def replace_text(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, the text without its repeated lines ("" if none is
    left, null if it was null), then ``n_lines`` and ``n_removed``."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_removed")]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *others).alias("_others"))
    base = base.withColumn("_text", F.xxhash64("text"))
    found = repeated_windows(docs, size).withColumnsRenamed({"doc_id": "_id", "_text": "_of"})
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_of")), "left")
    joined = joined.select("doc_id", "text", "_others", "at", F.split("text", "\n").alias("lines"))
    lines = F.col("lines")
    kept = F.flatten(F.transform(_between(F.size(lines), F.col("at"), size), lambda e: F.slice(lines, e["start"] + 1, e["end"] - e["start"])))
    done = joined.withColumn("kept", F.when(F.col("at").isNotNull(), kept)).select(
        "doc_id",
        F.when(F.col("at").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
        "_others",
        F.when(F.col("lines").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("at").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
    )
    return done.select("doc_id", "text", *[F.col(f"_others.`{c}`").alias(c) for c in others], "n_lines", "n_removed")


def remove_repeated_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) of every row."""
    return replace_text(docs_only(docs), size)
