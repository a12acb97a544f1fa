"""Source divergence audit by count cells.

Within each language, every source's use of words is held against every other source's and against the
language as a whole. Terms are maximal runs of ASCII letters and non-ASCII characters, A-Z lower-cased; a
language keeps the terms that occur in at least ``min_docs`` of its documents (V of them). A group's share of
a term with ``count`` occurrences is p = 1 + floor(SCALE * (count + ADDED) / (N + ADDED * V)), N the group's
occurrences of kept terms; all in whole numbers.

* Part ``pair``: for every two sources of a language the sum of abs(p - q) over all kept terms.
* Part ``term``: for every source the terms whose p exceeds the language's q, by p - q, the first ``top``.

**Count cells.** A share depends on counts only, so terms are grouped into cells of equal counts and each
difference is worked out once per cell. For part ``term`` a cell is (group count, language count). A source's
cells are ranked by value; a cell counts while the cells of higher value hold fewer than ``top`` terms (their
multiplicities summed, cells of equal value taken as one). Only these cells are expanded into terms, in UTF-8
order among equal values. For part ``pair`` a cell is the pair of counts, with its multiplicity. Only terms
that both sources have are paired: a term that one or both lack has the fixed share of count 0 there, which
needs the cells of one source, or only a number of terms.

Rows are documents; those repeated count again, with or without an id. Null text, lang and source are ''. A
group without terms has rows too, a language without kept terms pairs of value 0. A very long text is a piece
of its own, counted whole. Other columns may have any names. An empty table gives an empty one.

Words are counted in part before each shuffle, by (lang, source, term), so a source with a third of all
documents is one row per term and task. After that every table is one row per term, cell or group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.llm.batches import LOWER, pieces
from pitspark.session import materialize

HELD = 300_000
_IN_TERM = np.array([b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])
MIN_DOCS, TOP = 30, 50
SCALE, ADDED = 1_000_000_000, 5

_GROUP = ["lang", "source"]
_WIDE = "decimal(28,0)"


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts, and the number of the text that each is from."""
    data = np.frombuffer(b" ".join(texts).translate(LOWER), np.uint8)
    inside = _IN_TERM[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, stop = edge[0::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    offsets = np.concatenate(([0], np.cumsum(stop - start)))
    terms = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])])
    return terms, np.searchsorted(ends, start, side="right")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences, and rows with at least one; several rows of a term may
    follow from one task, which sums up to about HELD rows before it hands them on."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64())])
    key = ["lang", "source", "term"]

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by(key, use_threads=False).aggregate([("n", "sum"), ("n_docs", "sum")]).rename_columns([*key, "n", "n_docs"])

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from table.set_column(2, "term", table.column("term").cast(pa.large_string()).cast(pa.string())).select(schema.names).cast(schema).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for part, texts in pieces(batches):
            terms, owner = words_of(texts)
            by_doc = pa.table({"doc": owner, "term": terms}).group_by(["doc", "term"], use_threads=False).aggregate([([], "count_all")])
            doc = by_doc.column("doc")
            columns = [part.column("lang").take(doc), part.column("source").take(doc), by_doc.column("term"), by_doc.column("count_all"), np.ones(len(doc), np.int64)]
            held.append(summed([pa.table(columns, names=[*key, "n", "n_docs"])]))
            if sum(map(len, held)) > 2 * HELD:
                held = [summed(held)]
                if len(held[0]) > HELD:
                    yield from out(held.pop())
        if held:
            yield from out(summed(held))

    return docs.select(*_GROUP, "text").mapInArrow(run, "lang string, source string, term string, n long, n_docs long")


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n): the uses of every kept term, dealt by term throughout."""
    uses = term_counts(docs).repartition("lang", "term").groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    whole = Window.partitionBy("lang", "term")
    found = uses.withColumns({"lang_n": F.sum("n").over(whole), "in_docs": F.sum("n_docs").over(whole)})
    return found.where(F.col("in_docs") >= min_docs).select(*_GROUP, "term", "n", "lang_n")


def share(count: Column | str, total: str, vocabulary: str) -> Column:
    """The share p of a count, as a long; null in a language without kept terms."""
    top = (F.col(count) if isinstance(count, str) else count).cast(_WIDE) + F.lit(ADDED).cast(_WIDE)
    below = F.col(total).cast(_WIDE) + F.lit(ADDED).cast(_WIDE) * F.col(vocabulary).cast("decimal(18,0)")
    # A remainder keeps the division whole: decimals of this size can't be divided into a rounded number here.
    scaled = (top * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)")
    below = F.when(F.col(vocabulary) > 0, below).cast("decimal(38,0)")
    return F.call_function("div", scaled, below) + F.lit(1)


def group_figures(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, total, n_terms, lang_total, vocabulary, share_0) of every group that occurs; share_0
    is the share of a term that the group lacks."""
    held = terms.groupBy(*_GROUP).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_terms"))
    langs = terms.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("vocabulary"))
    out = docs.select(*_GROUP).distinct().join(held, _GROUP, "left").join(langs, "lang", "left").fillna(0)
    return out.withColumn("share_0", share(F.lit(0), "total", "vocabulary"))


def pair_values(terms: DataFrame, figures: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, both ways."""
    side = {x: figures.select("lang", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "total", "n_terms", "share_0")]) for x in "ab"}
    pairs = side["a"].join(side["b"], "lang").join(figures.select("lang", "vocabulary").distinct(), "lang").where("source_a != source_b")
    key = ["lang", "source_a", "source_b"]

    # Terms that neither has, and all pairs of a language without kept terms.
    neither = pairs.select(*key, F.coalesce((F.col("vocabulary") - F.col("n_terms_a") - F.col("n_terms_b")) * F.abs(F.col("share_0_a") - F.col("share_0_b")), F.lit(0)).alias("value"))

    # Every term of one source, as if the other lacked it.
    own = terms.groupBy("lang", F.col("source").alias("source_a"), F.col("n").alias("n_a")).agg(F.count(F.lit(1)).alias("m"))
    own = own.join(figures.select("lang", F.col("source").alias("source_a"), F.col("total").alias("total_a"), "vocabulary"), ["lang", "source_a"])
    own = own.withColumn("p", share("n_a", "total_a", "vocabulary")).select("lang", "source_a", "p", "m")
    alone = pairs.select(*key, "share_0_b").join(own, ["lang", "source_a"]).groupBy(*key).agg(F.sum(F.col("m") * F.abs(F.col("p") - F.col("share_0_b"))).alias("value"))

    # What that is off by for the terms that both have.
    one, other = (terms.select("lang", "term", F.col("source").alias(f"source_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    cells = one.join(other, ["lang", "term"]).where("source_a < source_b").groupBy(*key, "n_a", "n_b").agg(F.count(F.lit(1)).alias("m"))
    cells = cells.join(pairs, key).withColumns({f"p_{x}": share(f"n_{x}", f"total_{x}", "vocabulary") for x in "ab"})
    apart = lambda x, y: F.abs(F.col(x) - F.col(y))
    off = apart("p_a", "p_b") - apart("p_a", "share_0_b") - apart("p_b", "share_0_a") + apart("share_0_a", "share_0_b")
    shared = cells.groupBy(*key).agg(F.sum(F.col("m") * off).alias("value"))

    turned = lambda df: df.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), "value")
    parts = neither.unionByName(alone).unionByName(turned(alone)).unionByName(shared).unionByName(turned(shared))
    return parts.groupBy("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item")).agg(F.sum("value").alias("value"))


def term_values(terms: DataFrame, figures: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value) of the terms in the cells that can hold a source's ``top`` first."""
    cell = [*_GROUP, "n", "lang_n"]
    cells = terms.groupBy(*cell).agg(F.count(F.lit(1)).alias("m")).join(figures, _GROUP)
    cells = cells.withColumn("value", share("n", "total", "vocabulary") - share("lang_n", "lang_total", "vocabulary")).where("value > 0")
    by_value = Window.partitionBy(*_GROUP).orderBy(F.desc("value"))
    first = cells.select(*cell, "m", "value").withColumn("place", F.rank().over(by_value)).where(F.col("place") <= top)
    # Terms in cells of higher value: the running sum up to this value, without this value's own cells.
    above = F.sum("m").over(by_value.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("m").over(Window.partitionBy(*_GROUP, "value"))
    wanted = first.withColumn("above", above).where(F.col("above") < top).select(*cell, "value")
    return terms.join(wanted, cell).select(*_GROUP, F.col("term").alias("item"), "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank). Ranks are from 1 per group and part, by value descending and
    then item in UTF-8 order. Intermediate tables go to the shared folder."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = materialize(kept_terms(docs, min_docs), "terms")
    figures = materialize(group_figures(docs, terms), "figures")
    order = Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")
    pairs = pair_values(terms, figures).withColumn("rank", F.row_number().over(order))
    first = term_values(terms, figures, top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    parts = [rows.select(*_GROUP, F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank") for part, rows in (("pair", pairs), ("term", first))]
    return parts[0].unionByName(parts[1])
