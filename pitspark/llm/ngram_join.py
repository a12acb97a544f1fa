"""N-gram Jaccard self-join of documents by PartEnum signatures.

A document's set holds the hashes of its distinct word n-grams. Documents link when the Jaccard similarity
of their sets reaches a threshold given as two integers, num / den.

**Signatures.** Sets are put into size bands. In a band group, similar sets differ in at most k elements,
which follows from the largest size and the threshold. The domain of hashes is cut into n1 partitions by the
hash, with n1 = k // (k2 + 1) + 1 + spare, so at least 1 + spare of them differ in at most k2 elements. Each
partition is cut into n2 parts, and for each subset of n2 - k2 parts the elements that fall into them give
one signature: in a partition that differs in at most k2 elements, at least one subset agrees wholly. A set
signs for its own band, and for the next one if a set there can be similar to it. Subsets without an element
agree between strangers; they are signed only by sets with more than ``spare`` thin partitions, and two sets
of which one has no more than that still agree in a partition that isn't thin. The same holds for subsets with none but
frequent elements, which agree between more strangers the more documents there are: they too are signed only by sets with
more than ``spare`` partitions that have such a subset. That is so whichever elements count as frequent, so a sample may
say which do (``frequent_elements``); links never depend on it.

**Links.** Exact copies have the same set; they are one class from the start (a 64-bit hash of set and size).
Every signature group has a pivot, its smallest class: a star, which is linear in the group. Pairs that differ in too
many cells of a sketch (``cells_apart``) are dropped before their texts are shuffled, which loses none (``alike``). Round
one compares each class with the smallest of its pivots only, round two with the others where the two are in different
components still. Members of a group that end up in different components may be similar to each other, so round three
compares what is left of these groups across components: groups of up to SMALL classes pair by pair, behind the sketches
again. In a larger group of near copies that
would be nearly all pairs, most of them not similar enough, so there pairs are first held against a second bound that
loses none: of two similar sets, each has an element of the other among its own rarest (``rare_elements``). The pairs that pass are compared in rounds too: of each class
a few, then four times as many, until no pair spans two components. So the links that are kept grow with the classes,
not with the pairs of a group of near copies. Every comparison is exact, on the texts. So each link lies inside a component, and no group is cut or capped.

Signature rows of one piece of input are reduced to the first class per signature before they are shuffled;
the others of the piece become rows with a key of their own. So a signature that a third of all documents
share has one row per piece in its task, and that task streams them. Signatures, and later the elements of what is left, are
shuffled in rounds, each with its own share of them, so that their shuffle files take about as much disk as the texts.

Null and empty texts have no set, link with nothing and are their own component. Rows without an id have
no component and link with nothing. Repeated rows are copies. Very long texts are pieces of their own; other columns
may have any names. An empty table gives an empty one."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import ceil, comb, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitspark.llm.batches import Words, docs_only, mix, pieces, windows
from pitspark.llm.components import connected_components
from pitspark.session import discard, materialize

SEEN = 200_000
WORDS, PLANES = 4, 4
CARRIED = 128
FEW = 4
SMALL = 8
SAMPLE, OFTEN, MOST, MARKS = 20_000, 6, 100_000, 1 << 21


class Sets:
    """Sorted distinct n-gram hashes of texts."""

    def __init__(self, n: int):
        self.n, self.words = n, Words(lower=True)

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        hashes, first = self.words(texts)
        long, n = windows(hashes, self.n), self.n
        spans = zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
        return [np.unique(long[a : b - n + 1] if b - a >= n else windows(hashes[a:b], b - a)) if b > a else np.zeros(0, np.uint64) for a, b in spans]


def classes_of(found: list[np.ndarray]) -> list[int | None]:
    """Signed 64-bit ids of sets, None for an empty one."""
    filled = [x for x in found if len(x)]
    if not filled:
        return [None] * len(found)
    sizes = np.array([len(x) for x in filled])
    sums = np.add.reduceat(mix(np.concatenate(filled)), np.cumsum(sizes) - sizes)
    ids = iter(mix(sums + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).tolist())
    return [next(ids) if len(x) else None for x in found]


def class_of(elements: np.ndarray) -> int | None:
    return classes_of([elements])[0]


class PartEnum:
    """Signatures for one threshold. For each band group the (k2, n2) with the fewest signatures is chosen,
    with ``spare`` partitions for the thin ones that a set of the group's smallest size is expected to
    have, and four deviations more. Very small sets have one partition and sign for every subset."""

    CHOICES = ((0, 1), (1, 2), (1, 3), (2, 4), (2, 5), (3, 6), (3, 7))

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.steps = 2 if 20 * num >= 17 * den else 1  # a band spans this power of the threshold
        self.bounds = [1]  # first size of each band
        self.plans: dict[int, tuple[int, int, int, list[np.ndarray]] | None] = {}

    def _band(self, size: int) -> int:
        while self.bounds[-1] <= size:
            self.bounds.append(self.bounds[-1] * self.den**self.steps // self.num**self.steps + 1)
        return int(np.searchsorted(self.bounds, size, side="right")) - 1

    def groups(self, size: int) -> list[int]:
        band = self._band(size)
        reaches = self.num * self.bounds[band + 1] <= size * self.den
        return [band, band + 1] if reaches else [band]

    def plan(self, group: int) -> tuple[int, int, int, list[np.ndarray]] | None:
        """(n1, n2, spare, subsets), or None where similar sets are equal and need no signature."""
        if group not in self.plans:
            self._band(self.bounds[group])
            largest, smallest = self.bounds[group + 1] - 1, max(1, self.bounds[group] * self.num // self.den)
            k = (self.den - self.num) * 2 * largest // (self.den + self.num)
            found = [x for c in self.CHOICES if k and (x := self._size(k, smallest, *c))]
            _, n1, n2, k2, spare = min(found, default=(0, 1, k + 2, k, 0))
            self.plans[group] = (n1, n2, spare, [np.array(c) for c in combinations(range(n2), n2 - k2)]) if k else None
        return self.plans[group]

    @staticmethod
    def _size(k: int, smallest: int, k2: int, n2: int) -> tuple | None:
        """(rows, n1, n2, k2, spare), or None if too many partitions would be thin."""
        base, subsets, spare = k // (k2 + 1) + 1, comb(n2, k2), 0
        while True:
            n1 = base + spare
            elements = smallest / n1 * (n2 - k2) / n2
            thin = subsets * exp(-elements)
            if thin >= 0.4:
                return None
            need = ceil(n1 * thin + 4 * sqrt(n1 * thin * (1 - thin)))
            if need <= spare:
                return n1 * subsets, n1, n2, k2, spare
            spare += 1

    def __call__(self, elements: np.ndarray) -> np.ndarray:
        return self.together([elements])[0]

    def together(self, found: list[np.ndarray], rounds: int = 1, round_: int = 0, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(signatures, position of their set) of many sets. The sets of a band group are signed at once, and each
        of several rounds signs its own share of the partitions only. ``frequent`` has a mark for each value of an
        element's last bits."""
        of_group = defaultdict(list)
        for i, x in enumerate(found):
            for group in self.groups(len(x)):
                of_group[group].append(i)
        out, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for group, members in of_group.items():
            if (plan := self.plan(group)) is None:
                continue
            n1, n2, spare, subsets = plan
            elements = np.concatenate([found[i] for i in members])
            salted = mix(elements + np.uint64(group * 7919 + 1))
            row = np.repeat(np.arange(len(members)), [len(found[i]) for i in members])
            cell = (salted % np.uint64(n1 * n2)).astype(np.int64) + row * (n1 * n2)
            sums = np.zeros(len(members) * n1 * n2, np.uint64)
            np.add.at(sums, cell, mix(salted))
            sums = sums.reshape(len(members), n1, n2)
            empty = np.stack([(sums[:, :, s] == 0).all(2) for s in subsets], 2)
            share = np.flatnonzero((np.arange(n1) + group) % rounds == round_)
            mine = sums[:, share]
            chosen = np.stack([(mine[:, :, s] * (np.arange(len(s), dtype=np.uint64) * np.uint64(2) + np.uint64(3))).sum(2) for s in subsets], 2)
            place = np.arange(n1 * len(subsets), dtype=np.uint64).reshape(n1, -1)[share] + np.uint64((group + 1) << 32)
            kept = ~empty[:, share] | (empty.any(2).sum(1) > spare)[:, None, None]
            if frequent is not None:
                rare = np.zeros(sums.size, bool)
                rare[cell[~frequent[elements & np.uint64(len(frequent) - 1)]]] = True
                rare = rare.reshape(sums.shape)
                usual = np.stack([~rare[:, :, s].any(2) for s in subsets], 2)
                kept = ~usual[:, share] | (kept & (usual.any(2).sum(1) > spare)[:, None, None])
            out.append(mix(mix(chosen) + mix(place))[kept])
            owner.append(np.repeat(np.array(members), kept.sum((1, 2))))
        return np.concatenate(out), np.concatenate(owner)


def classes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, class) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(n)
        for part, texts in pieces(batches):
            found = sets(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array(classes_of(found), pa.int64())], schema=schema)

    return docs_only(docs).mapInArrow(run, "doc_id long, n_shingles long, class long")


def frequent_elements(docs: DataFrame, heads: DataFrame, n: int) -> np.ndarray:
    """Packed marks, one for each value of an element's last bits: the elements that OFTEN or more classes of a sample have,
    the MOST most frequent ones at most. The sample has between SAMPLE and twice as many classes, or all if there are fewer."""
    every = max(1, heads.count() // SAMPLE)
    sampled = heads.where(F.pmod(F.xxhash64("head"), F.lit(every)) == 0).select("class", F.col("head").alias("doc_id"))
    counted = set_elements(docs.join(F.broadcast(sampled), "doc_id"), n).groupBy("element").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    found = counted.orderBy(F.desc("n"), "element").limit(MOST).select("element").toArrow().column(0).to_numpy()
    marks = np.zeros(MARKS, bool)
    marks[found.astype(np.int64).view(np.uint64) & np.uint64(MARKS - 1)] = True
    return np.packbits(marks)


def signatures(texts: DataFrame, n: int, num: int, den: int, rounds: int = 1, round_: int = 0, frequent: np.ndarray | None = None) -> DataFrame:
    """(signature, class, local) rows of a table with a text column; ``local`` is the first class of the
    same piece with that signature, null if this is the first. A class met before in the task is skipped
    (up to SEEN classes are remembered). Of several rounds each deals with its own share of the signatures.
    ``frequent``: the packed marks of ``frequent_elements``."""
    schema = pa.schema([("signature", pa.int64()), ("class", pa.int64()), ("local", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, sign, seen = Sets(n), PartEnum(num, den), set()
        marks = None if frequent is None else np.unpackbits(frequent).astype(bool)
        for _, raw in pieces(batches):
            if len(seen) > SEEN:
                seen.clear()
            new, owner, found = [], [], sets(raw)
            for x, own in zip(found, classes_of(found), strict=True):
                if own is not None and own not in seen:
                    seen.add(own)
                    new.append(x)
                    owner.append(own)
            s, position = sign.together(new, rounds, round_, marks)
            if not len(s):
                continue
            c = np.array(owner, np.int64)[position]
            order = np.lexsort((c, s))
            s, c = s[order], c[order]
            head = np.r_[True, s[1:] != s[:-1]]
            local = c[np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))]
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(c), pa.array(local, mask=head)], schema=schema)

    return texts.select("text").mapInArrow(run, "signature long, class long, local long")


def shared_signatures(signed: DataFrame) -> DataFrame:
    """(signature, class, pivot) of every class in a signature group of two classes or more. The pivot is
    the group's smallest class among those that are first in their piece, else the piece's first."""
    key = F.when(F.col("local").isNull(), F.col("signature")).otherwise(F.xxhash64("signature", "class"))
    order = Window.partitionBy("_key", "local").orderBy("class")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = signed.withColumn("_key", key).withColumns({"head": F.first("class").over(whole), "before": F.lag("class").over(order), "next": F.lead("class").over(order)})
    # A class that several pieces hold comes several times in a row; one of them is kept.
    groups = seen.where("local is not null or (class != head and class != before) or (class = head and class != next)")
    return groups.select("signature", "class", F.coalesce("local", "head").alias("pivot"))


def own_texts(texts: DataFrame, n: int) -> DataFrame:
    """The (class, text) rows whose text is of the class, in case an id stands for several texts."""
    schema = pa.schema([("class", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(n)
        for part, raw in pieces(batches):
            right = [x == c for x, c in zip(classes_of(sets(raw)), part.column("class").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("class"), part.column("text")], schema=schema).filter(pa.array(right))

    return texts.mapInArrow(run, "class long, text string")


def verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose texts' sets are similar enough. One text per pair is shuffled, and of the texts
    only those that are in a pair, so that a few pairs left don't move all texts."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, last, mine = Sets(n), None, np.zeros(0, np.uint64)
        for part, raw in pieces(batches, "text_b"):
            a, b, keep = part.column("a").to_pylist(), part.column("b").to_pylist(), []
            column = part.column("text_a")
            for i, x in enumerate(sets(raw)):
                if a[i] != last:
                    last, mine = a[i], sets([column[i].as_py().encode()])[0]
                common = int(np.isin(x, mine, assume_unique=True, kind="sort").sum())
                if den * common >= num * (len(x) + len(mine) - common):
                    keep.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in keep], pa.int64()) for j in (0, 1)], schema=schema)

    ends = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    texts = texts.join(ends, "class", "left_semi")
    right = pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def signature_rounds(members: DataFrame, docs: DataFrame, num: int, den: int) -> int:
    """In how many rounds signatures are shuffled, so that those of one round take about as much as the texts.
    A set of n elements has about 4 n (den - num) / den signatures, of 20 bytes or so each."""
    shingles = members.agg(F.sum("n_shingles")).first()[0] or 0
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, round(shingles * 4 * (den - num) / den * 20 / max(1, size)))


def link_documents(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, class, component_id): component_id is the smallest doc_id reachable by links.
    Classes are ids of equal sets. Intermediate tables go to the shared folder and are removed once what is
    read from them is written."""
    docs = docs_only(docs)
    members = materialize(classes(docs, n), "classes")
    known = members.where("doc_id is not null and class is not null")
    heads = known.groupBy("class").agg(F.min("doc_id").alias("head"))

    with_id, rounds = docs.where("doc_id is not null"), signature_rounds(members, docs, num, den)
    frequent = frequent_elements(docs, heads, n)
    parts = [materialize(shared_signatures(signatures(with_id, n, num, den, rounds, k, frequent)), "shared") for k in range(rounds)]
    shared = reduce(DataFrame.unionByName, parts)
    wanted = shared.select("class").union(shared.select(F.col("pivot").alias("class"))).distinct().join(heads, "class")
    texts = materialize(own_texts(docs.join(wanted, docs["doc_id"] == wanted["head"]).select("class", "text"), n), "texts")
    sides = materialize(sketches(texts.withColumn("component", F.col("class")), n).drop("component"), "sketches")
    rays = shared.where("class != pivot").select(F.col("pivot").alias("a"), F.col("class").alias("b")).distinct()
    stars = materialize(alike(rays, sides, num, den), "stars")

    # A class is in many groups with many pivots. Its smallest pivot comes first; the others are compared only
    # where that has left the two apart.
    first = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = materialize(verified(first, texts, n, num, den), "links")
    near = connected_components(links)
    apart = _across(stars, near)
    more = materialize(verified(apart, texts, n, num, den), "links")
    joined = _merged(near, more)
    side = joined.withColumnRenamed("node", "class")

    held = shared.select("signature", "class").union(shared.select("signature", F.col("pivot").alias("class"))).distinct()
    placed = materialize(held.join(side, "class", "left").withColumn("component", F.coalesce("component", "class")), "placed")
    discard(*parts)
    sizes = placed.groupBy("signature").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
    split = sizes.where("lo != hi and n > 2").select("signature", "n")  # of two classes, one is the pivot
    few_held = placed.join(split.where(F.col("n") <= SMALL), "signature")
    inside = materialize(alike(pairs_of_groups(few_held), sides, num, den), "inside")
    residual = placed.join(split.where(F.col("n") > SMALL), "signature", "left_semi").select("class", "component").distinct()
    left_over = materialize(residual.join(texts, "class"), "residual")
    discard(placed)
    elements = materialize(set_elements(left_over, n), "elements")
    share = lambda k: elements.where(F.pmod(F.xxhash64("element"), F.lit(rounds)) == k)
    commons = [materialize(common_elements(share(k)), "common") for k in range(rounds)]
    discard(elements)
    sketched = left_over.select("class", "component").join(sides, "class")
    rare = materialize(rare_elements(reduce(DataFrame.unionByName, commons), sketched, num, den), "rare")
    discard(*commons, left_over)
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = residual_pairs(rare, num, den).unionByName(inside).distinct()
    cross = materialize(across.join(done, ["a", "b"], "left_anti"), "pairs")
    discard(rare, inside, sides)
    found, few = [links, more], FEW
    while not cross.isEmpty():
        step = materialize(few_of_each(cross, few), "step")
        found.append(materialize(verified(step, texts, n, num, den), "links"))
        joined = _merged(joined, found[-1])
        rest = materialize(_across(cross.join(step, ["a", "b"], "left_anti"), joined), "pairs")
        discard(step, cross)
        cross, few = rest, 4 * few
    final = joined.withColumnRenamed("node", "class")

    placed_heads = heads.join(final, "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = placed_heads.groupBy("component").agg(F.min("head").alias("component_id"))
    by_class = materialize(placed_heads.join(smallest, "component").select("class", "component_id"), "components")
    discard(texts, stars, cross, *found)
    out = members.join(by_class, "class", "left")
    return out.select("doc_id", "n_shingles", "class", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _placed(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components, _ca and _cb; a node without one is its own."""
    for x in "ab":
        pairs = pairs.join(parts.select(F.col("node").alias(x), F.col("component").alias(f"_c{x}")), x, "left").withColumn(f"_c{x}", F.coalesce(f"_c{x}", x))
    return pairs.where("_ca != _cb")


def _across(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    return _placed(pairs, parts).select("a", "b")


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links. Components are joined, not their nodes, each pair of them once."""
    over = connected_components(_placed(links, parts).select(F.least("_ca", "_cb").alias("a"), F.greatest("_ca", "_cb").alias("b")).distinct())
    nodes = parts.unionByName(over.select("node", F.col("node").alias("component")).join(parts.select("node"), "node", "left_anti"))
    further = over.select(F.col("node").alias("component"), F.col("component").alias("_further"))
    return materialize(nodes.join(further, "component", "left").select("node", F.coalesce("_further", "component").alias("component")), "merged")


def few_of_each(pairs: DataFrame, few: int) -> DataFrame:
    """At least one and at most about ``few`` pairs of each class on each side, each the smallest of a share of its pairs.
    These are aggregates, so a class with very many pairs is counted in part before it is shuffled."""
    share = lambda x: F.pmod(F.xxhash64(x), F.lit(few))
    lower = pairs.groupBy("b", share("a")).agg(F.min("a").alias("a")).select("a", "b")
    return lower.unionByName(pairs.groupBy("a", share("b")).agg(F.min("b").alias("b")).select("a", "b")).distinct()


def pairs_of_groups(held: DataFrame) -> DataFrame:
    """(a, b) of classes in one group of (signature, class, component) rows and in different components."""
    left, right = (held.select("signature", F.col("class").alias(x), F.col("component").alias(f"_c{x}")) for x in "ab")
    return left.join(right, "signature").where("a < b and _ca != _cb").select("a", "b").distinct()


def _near(num: int, den: int) -> Column:
    """Whether neither the sizes nor the sketches of a and b rule out that they are similar."""
    total = F.col("size_a") + F.col("size_b")
    near = (F.col("size_a") * den >= F.col("size_b") * num) & (F.col("size_b") * den >= F.col("size_a") * num)
    return near & (cells_apart(F.col("sketch_a"), F.col("sketch_b")) * (den + num) <= total * (den - num))


def alike(pairs: DataFrame, sides: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that may be similar, by the (class, size, sketch) rows of ``sides``."""
    for x in "ab":
        pairs = pairs.join(sides.select(F.col("class").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}")), x)
    return pairs.where(_near(num, den)).select("a", "b")


def residual_pairs(rare: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of classes in different components that may be similar: they share a rare element, and neither their
    sizes, nor the elements that only one of them has, nor their sketches rule it out. A pair is taken at the
    smallest common one of the elements that both carry in ``rare``; where they have none there, at every common
    element, of which one row is kept."""
    left, right = (rare.select("element", F.col("class").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("component", "size", "alone", "rare", "sketch")]) for x in "ab")
    # What only one class has is in the union and not in the intersection.
    most = F.least(F.col("size_a") - F.col("alone_a"), F.col("size_b") - F.col("alone_b"))
    near = _near(num, den) & (most * den >= (most + F.col("alone_a") + F.col("alone_b")) * num)
    once = F.coalesce(F.array_min(F.array_intersect("rare_a", "rare_b")), F.col("element")) == F.col("element")
    return left.join(right, "element").where((F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b")) & near & once).select("a", "b").distinct()


def sketches(residual: DataFrame, n: int) -> DataFrame:
    """(class, component, size, sketch) of each (class, component, text) row: the domain cut into 64 * WORDS cells,
    and a hash of PLANES bits of what a set has in each; a long holds one bit of 64 cells. Cells that differ hold different
    elements, so their number is a lower bound of the elements that two sets don't share."""
    cells = 64 * WORDS
    schema = pa.schema([("class", pa.int64()), ("component", pa.int64()), ("size", pa.int32()), ("sketch", pa.list_(pa.int64()))])
    places, planes = np.arange(64, dtype=np.uint64), np.arange(64 - PLANES, 64, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(n)
        for part, raw in pieces(batches):
            found, sizes = [], []
            for x in sets(raw):
                sums = np.zeros(cells, np.uint64)
                np.add.at(sums, (mix(x + np.uint64(5)) % np.uint64(cells)).astype(np.int64), mix(x))
                bits = (mix(sums).reshape(WORDS, 1, 64) >> planes[:, None]) & np.uint64(1)
                found.append((bits << places).sum(2, dtype=np.uint64).ravel().view(np.int64))
                sizes.append(len(x))
            yield pa.RecordBatch.from_arrays([part.column("class"), part.column("component"), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return residual.select("class", "component", "text").mapInArrow(run, "class long, component long, size int, sketch array<long>")


def cells_apart(a: Column, b: Column) -> Column:
    """Number of cells in which two sketches differ. An expression this short is compiled by the JVM; with a cell's bits
    side by side it was past the size up to which that happens, and took a hundred times as long."""
    total = F.lit(0)
    for word in range(0, WORDS * PLANES, PLANES):
        apart = [F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))) for i in range(word, word + PLANES)]
        total = total + F.bit_count(reduce(Column.bitwiseOR, apart))
    return total


def set_elements(residual: DataFrame, n: int) -> DataFrame:
    """(element, class): the elements of each (class, text) row."""
    schema = pa.schema([("element", pa.int64()), ("class", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(n)
        for part, raw in pieces(batches):
            found = sets(raw)
            owner = np.repeat(np.array(part.column("class").to_pylist(), np.int64), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(owner)], schema=schema)

    return residual.select("class", "text").mapInArrow(run, "element long, class long")


def common_elements(elements: DataFrame) -> DataFrame:
    """(element, class, n) of the elements that n classes have, two or more."""
    return elements.join(elements.groupBy("element").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "element")


def rare_elements(common: DataFrame, sides: DataFrame, num: int, den: int) -> DataFrame:
    """(element, class, component, size, sketch, alone, rare): of each class the rarest elements of its set, as many as
    must hold one that any similar set counts among its own rarest. Similar sets share num / den of the larger one, so
    that is all but this share of a set, and one more. Elements that a single class has (``alone`` of them) count, but
    have no partner and are left out. ``rare`` lists the first CARRIED of them, by element, so a row stays small however
    long the text is."""
    placed = common.withColumns({"_held": F.count(F.lit(1)).over(Window.partitionBy("class")), "_rank": F.row_number().over(Window.partitionBy("class").orderBy("n", "element"))})
    needed = F.col("size") - F.ceil(F.col("size") * num / den) + 1
    kept = placed.join(sides, "class").withColumn("alone", (F.col("size") - F.col("_held")).cast("int")).where(F.col("alone") + F.col("_rank") <= needed)
    place = F.row_number().over(Window.partitionBy("class").orderBy("element"))
    carried = kept.withColumn("_place", place).groupBy("class").agg(F.collect_list(F.when(F.col("_place") <= CARRIED, F.col("element"))).alias("rare"))
    return kept.join(carried, "class").select("element", "class", "component", "size", "sketch", "alone", "rare")
