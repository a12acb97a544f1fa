"""URL filter: allow and block rules first, a logistic regression on hashed character n-grams for the rest.

The host is what follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; the path goes on
up to "?", "#" or the end. A null url, or one without "://", has an empty host and path. A rule fits its
host and all subdomains if the path starts with the rule's path; the longest rule that fits decides.

The regression reads n-grams of host and path, each in its own name space, hashed into a fixed number of
buckets. It is trained on a small labelled table (url, label 1 = block). A url without n-grams gets the
intercept's verdict. Rows are independent; null ids, repeats and very long urls need nothing special."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]
RULES: list[Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Words that names of unwanted and of ordinary sites are made of, in general use.
UNWANTED_WORDS = (
    "casino poker slots jackpot roulette blackjack betting bets bingo lottery wager bonus pills pharma meds viagra steroids diet slimming loans payday cash "
    "credit debt forex crypto profit earn porn xxx adult sex cams nude escort dating hookup spam links seo backlinks farm clicks popup tracker ads banner "
    "traffic cheap free win prize deals replica fake crack warez torrent keygen hack clickbait gossip"
).split()
ORDINARY_WORDS = (
    "library museum school college garden kitchen recipe history science math physics biology music guitar piano theatre cinema poetry novel atlas map river "
    "mountain forest weather climate energy solar engine bicycle railway airport harbor city village council court clinic hospital dentist nursery farmhouse "
    "bakery coffee tea wine cheese bread pottery knitting carpentry painting camera astronomy chess football tennis sailing hiking news times journal gazette"
).split()
PER_WORD = 4


def hosts_of(words: Sequence[str], per_word: int = PER_WORD) -> list[str]:
    """Names of two words: each with the ``per_word`` words at set distances from it, joined by a hyphen or directly."""
    n = len(words)
    return [f"{w}{'-' if (i + k) % 2 else ''}{words[(i + 5 * k + 3) % n]}" for i, w in enumerate(words) for k in range(per_word)]


def urls_of(hosts: Sequence[str]) -> list[str]:
    """A url for each name, in one of a few forms that say nothing about its label."""
    forms = ("http://{}.com/en/1.html", "https://www.{}.org/de/20", "http://m.{}.net/fr/300/", "https://blog.{}.com/es/44?page=2", "https://{}.org/about", "http://shop.{}.net/")
    return [forms[i * 7 // 3 % len(forms)].format(h) for i, h in enumerate(hosts)]


def default_table() -> list[tuple[str, int]]:
    """Several hundred labelled urls (1 = block) whose names are built from the two lists. They are chosen without a
    look at any table of pages."""
    return [(url, label) for label, words in ((1, UNWANTED_WORDS), (0, ORDINARY_WORDS)) for url in urls_of(hosts_of(words))]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_text(rule: Rule) -> str:
    return rule[1] + rule[2]


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(rule_text(r))):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        name, verdict = F.when(fits, rule_text(rule)).otherwise(name), F.when(fits, rule[0]).otherwise(verdict)
    return name, verdict


def ngrams(host: str, path: str, buckets: int = BUCKETS) -> np.ndarray:
    out = set()
    for space, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        if len(part) > 2:
            for k in SIZES:
                out.update(zlib.crc32(f"{space}{part[i : i + k]}".encode()) % buckets for i in range(len(part) - k + 1))
    return np.fromiter(out, np.int64, len(out))


def _split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    end = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    path = rest[end:]
    return rest[:end].lower(), path[: min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]


def train(table: Sequence[tuple[str, int]], buckets: int = BUCKETS, rounds: int = 40, rate: float = 0.5, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept, by adaptive gradient steps over the table in a fixed order. A feature
    vector is scaled to length 1, so that long urls don't weigh more."""
    rows = [(ngrams(*_split(url), buckets), label) for url, label in table]
    weights, seen, bias, seen_bias = np.zeros(buckets), np.full(buckets, 1e-8), 0.0, 1e-8
    order = sorted(range(len(rows)), key=lambda i: zlib.crc32(str(i).encode()))
    for _ in range(rounds):
        for i in order:
            x, label = rows[i]
            if not len(x):
                continue
            v = 1 / np.sqrt(len(x))
            error = 1 / (1 + np.exp(-(weights[x].sum() * v + bias))) - label
            g = error * v + l2 * weights[x]
            seen[x] += g * g
            weights[x] -= rate * g / np.sqrt(seen[x])
            seen_bias += error * error
            bias -= rate * error / np.sqrt(seen_bias)
    return weights, float(bias)


SCORED = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("p_block", pa.float64())])


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = tuple(RULES), table: Sequence[tuple[str, int]] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) of every row; reads only page_id and url."""
    weights, bias = train(table if table is not None else default_table(), buckets)
    shared = pages.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    url = F.col("url").cast("string")
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = match_rule(F.col("host"), F.col("path"), rules)
    parts = parts.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            p = []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                x = ngrams(host, path, buckets)
                p.append(float(1 / (1 + np.exp(-(w[x].sum() / np.sqrt(max(len(x), 1)) + bias)))))
            said = [v or ("block" if q >= 0.5 else "allow") for v, q in zip(batch.column("verdict").to_pylist(), p, strict=True)]
            kept = [batch.column(c) for c in ("page_id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(said, pa.string()), pa.array(p, pa.float64())], schema=SCORED)

    return parts.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, p_block double")
