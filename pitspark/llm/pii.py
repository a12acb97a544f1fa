"""Personal data: proposed by regular expressions, confirmed by checksums, weighed by the words around.

Each kind has a proposer, a validator and a prior. A proposed span that its validator refuses is gone (no other
match is tried in its place). Words near it, in four languages, raise or lower its score; they are looked up in
the ``BEFORE`` characters before and ``AFTER`` characters behind the span.

* Base kinds (``email``, ``ip``, ``card``, ``phone``) are kept whatever their score: leftmost matches that don't
  overlap within a kind; parts of an ip are at most 255, cards have 13 to 19 digits and pass Luhn, phones 9 to 15
  digits. The score says how sure it is.
* Other kinds need a score of ``LEAST``: ``iban`` (mod-97), ``national_id`` (number blocks that are issued, only
  beside a word that names one), ``secret`` (a long token of letters and digits beside a word such as password),
  ``access_key`` (key ids of a fixed form). Those that overlap a base span are left to it.

Positions are code points, ends exclusive. All scans are linear in the text. Texts are whole, however long; null
and empty ones have no spans. Rows are independent: repeated rows, ties and null ids need nothing special, other
columns may have any names, an empty table gives an empty one."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.llm.batches import docs_only, pieces

BEFORE, AFTER = 40, 20
LEAST = 0.5
NEAR, AGAINST = 0.35, 0.3
ENTROPY = 2.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(r"[0-9]++(?:[ .-][0-9]++)*+")
_FOUR = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_GROUPED = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_TAX = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{12,}+")
_KEY_ID = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])")
_ANY = re.compile(rb"[0-9@]")
_WORD = re.compile(r"[^\W\d_]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards: to the left as far as the last match allows, to the right by the domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            free = domain.end()
            yield start, free
        at = text.find("@", at + 1)


def _in_numbers(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    """Matches inside stretches of digits and single separators, which no match of ``pattern`` leaves."""

    def proposed(text: str) -> Iterator[tuple[int, int]]:
        for stretch in _NUMBERS.finditer(text):
            for m in pattern.finditer(text, stretch.start(), stretch.end()):
                yield m.span()

    return proposed


def _matches(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


def _digits(span: str) -> str:
    return re.sub(r"[^0-9]", "", span)


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, digits of the products summed: a multiple of ten."""
    values = [int(c) for c in reversed(digits)]
    return sum(values[::2] + [d * 2 - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def mod_97(account: str) -> bool:
    """The first four characters moved to the end, letters as 10 to 35: the number leaves 1."""
    rest = 0
    for c in account[4:] + account[:4]:
        value = int(c, 36)
        rest = (rest * (100 if value > 9 else 10) + value) % 97
    return rest == 1


def _is_ip(span: str) -> bool:
    return all(len(part := p.lstrip("0")) <= 3 and int(part or "0") <= 255 for p in span.split("."))


def _is_card(span: str) -> bool:
    return 13 <= len(digits := _digits(span)) <= 19 and luhn(digits)


def _is_iban(span: str) -> bool:
    return 15 <= len(account := span.replace(" ", "")) <= 34 and mod_97(account)


def _is_national(span: str) -> bool:
    area, group, serial = span.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def _is_token(span: str) -> bool:
    """Letters and digits mixed, of some variety: repeated or plain words are no secrets."""
    if not (re.search(r"[0-9]", span) and re.search(r"[A-Za-z]", span)):
        return False
    parts = [span.count(c) / len(span) for c in set(span)]
    return -sum(p * log2(p) for p in parts) >= ENTROPY


@dataclass(frozen=True)
class Kind:
    name: str
    propose: Callable[[str], Iterator[tuple[int, int]]]
    valid: Callable[[str], bool]
    prior: float
    base: bool = False
    near: frozenset = field(default_factory=frozenset)
    against: frozenset = field(default_factory=frozenset)


def _words(text: str) -> frozenset:
    return frozenset(text.split())


_NO_DATA = _words("version release section chapter order isbn invoice serial model example kapitel bestellung seite versión capítulo pedido commande chapitre checksum hash commit")

KINDS = (
    Kind("email", emails, lambda _: True, 0.9, True, _words("mail email e contact write courriel correo kontakt")),
    Kind("ip", _in_numbers(_FOUR), _is_ip, 0.6, True, _words("ip address host server adresse dirección servidor serveur login"), _NO_DATA),
    Kind("card", _in_numbers(_GROUPED), _is_card, 0.8, True, _words("card credit visa mastercard amex karte kreditkarte carte tarjeta payment"), _NO_DATA),
    Kind("phone", _matches(_DIALLED), lambda s: 9 <= len(_digits(s)) <= 15, 0.75, True, _words("phone tel call mobile fax telefon handy téléphone teléfono móvil cell"), _NO_DATA),
    Kind("iban", _matches(_IBAN), _is_iban, 0.85, False, _words("iban account bank konto compte cuenta")),
    Kind("national_id", _matches(_TAX), _is_national, 0.3, False, _words("ssn social security sozialversicherung sécurité seguridad"), _NO_DATA),
    Kind("secret", _matches(_TOKEN), _is_token, 0.3, False, _words("password passwd pwd passwort contraseña token secret apikey key credential credentials"), _NO_DATA),
    Kind("access_key", _matches(_KEY_ID), _is_token, 0.8),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _score(kind: Kind, text: str, start: int, end: int) -> float:
    around = {w.lower() for w in _WORD.findall(text[max(0, start - BEFORE) : start]) + _WORD.findall(text[end : end + AFTER])}
    return round(min(1.0, max(0.0, kind.prior + NEAR * bool(around & kind.near) - AGAINST * bool(around & kind.against))), 3)


def spans_of(raw: bytes | None) -> list[dict]:
    """All spans of a text by kind, in the order of KINDS, then by start."""
    if not raw or not _ANY.search(raw):
        return []
    text, found = raw.decode(), []
    for kind in KINDS:
        base = [(x["start"], x["end"]) for x in found if x["base"]] if not kind.base else []
        for start, end in kind.propose(text):
            if kind.valid(text[start:end]):
                score = _score(kind, text, start, end)
                if kind.base or score >= LEAST and not any(a < end and start < b for a, b in base):
                    found.append({"kind": kind.name, "start": start, "end": end, "score": score, "base": kind.base})
    return found


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])
_SPANS = "array<struct<kind: string, start: long, end: long, score: double, base: boolean>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row; spans: (kind, start, end, score, base) by kind, then start."""
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([spans_of(t) for t in texts], pa.list_(_SPAN))], schema=schema)

    return docs_only(docs).mapInArrow(run, f"doc_id long, spans {_SPANS}")


def masked(raw: bytes | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    if raw is None:
        return None
    text, out, at = raw.decode(), [], 0
    for x in sorted(spans_of(raw), key=lambda x: (x["start"], -x["end"])):
        if x["start"] >= at:
            out += [text[at : x["start"]], f"<{x['kind']}>"]
            at = x["end"]
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the spans masked."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([masked(t) for t in texts], pa.string())], schema=schema)

    return docs_only(docs).mapInArrow(run, "doc_id long, text string")


def span_digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_ of each base kind, base_sha256, spans) where spans are written kind:start:end."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of_kind = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
