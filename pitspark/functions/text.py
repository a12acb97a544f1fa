"""Text helpers built from Spark's own string and regex functions; they always see the whole text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitspark import params


WHITE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"  # every Unicode white-space character


def strip_html(html: Column) -> Column:
    """Tags become one blank, then every run of white space becomes one blank."""
    return F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), WHITE + "+", " ")


def stripped(text: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def extract_share(text: Column, pattern: str = params.SHARE_PATTERN) -> Column:
    """First percentage matched by ``pattern`` that lies in 5..100, as a fraction; else NULL."""
    found = F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(1))
    shares = F.transform(found, lambda s: s.try_cast("double") / 100.0)
    return F.try_element_at(F.filter(shares, lambda x: (x >= 0.05) & (x <= 1.0)), F.lit(1))


def json_object_text(text: Column) -> Column:
    """The JSON object inside a noisy reply: reasoning blocks and code fences are dropped, then
    the span from the first opening to the last closing brace is kept. NULL when there is none."""
    t = stripped(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    fence = F.lit("```")
    inner = F.regexp_replace(F.try_element_at(F.split(t, fence, -1), F.lit(2)), "^json", "")
    t = F.when(t.startswith("```"), inner).otherwise(t)
    return F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit(""))


def article_key(url: Column) -> Column:
    """Last 32 characters of the address; NULL for an empty one."""
    return F.nullif(F.substring(url, -32, 32), F.lit(""))


def log_safe(text: Column) -> Column:
    """Commas become semicolons and line feeds blanks, so that one message stays one log field."""
    return F.translate(text, ",\n", "; ")
