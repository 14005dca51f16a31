"""Titles that number their pages, and what groups them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand before a number, and the longest key in bytes.
SEQUENCE_WORDS = "part|page|p|pg|no|#|chapter|chap|ch|volume|vol|v|episode|ep|e"
KEY_BYTES, KEY_PREFIX = 240, "title-sha256:"

# Endings that number a page, all stripped one after the other.
STRIP = (
    r"\s*\d+\s*/\s*\d+\s*$",
    r"\s*\(\s*\d+\s*\)\s*$",
    r"\s*\[\s*\d+\s*\]\s*$",
    r"\s*[-_]\s*\d+\s*$",
    rf"(?i)\s+(?:{SEQUENCE_WORDS})\s*\.?\s*\d+\s*$",
    rf"(?i)\s*[-_]\s*(?:{SEQUENCE_WORDS})\s*\.?\s*\d+\s*$",
    r"\s+0*\d{1,3}\s*$",
    r"\s*(?:その|第)\s*\d+\s*(?:話|章|部)?\s*$",
)

# Where the number stands; the first that matches gives it.
NUMBER = (
    r"(\d+)\s*/\s*\d+\s*$",
    r"\(\s*(\d+)\s*\)\s*$",
    r"\[\s*(\d+)\s*\]\s*$",
    rf"(?i)[-_]\s*(?:{SEQUENCE_WORDS})\s*\.?\s*(\d+)\s*$",
    rf"(?i)(?:{SEQUENCE_WORDS})\s*\.?\s*(\d+)\s*$",
    r"[-_]\s*(\d+)\s*$",
    r"\s+0*(\d{1,3})\s*$",
    r"(?:その|第)\s*(\d+)",
)


def title_number(title: Column) -> Column:
    """The number that a title ends in, 0 without one."""
    found = [F.nullif(F.regexp_extract(F.trim(title), p, 1), F.lit("")) for p in NUMBER]
    return F.coalesce(F.coalesce(*found).cast("long"), F.lit(0).cast("long"))


def base_title(title: Column) -> Column:
    """The title without its numbering, with single spaces; empty if nothing else is in it."""
    out = F.trim(title)
    for p in STRIP:
        out = F.regexp_replace(out, p, "")
    return F.regexp_replace(F.trim(out), r"\s+", " ")


def title_key(base: Column) -> Column:
    """The lower-cased base title, or its hash if that has too many bytes."""
    low = F.lower(base)
    return F.when(F.octet_length(low) > KEY_BYTES, F.concat(F.lit(KEY_PREFIX), F.sha2(low, 256))).otherwise(low)
