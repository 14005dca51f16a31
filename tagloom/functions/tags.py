"""Tag text: namespaces, wildcards, creator names, computed meta tags and query strings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces of each category; any other namespace is general.
NAMESPACES = {
    "creator": "ARTIST", "artist": "ARTIST", "drawn_by": "ARTIST",
    "character": "CHARACTER", "char": "CHARACTER", "person": "CHARACTER",
    "series": "COPYRIGHT", "copyright": "COPYRIGHT", "franchise": "COPYRIGHT", "parody": "COPYRIGHT",
    "meta": "META", "medium": "META", "rating": "META", "source": "META",
}

# Wildcard limits.
MIN_LITERALS, WILDCARD_CAP = 2, 500


def tag_category(raw: Column) -> Column:
    """The category of 'namespace:name', GENERAL for an unknown namespace or none."""
    space = F.lower(F.trim(F.substring_index(raw, ":", 1)))
    known = F.create_map(*[F.lit(x) for kv in NAMESPACES.items() for x in kv])
    name = F.trim(F.regexp_replace(raw, r"(?s)^[^:]*:", ""))
    return F.when(raw.contains(":") & (name != ""), F.coalesce(known[space], F.lit("GENERAL"))).otherwise("GENERAL")


def tag_name(raw: Column) -> Column:
    """The trimmed name after a known namespace; general tags keep their whole text."""
    return F.when(tag_category(raw) == "GENERAL", raw).otherwise(F.trim(F.regexp_replace(raw, r"(?s)^[^:]*:", "")))


def valid_creator(name: Column) -> Column:
    """Not only digits, and not a generated account name."""
    return ~name.rlike("^[0-9]+$") & ~name.rlike(r"(?i)^user[\s_]*[a-z]{4}[0-9]{4}$")


def like_escape(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def wildcard_like(pattern: str) -> str:
    return like_escape(pattern).replace("*", "%")


def wildcard_error(pattern: str) -> str | None:
    """Why a wildcard pattern is refused, if it is."""
    literals = pattern.replace("*", "").strip()
    if not literals:
        return "a pattern needs more than wildcards"
    return f"a pattern needs {MIN_LITERALS} characters besides wildcards" if len(literals) < MIN_LITERALS else None


def meta_tag(name: str) -> Column:
    """The condition of a computed tag over the columns of items, with SQL's three-valued logic."""
    mime, w, h, o = F.col("mime_type"), F.col("width"), F.col("height"), F.col("orientation")
    return {
        "video": mime.startswith("video/"),
        "animated": mime.isin("image/gif", "image/apng"),
        "portrait": o == "portrait",
        "landscape": o == "landscape",
        "square": o == "square",
        "highres": (w >= 1920) | (h >= 1920),
        "lowres": w.isNotNull() & h.isNotNull() & (w <= 500) & (h <= 500),
        "favorite": F.col("is_favourite"),
    }[name]


META_TAGS = ("video", "animated", "portrait", "landscape", "square", "highres", "lowres", "favorite")
# Descriptions, which are searched like names.
META_TEXT = {
    "video": "Video files (mp4, webm, etc.)",
    "animated": "Animated images (GIF, APNG)",
    "portrait": "Taller than wide",
    "landscape": "Wider than tall",
    "square": "Equal width and height",
    "highres": "Full HD or higher (1920px+)",
    "lowres": "Low resolution (500px or less)",
    "favorite": "Posts you have favorited",
}


def without_meta(name: str, null_mode: str = "keep") -> Column:
    """The negation of a computed tag. keep: rows of unknown type or orientation stay; sql: they go. highres always drops them."""
    cond = meta_tag(name)
    if null_mode == "keep" and name in ("video", "animated", "portrait", "landscape", "square"):
        return F.coalesce(~cond, F.lit(True))
    return ~cond


def search_meta(text: str) -> list[str]:
    """The computed tags whose name or description holds the text."""
    text = text.lower()
    return [n for n in META_TAGS if text in n or text in META_TEXT[n].lower()]


@dataclass
class Query:
    """A parsed list of search terms."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    like: list[str] = field(default_factory=list)
    not_like: list[str] = field(default_factory=list)
    meta: list[str] = field(default_factory=list)
    not_meta: list[str] = field(default_factory=list)
    error: str | None = None

    @property
    def empty(self) -> bool:
        return not (self.include or self.exclude or self.like or self.not_like or self.meta or self.not_meta)


def parse_terms(text: str) -> Query:
    """Comma-separated terms; '-' in front negates, '*' is a wildcard, names of computed tags are those. '-' alone is dropped."""
    out = Query()
    for term in (t.strip() for t in text.split(",")):
        negated = term.startswith("-")
        name = term[1:].strip() if negated else term
        if not name:
            continue
        if name.lower() in META_TAGS:
            (out.not_meta if negated else out.meta).append(name.lower())
        elif "*" in name:
            out.error = out.error or wildcard_error(name)
            (out.not_like if negated else out.like).append(name)
        else:
            (out.exclude if negated else out.include).append(name)
    return out


def refine(terms: list[str], tag: str, negated: bool = False) -> list[str]:
    """Terms with the tag added; it takes the place of the same tag in either polarity, whatever its case."""
    rest = [t for t in terms if t.lstrip("-").lower() != tag.lower()]
    return [*rest, f"-{tag}" if negated else tag]


def positive_int(raw: str | None, fallback: int, most: int) -> int:
    """The leading integer of a parameter, the fallback if there is none or zero, between 1 and most."""
    m = re.match(r"\s*([+-]?\d+)", raw or "")
    return min(max(1, (int(m[1]) if m else 0) or fallback), most)


def min_score(raw: float | None) -> float | None:
    """Between -1 and 1; none if not a finite number."""
    if raw is None or raw != raw or raw in (float("inf"), float("-inf")):
        return None
    return min(1.0, max(-1.0, raw))
