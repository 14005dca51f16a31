"""The listing that a detail page was entered from, as its url parameters tell."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urlencode

# Sorts of the gallery, and the form of a rotation seed.
SORTS = ("newest", "oldest", "random")
SEED = "[a-z0-9]{8}"


@dataclass(frozen=True)
class Listing:
    kind: str
    tags: tuple[str, ...] = ()
    sort: str = "newest"
    seed: str | None = None
    page: int = 1

    def query(self) -> str:
        """The parameters that parse() reads back; the first page is left out."""
        own = {"ctx": self.kind} | ({"tags": ",".join(self.tags)} if self.kind == "search" else {"sort": self.sort} | ({"seed": self.seed} if self.seed else {}))
        return urlencode(own | ({"page": self.page} if self.page > 1 else {}))


def parse(params: dict[str, str]) -> Listing | None:
    """None without a listing: no tags for a search, or no sound seed for the random order."""
    raw = params.get("page", "")
    page = int(raw) if re.fullmatch(r"\d+", raw) and int(raw) > 1 else 1
    if params.get("ctx") == "search":
        tags = tuple(t for t in (x.strip().lower() for x in params.get("tags", "").split(",")) if t)
        return Listing("search", tags=tags, page=page) if tags else None
    if params.get("ctx") != "gallery":
        return None
    sort = params.get("sort", "")
    if sort != "random":
        return Listing("gallery", sort=sort if sort in SORTS else "newest", page=page)
    seed = params.get("seed", "")
    return Listing("gallery", sort="random", seed=seed, page=page) if re.fullmatch(SEED, seed) else None
