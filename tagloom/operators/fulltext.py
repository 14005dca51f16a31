"""Full-text search of notes and group titles: boolean queries with phrases and prefixes, cover-density rank, headlines.

Words are runs of letters and digits, lower-cased; e-mails, urls and hyphenated compounds are not words of their own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLIT = r"[^\p{L}\p{N}]+"
PAGE_SIZE = 48
#: Weight of a cover, and words and fragments of a headline.
COVER_WEIGHT, MOST_WORDS, MOST_FRAGMENTS = 0.1, 50, 2


def words(text: Column) -> Column:
    """Words of the text in order; null for a null text."""
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


def parse(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of conjunctions of (negated, words): quotes make a phrase, 'or' parts alternatives, '-' negates."""
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for negated, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if not phrase and word.lower() == "or" and not negated:
            if out[-1]:
                out.append([])
            continue
        parts = [w for w in re.split(r"[\W_]+", (phrase or word).lower()) if w]
        if parts:
            out[-1].append((bool(negated), parts))
    return [c for c in out if c]


def _hit(word: Column, term: str, prefix: bool) -> Column:
    return word.startswith(term) if prefix else word == term


def _phrase(ws: Column, terms: list[str], prefix: bool) -> Column:
    """Whether the terms stand in a row: one search of the words joined by spaces."""
    line = F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
    if prefix:
        return line.rlike("".join(rf" {re.escape(t)}[^ ]*" for t in terms) + " ")
    return line.contains(" " + " ".join(terms) + " ")


def matches(ws: Column, query: str, prefix: bool = True) -> Column:
    """Whether the words match; false for a query without words. With prefix, each term matches the words it begins."""
    out = F.lit(False)
    for part in parse(query):
        ok = F.lit(True)
        for negated, terms in part:
            has = F.exists(ws, lambda w: _hit(w, terms[0], prefix)) if len(terms) == 1 else _phrase(ws, terms, prefix)
            ok = ok & (~has if negated else has)
        out = out | ok
    return F.coalesce(out, F.lit(False))


def rank(ws: Column, query: str, prefix: bool = True) -> Column:
    """Cover density: the sum, over the minimal stretches that satisfy an alternative, of a weight over one plus the words in the
    stretch that match nothing. The alternatives of the query add up; one that asks for all that another does is left out."""
    wanted = {frozenset(t for negated, ts in part if not negated for t in ts) for part in parse(query)} - {frozenset()}
    least = sorted(sorted(x) for x in wanted if not any(y < x for y in wanted))
    single = [terms[0] for terms in least if len(terms) == 1]
    # Each hit of a word that is an alternative by itself is a stretch.
    total = F.aggregate(ws, F.lit(0.0), lambda s, w: s + sum((F.when(_hit(w, t, prefix), COVER_WEIGHT).otherwise(0.0) for t in single), F.lit(0.0))) if single else F.lit(0.0)
    return sum((_covers(ws, terms, prefix) for terms in least if len(terms) > 1), total)


def _covers(ws: Column, terms: list[str], prefix: bool) -> Column:
    which = lambda w: F.coalesce(*[F.when(_hit(w, t, prefix), F.lit(i)) for i, t in enumerate(terms)])
    hits = F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("at"), which(w).alias("t"))), lambda h: h["t"].isNotNull())
    hits = F.transform(hits, lambda h, i: F.struct(h["at"].alias("at"), h["t"].alias("t"), i.alias("n")))
    never = F.array(*[F.lit(-1)] * len(terms))
    zero = F.struct(never.alias("last"), never.alias("nth"), F.lit(-1).alias("from"), F.lit(0.0).alias("sum"))

    def step(acc: Column, h: Column) -> Column:
        last = F.transform(acc["last"], lambda v, i: F.when(i == h["t"], h["at"]).otherwise(v))
        nth = F.transform(acc["nth"], lambda v, i: F.when(i == h["t"], h["n"]).otherwise(v))
        now = F.struct(last.alias("last"), nth.alias("nth"))
        return _bound(now, lambda x: _bound(F.struct(x["last"].alias("last"), x["nth"].alias("nth"), F.array_min(x["last"]).alias("start")), lambda y: grown(acc, h, y)))

    def grown(acc: Column, h: Column, x: Column) -> Column:
        new = (x["start"] >= 0) & (x["start"] > acc["from"])  # a cover begins where its earliest latest term stands
        others = h["at"] - x["start"] - (h["n"] - F.array_min(x["nth"]))
        return F.struct(x["last"].alias("last"), x["nth"].alias("nth"), F.when(new, x["start"]).otherwise(acc["from"]).alias("from"), (acc["sum"] + F.when(new, COVER_WEIGHT / (1 + others)).otherwise(0.0)).alias("sum"))

    return F.aggregate(hits, zero, step, lambda acc: acc["sum"])


def headline(text: Column, query: str) -> Column:
    """Fragments of the text with the matched beginnings of words in <mark>; other markup is escaped."""
    terms = sorted({t for part in parse(query) for negated, ts in part if not negated for t in ts}, key=len, reverse=True)
    plain = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    if not terms:
        return plain
    pattern = r"(?i)(?<![\p{L}\p{N}])(" + "|".join(re.escape(t) for t in terms) + ")"
    half = MOST_WORDS // (2 * MOST_FRAGMENTS)

    def fragments(pieces: Column, at: Column) -> Column:
        first = F.coalesce(F.get(at, F.lit(0)), F.lit(0))
        second = F.get(F.filter(at, lambda i: i > first + half), F.lit(0))
        cut = lambda c: F.array_join(F.slice(pieces, F.greatest(c - half, F.lit(0)) + 1, 2 * half), " ")
        return F.concat_ws(" ... ", cut(first), F.when(second.isNotNull(), cut(second)))

    hits = lambda pieces: F.filter(F.transform(pieces, lambda w, i: F.when(w.rlike(pattern), i)), lambda i: i.isNotNull())
    shown = _bound(F.split(plain, r"\s+"), lambda pieces: _bound(hits(pieces), lambda at: fragments(pieces, at)))
    return F.regexp_replace(shown, pattern, "<mark>$1</mark>")


def _bound(value: Column, f) -> Column:
    """f(value) with value worked out once, however often f uses it: an array of one element binds it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def search_notes(note: DataFrame, translation: DataFrame, grp: DataFrame, grp_item: DataFrame, item: DataFrame, query: str, page: int = 1) -> DataFrame:
    """(result_type, id, item_id, rank, total, headline): a page of notes and groups whose text or translation matches.

    A group counts if a member stands at position 0. Of several matching texts of one note or group the best ranked shows.
    """
    if len(query.strip()) < 2:
        return note.limit(0).select(F.lit("note").alias("result_type"), "id", "item_id", F.lit(0.0).alias("rank"), F.lit(0).cast("long").alias("total"), F.lit("").alias("headline"))
    own = note.join(item.select(F.col("id").alias("item_id"), "imported_at"), "item_id").select(F.lit("note").alias("result_type"), "id", "item_id", "imported_at", "content_hash", F.col("content").alias("shown"))
    first = grp_item.where("position = 0").select("group_id", "item_id").join(item.select(F.col("id").alias("item_id"), "imported_at"), "item_id")
    titles = grp.where("title IS NOT NULL").join(first, F.col("id") == F.col("group_id")).select(F.lit("group").alias("result_type"), "id", "item_id", "imported_at", F.col("title_hash").alias("content_hash"), F.col("title").alias("shown"))
    both = own.unionByName(titles)
    translated = both.join(translation, "content_hash").withColumn("shown", F.col("translated_content")).drop("translated_content")
    found = both.unionByName(translated.select(*both.columns)).withColumn("ws", words(F.col("shown"))).where(matches(F.col("ws"), query))
    scored = found.withColumn("rank", F.round(rank(F.col("ws"), query), 6)).drop("ws", "content_hash")
    best = Window.partitionBy("result_type", "id").orderBy(F.desc("rank"), "item_id", "shown")
    one = scored.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")
    total = one.agg(F.count("*").alias("total"))
    top = one.orderBy(F.desc("rank"), F.desc("imported_at"), "result_type", "id").offset((page - 1) * PAGE_SIZE).limit(PAGE_SIZE)
    return top.crossJoin(F.broadcast(total)).select("result_type", "id", "item_id", "rank", "total", headline(F.col("shown"), query).alias("headline"))  # total is one row


def items_with_note(note: DataFrame, query: str) -> DataFrame:
    """id of the items with a note whose content or name matches whole words of the query."""
    hit = matches(words(F.col("content")), query, prefix=False) | matches(words(F.col("name")), query, prefix=False)
    return note.where(hit).select(F.col("item_id").alias("id")).distinct()
