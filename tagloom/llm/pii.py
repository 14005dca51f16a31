"""Personal data and the terms that reveal it (operator 2, native).

Patterns find the protected entities: e-mail addresses, IP addresses, card and phone numbers. Information-theoretic
sanitisation finds what gives them away: with N distinct texts, an entity e has the information content IC(e) = log2(N / df(e)),
and a term t that occurs with it discloses PMI(e, t) = IC(e) - log2(df(t) / df(e, t)) bits of it. All counts are of whole texts,
copies count once, and an entity of one text is scored like any other.

A term that discloses at least DISCLOSURE of IC(e) becomes a span wherever it stands in a text that holds e. In all other texts
it becomes one if it points at e by itself: it was met with e in SUPPORT texts or more, so that it is no chance neighbour, and
it leaves at most HIDDEN bits of e open, which is to say that at least every second text with the term holds e. Sanitising
generalises entities to their kind and removes such terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, row, small_side, table, unpacked, written
from .spans import MARK, SPAN, among, digest, let, listed, marked_spans, matches, of_kind, spliced, unmarked

KINDS = ("email", "ip", "card", "phone", "term")
EMAIL, IP, CARD, PHONE, TERM = range(5)

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: The patterns of the contract in forms that neither backtrack nor recurse on long runs: a run of local characters is tried
#: only from its first one or where the last match ended; a domain ends where no further label follows.
EMAIL_PATTERN = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++\.[{_LABEL}][.{_LABEL}]*?(?![{_LABEL}]|\.[{_LABEL}])"
IP_PATTERN = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Chains of digits with single separators, of 12 to 19 digits, between the ends of a chain.
CARD_PATTERN = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![0-9])(?![\x20-][0-9])"
PHONE_PATTERN = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: The share of an entity's information content from which a term is disclosive.
DISCLOSURE = 0.8
#: Texts that a term and an entity share, and bits that stay open, for a term to give the entity away without it.
SUPPORT, HIDDEN = 2, 1.0
#: A letter and the letters, marks and digits after it, with single apostrophes and hyphens between them; shorter ones aren't
#: terms.
TERM_PATTERN = r"\p{L}[\p{L}\p{M}\p{N}]*+(?:['-][\p{L}\p{M}\p{N}]++)*+"
LEAST_LENGTH = 3
#: Rows up to which terms or pairs are broadcast; beyond, joins are by shuffle.
MOST_ROWS = 200_000
#: Numbers of eight bytes that are broadcast at most.
MOST_HASHES = 1_000_000
#: Texts up to which their terms' spans are broadcast, and terms of a text up to which each word is compared with all of them.
MOST_TEXTS, MOST_COMPARED = 2_000, 64


def _luhn(digits: Column) -> Column:
    """Whether the digits of a string pass Luhn's check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _phone_ok(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


def base_spans(text: Column) -> Column:
    """All spans of the four kinds that pass their checks, of a text free of MARK."""
    email = matches(text, EMAIL_PATTERN, EMAIL, text.contains("@"))
    ip = F.filter(matches(text, IP_PATTERN, IP), lambda s: s["value"].rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"))
    card = F.filter(matches(text, CARD_PATTERN, CARD), lambda s: _luhn(_digits(s["value"])))
    phone = F.filter(matches(text, PHONE_PATTERN, PHONE, text.contains("+")), lambda s: _phone_ok(s["value"]))
    return F.concat(email, ip, card, phone)


def entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"].cast("string"), F.when(span["kind"].isin(CARD, PHONE), _digits(span["value"])).otherwise(F.lower(span["value"])))


def blanked(text: Column, spans: Column) -> Column:
    """The text in which NULs stand for the spans; positions stay."""

    def piece(s: Column, at: Column, cut) -> Column:
        begin = F.greatest(s["start"], at)
        return F.when(s["end"] > at, F.concat(cut(at, begin), F.repeat(F.lit("\0"), (s["end"] - begin).cast("int")))).otherwise("")

    return spliced(text, spans, piece)


def words_of(text: Column) -> Column:
    """Distinct lower-cased words of a text, short ones too."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0)))


def spans_of(blank: Column, terms: Column) -> Column:
    """The spans in a blanked text of the given terms, an ordered array. Only they are marked, so that few lengths are added up."""
    pieces = F.split(F.regexp_replace(blank, TERM_PATTERN, f"{MARK}$0{MARK}"), MARK, -1)
    has = lambda t, w: F.when(F.size(t) <= MOST_COMPARED, F.array_contains(t, w)).otherwise(among(t, w))
    marked = let(terms, lambda t: F.concat_ws("", F.transform(pieces, lambda x, i: F.when((i % 2 == 1) & has(t, F.lower(x)), F.concat(F.lit(MARK), x, F.lit(MARK))).otherwise(x))))
    return marked_spans(marked, TERM)


def key_of(text: Column) -> Column:
    return F.unhex(F.md5(text))


def spotted(docs: DataFrame) -> DataFrame:
    """tl_row, tl_key (a hash of the text), tl_spans and, of texts with some, tl_blank, of every row."""
    own = packed(docs).select("tl_row", unmarked(F.coalesce(row("text"), F.lit(""))).alias("tl_text"))
    own = own.select("tl_row", "tl_text", key_of(F.col("tl_text")).alias("tl_key"), base_spans(F.col("tl_text")).alias("tl_spans"))
    return own.select("tl_row", "tl_key", "tl_spans", F.when(F.size("tl_spans") > 0, blanked(F.col("tl_text"), F.col("tl_spans"))).alias("tl_blank"))


def texts_of(docs: DataFrame) -> DataFrame:
    """(tl_key, tl_text) of every row."""
    own = docs.select(unmarked(F.coalesce(F.col("text"), F.lit(""))).alias("tl_text"))
    return own.select(key_of(F.col("tl_text")).alias("tl_key"), "tl_text")


def counted(docs: DataFrame, wanted: DataFrame, copied: DataFrame) -> DataFrame:
    """(term, df_t): the distinct texts of the whole corpus that hold each wanted term. copied: (tl_key, copies) of repeated texts.

    A text of n copies adds 1 / n for each, so that counts are summed before the shuffle and nothing is sorted by text.
    """
    words = texts_of(docs).join(small_side(copied, MOST_ROWS), "tl_key", "left")
    words = words.select(F.explode(words_of(F.col("tl_text"))).alias("term"), (1.0 / F.coalesce("copies", F.lit(1))).alias("part"))
    # Hashes of the wanted terms, where they are few enough, spare the others the shuffle; the join after it is exact.
    hashed = wanted.select(F.xxhash64("term").alias("h")).distinct()
    if wanted.limit(MOST_HASHES + 1).count() <= MOST_HASHES:
        words = words.join(F.broadcast(hashed), F.xxhash64("term") == F.col("h"), "left_semi")
    return words.groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("df_t")).join(small_side(wanted, MOST_ROWS), "term", "left_semi")


def revealing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(tl_key, tl_own, tl_terms): the spans of disclosive terms of each text that has some; tl_own if it has entities too.

    All entities that stand in one text only have the same counts, so they are scored as one. df(e, t) <= df(e) bounds the
    df(t) of a disclosive term by df(e)^DISCLOSURE * n^(1 - DISCLOSURE), and by 2^HIDDEN * df(e); terms beyond are not paired.
    """
    sizes = written(found.groupBy("tl_key").agg(F.count("*").alias("copies")), "texts")
    n = float(max(sizes.count(), 1))
    copied = written(sizes.where("copies > 1"), "copied")
    keyed = found.where("tl_blank IS NOT NULL").groupBy("tl_key").agg(F.first("tl_spans").alias("spans"), F.first("tl_blank").alias("blank"))
    keyed = written(keyed.withColumn("k", F.monotonically_increasing_id()), "keyed")  # short numbers are shuffled instead of keys
    held = keyed.select("k", F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity"))
    entities = written(held.groupBy("entity").agg(F.count("*").alias("df_e")), "entities")
    terms = written(keyed.select("k", F.explode(words_of(F.col("blank"))).alias("term")).where(F.length("term") >= LEAST_LENGTH), "words")
    bound = F.greatest(F.pow(F.col("df_e"), DISCLOSURE) * n ** (1 - DISCLOSURE), F.col("df_e") * 2.0**HIDDEN) * 1.000001
    counts = counted(docs, written(terms.select("term").distinct(), "terms"), copied).where(F.col("df_t") <= (entities.agg(F.max(bound)).first()[0] or 0.0))
    rare = terms.join(small_side(written(counts, "rare"), MOST_ROWS), "term")
    many = small_side(entities.where("df_e > 1"), MOST_ROWS)
    who = F.coalesce(F.when(F.col("df_e").isNotNull(), F.col("entity")), F.concat(F.lit("key:"), F.col("k").cast("string")))
    own = held.join(many, "entity", "left").select("k", who.alias("who"), F.coalesce("df_e", F.lit(1)).alias("df_e")).distinct()
    pairs = written(own.join(rare, "k").where(F.col("df_t") <= bound), "pairs")
    ic = F.log2(F.lit(n) / F.col("df_e"))
    # A text's own terms have entities cut out, the corpus counts do not: df_t is never less than df_et.
    open_bits = F.log2(F.greatest(F.col("df_t"), F.col("df_et")) / F.col("df_et"))
    scored = pairs.groupBy("who", "term", "df_e", "df_t").agg(F.count("*").alias("df_et")).where(ic > 0)
    scored = written(scored.select("who", "term", "df_et", ((ic - open_bits) / ic).alias("disclosure"), open_bits.alias("open_bits")), "scored")
    strong = small_side(scored.where(F.col("disclosure") >= DISCLOSURE).select("who", "term"), MOST_ROWS)
    inside = pairs.join(strong, ["who", "term"], "left_semi").select("k", "term").distinct()
    inside = keyed.select("k", "tl_key").join(inside, "k").select("tl_key", "term")
    telling = written(scored.where((F.col("df_et") >= SUPPORT) & (F.col("open_bits") <= HIDDEN)).select("term").distinct(), "telling")
    outside = texts_of(docs).select("tl_key", F.explode(words_of(F.col("tl_text"))).alias("term")).join(small_side(telling, MOST_ROWS), "term", "left_semi")
    hidden = inside if telling.isEmpty() else inside.unionByName(outside.select("tl_key", "term"))
    hidden = written(hidden.groupBy("tl_key").agg(F.array_sort(F.collect_set("term")).alias("terms")), "hidden")
    blanks = keyed.select("tl_key", "blank").join(hidden, "tl_key").select("tl_key", F.lit(True).alias("tl_own"), "blank", "terms")
    if not telling.isEmpty():
        others = written(hidden.join(keyed.select("tl_key"), "tl_key", "left_anti"), "others")
        texts = texts_of(docs).join(small_side(others.select("tl_key"), MOST_ROWS), "tl_key", "left_semi").groupBy("tl_key").agg(F.min("tl_text").alias("blank"))
        blanks = blanks.unionByName(texts.join(others, "tl_key").select("tl_key", F.lit(False).alias("tl_own"), "blank", "terms"))
    return blanks.select("tl_key", "tl_own", spans_of(F.col("blank"), F.col("terms")).alias("tl_terms")).where(F.size("tl_terms") > 0)


def _with_terms(found: DataFrame, terms: DataFrame) -> DataFrame:
    """found with tl_terms.

    Few terms are joined by broadcast. Else texts with entities are dealt out by their hash; of the others only those that may
    hold a term, told by short hashes that are broadcast while they are at most MOST_HASHES.
    """
    none = F.array().cast(SPAN)

    def joined(rows: DataFrame, own: DataFrame) -> DataFrame:
        right = small_side(own.select(F.col("tl_key").alias("tl_of"), "tl_terms"), MOST_TEXTS)
        return rows.join(right, F.col("tl_key") == F.col("tl_of"), "left").drop("tl_of").withColumn("tl_terms", F.coalesce("tl_terms", none))

    if terms.limit(MOST_TEXTS + 1).count() <= MOST_TEXTS:
        return joined(found, terms)
    bare, others = found.where("tl_blank IS NULL"), terms.where("NOT tl_own")
    owners = joined(found.where("tl_blank IS NOT NULL"), terms.where("tl_own"))
    if others.limit(MOST_HASHES + 1).count() > MOST_HASHES:
        return owners.unionByName(joined(bare, others))
    hashes = F.broadcast(others.select(F.xxhash64("tl_key").alias("tl_hash")).distinct())
    hit = F.xxhash64("tl_key") == F.col("tl_hash")
    clean = bare.join(hashes, hit, "left_anti").withColumn("tl_terms", none)
    return owners.unionByName(clean).unionByName(joined(bare.join(hashes, hit, "left_semi"), others))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base spans (tl_spans) and spans of disclosive terms (tl_terms) of every row, from its whole text.

    Null texts count as empty; texts without personal data have spans of such terms only as give away an entity of others.
    Repeated rows give repeated results and count once in all statistics, as equal texts do; an empty table gives an empty
    result; columns besides doc_id and text are not read.
    """
    own = docs.select("doc_id", "text")
    found = written(spotted(own).select(F.struct(row("doc_id").alias("doc_id")).alias("tl_row"), "tl_key", "tl_spans", "tl_blank"), "spotted")
    terms = written(revealing(own, found), "revealing")
    return _with_terms(found, terms).select(row("doc_id").alias("doc_id"), "tl_spans", "tl_terms")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span of an entity generalised to its kind in brackets, and each span of a term removed."""
    names = F.array(*[F.lit(f"[{k}]" if k != "term" else "[...]") for k in KINDS])
    return spliced(text, spans, lambda s, at, cut: F.when(s["start"] >= at, F.concat(cut(at, s["start"]), F.get(names, s["kind"]))).otherwise(""))


def sanitise(docs: DataFrame) -> DataFrame:
    """All documents and columns, with personal data generalised and disclosive terms removed from text; null texts stay null.

    Empty texts and texts without spans stay as they are; repeated rows stay repeated and count once in all statistics; an
    empty table gives an empty one. Rows are written once beside their spans, which are found once.
    """
    found = written(spotted(docs), "spotted")
    terms = written(revealing(found.select(row("text").alias("text")), found), "revealing")
    spans = F.concat("tl_spans", "tl_terms")
    return unpacked(_with_terms(found, terms), docs.columns, text=masked(row("text"), spans))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data; the cases of find_personal_data hold."""
    out = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [of_kind(F.col("tl_spans"), i).alias(f"n_{KINDS[i]}") for i in range(4)]
    return out.select("doc_id", *counts, digest(F.col("tl_spans"), KINDS).alias("base_sha256"), listed(F.concat("tl_spans", "tl_terms"), KINDS).alias("spans"))
