"""Secret scans with multipart credential linking (operator 7, native).

Strong patterns are reported wherever they stand. Weak candidates (tokens that look random, named identifiers, endpoints) are
reported only where complementary parts co-occur: an interval join on cells of SCOPE code points brings together the parts of
a text that lie within SCOPE of each other. As parts of one role don't overlap, a cell holds a bounded number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, written
from .spans import SPAN, apart, digest, listed, matches, of_kind, unmarked

KINDS = ("assign", "access", "hex", "weak_secret", "identifier", "endpoint")
ASSIGN, ACCESS, HEX, WEAK, IDENTIFIER, ENDPOINT = range(6)

#: Forms of the contract's patterns that never give back what they took.
ASSIGN_PATTERN = r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
ACCESS_PATTERN = r"AKIA[A-Z0-9]{14,}+"
HEX_PATTERN = r"[0-9a-f]{16,}+"
#: Weak parts: runs of 16 token characters or more, also after a name and '=', values of identifier names, and urls or host
#: settings.
WEAK_PATTERN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])"
IDENTIFIER_PATTERN = r"""(?i:access_?key_?id|client_?id|user_?name|user|login|account_?id)["']?+\x20*+[:=]\x20*+["']?+[A-Za-z0-9_.@-]{3,}+"""
ENDPOINT_PATTERN = r"""(?:https?|jdbc:[a-z0-9]+|ftp|ssh|postgres|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]++|(?i:host|server|endpoint|base_?url)["']?+\x20*+[:=]\x20*+["']?+[A-Za-z0-9.-]+\.[A-Za-z0-9.:-]+"""

#: Code points within which parts belong together, and the least distinct characters of a token that looks random.
SCOPE, DISTINCT_CHARS = 160, 9

SECRET, ID, PLACE = 0, 1, 2
ROLE_OF_KIND = {ASSIGN: SECRET, ACCESS: ID, HEX: SECRET, WEAK: SECRET, IDENTIFIER: ID, ENDPOINT: PLACE}


def base_spans(text: Column) -> Column:
    """The strong spans: assignments with a value of 12 characters or more, access keys, long runs of hex digits."""
    assign = F.filter(matches(text, ASSIGN_PATTERN, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN_PATTERN, 1)) >= 12)
    return F.concat(assign, matches(text, ACCESS_PATTERN, ACCESS, text.contains("AKIA")), matches(text, HEX_PATTERN, HEX))


def weak_spans(text: Column, strong: Column) -> Column:
    """Weak parts that no strong span overlaps."""
    # A digit and a letter: UUIDs, lower-case and base32 keys count; whether they are reported is for their complement to say.
    looks_random = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(s["value"], ""))) >= DISTINCT_CHARS)
    found = F.concat(F.filter(matches(text, WEAK_PATTERN, WEAK), looks_random), matches(text, IDENTIFIER_PATTERN, IDENTIFIER), matches(text, ENDPOINT_PATTERN, ENDPOINT))
    return apart(found, strong)


def spotted(docs: DataFrame) -> DataFrame:
    """doc_id, tl_strong, tl_weak and tl_key of every row; rows of equal doc_id and parts share a key."""
    own = docs.select("doc_id", unmarked(text_or_empty()).alias("text")).select("doc_id", "text", base_spans(F.col("text")).alias("tl_strong"))
    own = own.select("doc_id", "tl_strong", weak_spans(F.col("text"), F.col("tl_strong")).alias("tl_weak"))
    key = F.md5(F.concat_ws("\0", F.col("doc_id").cast("string"), listed(F.concat("tl_strong", "tl_weak"), KINDS)))
    return own.select("doc_id", "tl_strong", "tl_weak", F.when(F.size("tl_weak") > 0, key).alias("tl_key"))


def linked(found: DataFrame) -> DataFrame:
    """(tl_key, tl_linked): the weak spans whose complementary parts lie within SCOPE of them.

    A secret needs an identifier or an endpoint, an identifier needs a secret, and an endpoint needs both.
    """
    role = F.create_map(*[F.lit(x) for kv in ROLE_OF_KIND.items() for x in kv])
    cell = lambda at: F.floor(at / SCOPE)
    keyed = found.where("tl_key IS NOT NULL").dropDuplicates(["tl_key"])
    parts = keyed.select("tl_key", F.explode(F.concat("tl_strong", "tl_weak")).alias("s"))
    parts = parts.select("tl_key", role[F.col("s.kind")].alias("p_role"), F.col("s.start").alias("p_start"), F.col("s.end").alias("p_end"))
    parts = parts.select("*", F.explode(F.sequence(cell(F.col("p_start")), cell(F.col("p_end")))).alias("cell"))
    weak = keyed.select("tl_key", F.explode("tl_weak").alias("w"))
    near = F.sequence(cell(F.col("w.start")) - 1, cell(F.col("w.end")) + 1)
    weak = weak.select("tl_key", "w", F.explode(near).alias("cell"))
    gap = F.greatest(F.col("p_start") - F.col("w.end"), F.col("w.start") - F.col("p_end"), F.lit(0))
    met = weak.join(parts, ["tl_key", "cell"]).where(gap <= SCOPE)
    roles = met.groupBy("tl_key", "w").agg(*[F.max(F.col("p_role") == r).alias(f"r{r}") for r in (SECRET, ID, PLACE)])
    kind = F.col("w.kind")
    complete = F.when(kind == WEAK, F.col(f"r{ID}") | F.col(f"r{PLACE}")).when(kind == IDENTIFIER, F.col(f"r{SECRET}")).otherwise(F.col(f"r{SECRET}") & F.col(f"r{ID}"))
    return roles.where(complete).groupBy("tl_key").agg(F.array_sort(F.collect_set("w")).cast(SPAN).alias("tl_linked"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, strong spans (tl_strong) and linked weak spans (tl_linked) of every row, from its whole text.

    Null texts count as empty. Repeated rows give repeated results, an empty table an empty one; columns besides doc_id and
    text are not read.
    """
    found = written(spotted(docs), "secrets")
    none = F.array().cast(SPAN)
    bare = found.where("tl_key IS NULL").select("doc_id", "tl_strong", none.alias("tl_linked"))
    rest = found.where("tl_key IS NOT NULL").join(linked(found), "tl_key", "left").select("doc_id", "tl_strong", F.coalesce("tl_linked", none).alias("tl_linked"))
    return bare.unionByName(rest)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets; the cases of find_secrets hold."""
    out = find_secrets(table(spark, sf_dir, "documents"))
    counts = [of_kind(F.col("tl_strong"), i).alias(f"n_{KINDS[i]}") for i in range(3)]
    return out.select("doc_id", *counts, digest(F.col("tl_strong"), KINDS).alias("base_sha256"), listed(F.concat("tl_strong", "tl_linked"), KINDS).alias("spans"))
