"""URL filters: host rules, then pattern rules indexed by their rarest literal token (operator 3, native)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_side, spread, table, written

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's; the longest wins.
HOST_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Filter-list lines. '@@' allows, '||' anchors at a host label, '|' at the start or the end, '*' is any text,
#: '^' a separator or the end, /.../ a regular expression. All are matched against the lower-cased url.
PATTERN_RULES = (
    "||adult-*", "||casino-*", "||ads-track.", "||spam-farm.", "||cheap-pills.", "||free-bets.",
    "||doubleclick.", "||adserver.", "||tracker.", "||banner-*",
    "/adclick/", "/banner/*/popup", "/affiliate/*?ref=", "^poker^online^", "^phishing^", "^malware^download",
    "?redirect=http*://*casino", "&gclid=*&utm_campaign=", ".xxx/", "^warez^", "^torrent^", "/wp-login.php",
    "|ftp://", ".exe|", ".apk|", "/(viagra|cialis)[0-9]*/", "/[0-9]{1,3}(-[0-9]{1,3}){3}\\.dynamic/",
    "@@||spam-farm.*/fr/", "@@||ads-track.*/en/*/privacy", "@@^robots.txt|",
)

SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"


@dataclass(frozen=True)
class Rule:
    rule_id: int
    line: str
    allow: bool
    regex: str
    tokens: tuple[str, ...]


def parse_rule(rule_id: int, line: str) -> Rule:
    """The regular expression of a filter line, and the literal tokens that any url it matches must hold as whole tokens."""
    allow, body = line.startswith("@@"), line.removeprefix("@@").lower()
    if len(body) > 2 and body[0] == body[-1] == "/" and re.search(r"[\[({\\]", body):
        return Rule(rule_id, line, allow, body[1:-1], ())
    head = re.match(r"\|{0,2}", body)[0]
    tail = body.endswith("|") and len(body) > len(head)
    core = body[len(head) : len(body) - tail]
    start = {"": "", "|": "^", "||": r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"}[head]
    regex = start + "".join({"*": ".*", "^": SEPARATOR}.get(c) or re.escape(c) for c in core) + ("$" if tail else "")
    tokens = []
    for m in re.finditer(r"[a-z0-9]+", core):
        whole_left = m.start() > 0 and core[m.start() - 1] != "*" or m.start() == 0 and head
        whole_right = m.end() < len(core) and core[m.end()] != "*" or m.end() == len(core) and tail
        if whole_left and whole_right:
            tokens.append(m[0])
    return Rule(rule_id, line, allow, regex, tuple(tokens))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest host rule that fits, else nulls."""
    rule = verdict = F.when(F.lit(False), F.lit(""))
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = rule.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(kind))
    return rule, verdict


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit("([a-z0-9]+)"), F.lit(1)))


#: Rows of rules, tokens or matched urls up to which they are broadcast; beyond, joins are by shuffle.
MOST_ROWS = 200_000


def rule_index(tokens: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row (token, rule_id, allow, line, regex) for each rule, under that of its tokens that the fewest urls hold.

    tokens: (token, n) of each distinct url's tokens, n times. Rules without a whole literal token come under the empty token,
    which every url fetches; ties go to the longer token, then in alphabetical order. Rules are a list of the caller's; the
    counts of their tokens are joined to them in Spark. No rules give an empty index.
    """
    spark = tokens.sparkSession
    own = spark.createDataFrame([(r.rule_id, r.allow, r.line, r.regex, list(r.tokens) or [""]) for r in rules], "rule_id long, allow boolean, line string, regex string, tokens array<string>")
    filed = own.select("rule_id", "allow", "line", "regex", F.explode("tokens").alias("token"))
    counts = tokens.join(small_side(filed.select("token").distinct(), MOST_ROWS), "token", "left_semi").groupBy("token").agg(F.sum("n").alias("n"))
    ranked = filed.join(counts, "token", "left").select("rule_id", "allow", "line", "regex", F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("token")).alias("less"), "token").alias("place"))
    return ranked.groupBy("rule_id").agg(F.min("place")["token"].alias("token"), F.first("allow").alias("allow"), F.first("line").alias("line"), F.first("regex").alias("regex"))


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, patterns=PATTERN_RULES, *, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the deciding pattern of every row.

    A fitting host rule decides. Else the url's tokens fetch the pattern rules indexed under them and only those run their
    regular expressions, once for each distinct url; one allowing pattern that matches beats all blocking ones, of equals the
    first in the list is named, and without a match the verdict is allow. Null or scheme-less urls have an empty host and path,
    no rule, and verdict allow (patterns still see the text). Repeated rows give repeated results; an empty table gives an empty
    one; further columns are not read. patterns: filter lines, of any number.
    """
    rules = [parse_rule(i, line) for i, line in enumerate(patterns)]
    own = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    based = own.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = host_rule(F.col("host"), F.col("path"), host_rules)
    based = based.select("*", rule.alias("rule"), verdict.alias("base_verdict"))
    is_open = F.col("rule").isNull() & F.col("url").isNotNull()
    urls = written(based.where(is_open).groupBy("url").agg(F.count("*").alias("tl_n")), "urls")
    tokens = urls.select("url", F.explode(F.array_append(url_tokens(F.col("url")), F.lit(""))).alias("token"))
    index = written(rule_index(tokens.withColumn("n", F.lit(1)), rules), "rules")
    matched = tokens.join(small_side(index, MOST_ROWS), "token").where(F.expr("rlike(lower(url), regex)"))
    best = F.min(F.struct((~F.col("allow")).alias("block"), "rule_id", "line"))
    hits = matched.groupBy("url").agg(best.alias("hit")).select("url", F.col("hit.block").alias("block"), F.col("hit.line").alias("pattern"))
    hits = written(hits.join(urls, "url"), "hits")
    total = urls.agg(F.sum("tl_n").alias("n")).first()["n"] or 0
    judged = spread(based.where(is_open), hits, "url", total, "left")
    closed = based.where(~is_open).select("*", F.lit(None).cast("boolean").alias("block"), F.lit(None).cast("string").alias("pattern"))
    by_method = F.when(F.col("block"), F.lit("block")).otherwise(F.lit("allow"))
    out = judged.unionByName(closed)
    return out.select("page_id", "host", "path", "rule", F.coalesce("base_verdict", by_method).alias("verdict"), "pattern")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict; the cases of judge_urls hold."""
    return judge_urls(table(spark, sf_dir, "pages"))


def op3_sql() -> str:
    """Brute force: every pattern against every url."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rules = sorted((parse_rule(i, line) for i, line in enumerate(PATTERN_RULES)), key=lambda r: (not r.allow, r.rule_id))
    cases = " ".join(f"WHEN regexp_matches(lower(url), {quote('(?s)' + r.regex)}) THEN {quote(r.line)}" for r in rules)
    host = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2])))
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{k}'" for k, h, p in HOST_RULES)
    return f"""
WITH a AS (SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
b AS (SELECT *, CASE {host} END AS rule FROM a),
c AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {cases} END END AS pattern FROM b)
SELECT page_id, host, path, rule,
    CASE WHEN rule IS NOT NULL THEN CASE rule {verdicts} END WHEN pattern IS NULL OR starts_with(pattern, '@@') THEN 'allow' ELSE 'block' END AS verdict,
    pattern FROM c"""
