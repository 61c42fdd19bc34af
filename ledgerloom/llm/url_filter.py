"""URL filter: pattern rules behind an index of their rarest literal token, in DataFrame functions.

Every rule has literal tokens that a matching URL must hold.  The rule is filed under the
one that the fewest URLs hold, URLs' tokens fetch their candidate rules by a join, and
only candidates run their regular expression.  Verdicts are found once per distinct URL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small

#: Rules by host and path; the longest that fits a URL decides.
HOST_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: Patterns for all other URLs: ``^`` is a separator or an end, ``*`` is anything.  A match blocks.
PATTERNS = ["^ads^", "^adserver^", "^banners^", "^casino^", "^porn^", "^xxx^", "^doubleclick^", "^torrent^", "^malware^", "^login^*^redirect^"]


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str
    regex: str
    tokens: tuple[str, ...]
    exact: bool  # by host and path, against host + path; else a pattern, against the whole URL


def host_rule(verdict: str, text: str) -> Rule:
    """``text`` is a host and the beginning of a path; it fits the host and all its subdomains."""
    quoted = re.sub(r"([^A-Za-z0-9_/])", r"\\\1", text)
    # the last run of letters and digits may go on in the URL, so it is no whole token
    tokens = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", text.lower())
    return Rule(verdict, text, rf"^(?:[^/?#]*\.)?{quoted}", tuple(tokens), True)


def pattern_rule(text: str) -> Rule:
    parts = {"^": "(?:[^a-z0-9]|^|$)", "*": "[\\s\\S]*"}
    regex = "".join(parts.get(c) or re.sub(r"([^A-Za-z0-9_])", r"\\\1", c) for c in text.lower())
    tokens = re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", text.lower())
    return Rule("block", text, regex, tuple(tokens), False)


def _tokens(column):
    """Distinct letter and digit runs of a lower-cased text; every text has the empty one."""
    return F.array_distinct(F.concat(F.split(F.lower(column), "[^a-z0-9]+"), F.array(F.lit(""))))


def url_parts(urls: DataFrame, col: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; both are empty where the URL is null or has no ``://``."""
    at = F.locate("://", F.col(col))
    rest = F.when(at > 0, F.substring(F.col(col), at + 3, F.length(col))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return urls.withColumns({"host": host, "path": path})


RULES = "kind string, verdict string, text string"


def rule_table(spark: SparkSession, host_rules: list[tuple[str, str]] = HOST_RULES, patterns: list[str] = PATTERNS) -> DataFrame:
    """Rules as a table ``kind, verdict, text``; one read from storage has the same columns."""
    return spark.createDataFrame([("host", v, t) for v, t in host_rules] + [("pattern", "block", t) for t in patterns], RULES)


def compiled(rules: DataFrame) -> DataFrame:
    """``verdict, rule, exact, regex, tokens`` of every rule, as :func:`host_rule` and :func:`pattern_rule` have them."""
    exact, low = F.col("kind") == "host", F.lower("text")
    host = F.concat(F.lit(r"^(?:[^/?#]*\.)?"), F.regexp_replace("text", r"([^A-Za-z0-9_/])", r"\\$1"))
    quoted = F.regexp_replace(low, r"([^A-Za-z0-9_^*])", r"\\$1")
    pattern = F.regexp_replace(F.regexp_replace(quoted, r"\*", F.lit(r"[\\s\\S]*")), r"\^", F.lit(r"(?:[^a-z0-9]|^|\$)"))
    tokens = F.when(exact, F.regexp_extract_all(low, F.lit("([a-z0-9]+)(?=[^a-z0-9])"))).otherwise(F.regexp_extract_all(low, F.lit("(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])")))
    return rules.where("text is not null").select("verdict", F.col("text").alias("rule"), exact.alias("exact"), F.when(exact, host).otherwise(pattern).alias("regex"), tokens.alias("tokens")).distinct()


def judge(
    pages: DataFrame,
    url_col: str = "url",
    host_rules: list[tuple[str, str]] = HOST_RULES,
    patterns: list[str] = PATTERNS,
    rules: DataFrame | None = None,
    broadcast_rules: int = 20_000,
) -> DataFrame:
    """All columns of ``pages`` inside a struct ``row``, with ``host, path, rule, verdict, pattern``.

    A host rule that fits decides, the longest if several do (of equally long ones a
    blocking one); else a pattern found in the URL decides, an allowing one before blocking
    ones, and ``pattern`` names the first of them; else the URL is allowed, as are null URLs
    and those without ``://``.  ``rules`` is a table ``kind (host or pattern), verdict,
    text`` of any size in place of the two lists; rules of null text are left out, repeated
    ones count once.  Very long URLs are read whole.  Rows repeat as in the input; an empty
    table gives an empty one.
    """
    rules = compiled(rule_table(pages.sparkSession, host_rules, patterns) if rules is None else rules)
    few = small(rules, broadcast_rules)
    hint = F.broadcast if few else lambda df: df
    urls = url_parts(pages.select(F.col(url_col).cast("string").alias("url")).distinct())
    seen = urls.select("url", "host", "path", F.explode(_tokens(F.coalesce("url", F.lit("")))).alias("token"))
    # a rule is filed under the token that the fewest URLs hold
    named = rules.select("*", F.explode_outer("tokens").alias("token"))
    count = seen.select("token").join(hint(named.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    rank = F.struct(F.coalesce("urls", F.lit(0)), "token")
    index = named.join(count, "token", "left").groupBy("verdict", "rule", "exact", "regex").agg(F.coalesce(F.min_by("token", rank), F.lit("")).alias("token"))
    target = F.when(F.col("exact"), F.concat("host", "path")).otherwise(F.lower("url"))
    fits = seen.join(hint(index), "token").where(F.regexp_like(target, F.col("regex")))
    longest = F.when(F.col("exact"), F.struct(F.length("rule").alias("n"), F.col("verdict"), F.col("rule")))
    first = F.min(F.when(~F.col("exact"), F.struct("verdict", "rule")))  # allow comes before block
    found = fits.groupBy("url").agg(F.max(longest).alias("best"), first.alias("first"))
    row = pages.select(F.struct(*pages.columns).alias("row"), F.col(url_col).cast("string").alias("url"))
    out = url_parts(row.join(found, "url", "left"))
    pattern = F.when(F.col("best").isNull(), F.col("first.rule"))
    verdict = F.coalesce("best.verdict", "first.verdict", F.lit("allow"))
    return out.select("row", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), pattern.alias("pattern"))


def report(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """``id_col, host, path, rule, verdict, pattern`` of every page."""
    got = judge(pages, **options)
    return got.select(F.col(f"row.{id_col}").alias(id_col), "host", "path", "rule", "verdict", "pattern")


def sql() -> str:
    """The report's SQL over ``pages``."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    hosts = ", ".join(f"({quote(v)}, {quote(t)}, {quote(t.split('/', 1)[0])}, {quote('/' + t.split('/', 1)[1])})" for v, t in HOST_RULES)
    patterns = ", ".join(f"({quote(t)}, {quote(pattern_rule(t).regex)})" for t in PATTERNS)
    return f"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
keyed AS (SELECT row_number() OVER () AS k, * FROM cut),
hosts(v, rule, h, p) AS (VALUES {hosts}),
best AS (
  SELECT k, rule, v FROM keyed JOIN hosts ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC, v DESC, rule DESC) = 1),
patterns(pattern, re) AS (VALUES {patterns}),
hit AS (SELECT k, min(pattern) AS pattern FROM keyed JOIN patterns ON regexp_matches(lower(url), re) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN hit.pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN rule IS NULL THEN hit.pattern END AS pattern
FROM keyed LEFT JOIN best USING (k) LEFT JOIN hit USING (k)
"""
