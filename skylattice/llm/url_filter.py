"""URL filtering: pattern rules indexed by their rarest literal token.

Every rule is a regular expression with literal tokens that any URL it matches must hold. Tokens are
counted over all URLs; a rule is filed under its rarest one. The tokens of a URL fetch candidate
rules, and only those run their expressions. The longest matching rule wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many rules are broadcast; beyond, rules are joined by a shuffle.
BROADCAST_RULES = 50_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``name`` is reported (None: the verdict alone); ``pattern`` runs on lower-cased host + path as given."""

    name: str | None
    pattern: str
    literals: tuple[str, ...]
    verdict: str
    length: int


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host, all its subdomains, and the paths that start with ``path``."""
    whole = path if not path or not path[-1].isalnum() else re.sub(r"[A-Za-z0-9]+$", "", path)
    tokens = tuple(t for t in re.split(r"[^A-Za-z0-9]+", f"{host} {whole}") if t)
    return Rule(host + path, rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}", tokens, verdict, len(host + path))


def word_rule(word: str) -> Rule:
    """Blocks URLs with the token ``word`` in host or path, where no host rule fits."""
    return Rule(None, rf"(?:^|[^A-Za-z0-9]){word}(?:[^A-Za-z0-9]|$)", (word,), "block", 0)


#: The host rules of the task.
HOST_RULES = (
    host_rule("org", "/", "allow"),
    host_rule("example.org", "/es/", "block"),
    host_rule("example.org", "/en/1", "block"),
    host_rule("com", "/fr/", "allow"),
    host_rule("com", "/de/", "block"),
)
#: Words of hosts and paths that are blocked unless a host rule says otherwise.
BLOCKED_WORDS = ("adult", "casino", "gambling", "malware", "phishing", "porn", "spam", "torrent", "warez", "xxx")
RULES = HOST_RULES + tuple(map(word_rule, BLOCKED_WORDS))


def rule_table(spark, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [(i, r.name, r.pattern, list(r.literals), r.verdict, r.length) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id int, rule string, pattern string, literals array<string>, verdict string, length int")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    Without a fitting named rule, ``rule`` is null and the verdict is that of the unnamed rules that
    match, else ``default``. Ties in length: block before allow, then the rule's text. A null URL or
    one without ``://`` has empty host and path and gets ``default``. Repeated rows each get a row.
    """
    spark = pages.sparkSession
    part = lambda i: F.coalesce(F.regexp_extract(F.col(url_col), _URL, i), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.translate(part(1), _UPPER, _LOWER).alias("host"), part(2).alias("path"))
    places = rows.select("host", "path").distinct()
    places = places.withColumn("place", F.concat("host", "path"))
    places = places.withColumn("tokens", F.array_distinct(F.filter(F.split("place", "[^A-Za-z0-9]+"), lambda t: t != "")))

    table = rule_table(spark, rules)
    literals = table.select("rule_id", F.explode("literals").alias("token"))
    small = len(rules) <= BROADCAST_RULES
    held = F.broadcast if small else lambda df: df.hint("merge")
    tokens = places.select(F.explode("tokens").alias("token"))
    counts = tokens.join(held(literals.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = literals.join(held(counts), "token", "left").groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    index = table.drop("literals").join(held(rarest.select("rule_id", F.col("least.token").alias("token"))), "rule_id")

    candidates = places.select("host", "path", "place", F.explode("tokens").alias("token")).join(held(index), "token")
    matches = candidates.where(F.expr("regexp_like(place, pattern)"))
    order = F.struct(F.col("rule").isNotNull().alias("named"), "length", (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")
    best = matches.groupBy("host", "path").agg(F.max(order).alias("best"))
    out = rows.join(best.hint("merge"), ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def oracle_sql(words: tuple[str, ...] = BLOCKED_WORDS) -> str:
    """DuckDB SQL for the default rules."""
    listed = ", ".join(f"'{w}'" for w in words)
    return rf"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
k AS (SELECT DISTINCT host, path FROM u),
m AS (
  SELECT k.host, k.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS v
  FROM k JOIN r ON (k.host = r.h OR ends_with(k.host, '.' || r.h)) AND starts_with(k.path, r.p) GROUP BY 1, 2
)
SELECT u.page_id, u.host, u.path, m.rule,
       coalesce(m.v, CASE WHEN list_has_any(regexp_split_to_array(u.host || u.path, '[^A-Za-z0-9]+'), [{listed}]) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m ON m.host = u.host AND m.path = u.path
"""
