"""URL filters: pattern rules fetched by their rarest literal token.
DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from primrose.llm.common import ascii_lower, salted_left_join


class HostRule(NamedTuple):
    """Holds for ``host`` and its subdomains where the path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Rules by pattern, for urls to which no host rule applies. ``||`` stands for
# the start of the host or of one of its labels, ``^`` for one character that
# is no letter or digit, ``*`` for any run. ``@@`` in front allows.
PATTERNS = (
    "||adult-",
    "||casino^",
    "||phishing^",
    "||porn^",
    "||warez^",
    "/wp-login.",
    "^torrent^",
    "^utm_medium=spam^",
    "@@/robots.txt",
)
MAX_BROADCAST_RULES = 50_000
_SCHEMA = "name string, kind int, action string, pattern string, tokens array<string>"


def _pattern_rule(text: str) -> tuple[str, int, str, str, list[str]]:
    """Regular expression, and the literal tokens that every match holds whole
    (bounded on both sides by something that is no letter or digit)."""
    action, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    anchored = body.startswith("||")
    body = body[2:] if anchored else body
    parts = {"^": "[^a-z0-9]", "*": ".*"}
    regex = "".join(parts.get(c) or re.escape(c) for c in body)
    # "*" stands for what may be a letter or digit: there a token is cut.
    padded = ("/" if anchored else "*") + body + "*"
    tokens = [
        m.group()
        for m in re.finditer(r"[a-z0-9]+", padded)
        if "*" not in (padded[m.start() - 1], padded[m.end()])
    ]
    return text, 0, action, ("(?s)^//(?:[^/]*\\.)?" if anchored else "(?s)") + regex, sorted(set(tokens))


def _host_rule(rule: HostRule) -> tuple[str, int, str, str, list[str]]:
    host = rule.host.translate({c: c + 32 for c in range(65, 91)})
    whole = re.findall(r"[a-z0-9]+", host)
    path = rule.path.lower()
    # The last token of a path is whole only if something follows it there.
    inner = re.findall(r"(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])", path)
    pattern = rf"(?s)^//(?:[^/]*\.)?{re.escape(host)}{re.escape(rule.path)}"
    return rule.name, 1, rule.action, pattern, sorted({*whole, *inner})


def rule_table(
    spark: SparkSession, hosts: Sequence[HostRule] = (), patterns: Sequence[str] = PATTERNS
) -> DataFrame:
    """Both kinds of rules as a frame: name, kind (1: host), action, pattern,
    tokens."""
    rows = [_host_rule(r) for r in hosts] + [_pattern_rule(p) for p in patterns]
    return spark.createDataFrame(rows, _SCHEMA)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and all that follows ``://``; empty where
    the url is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    after = F.substr(rest, F.length(host) + F.lit(1))
    path = F.regexp_extract(after, r"(?s)^[^?#]*", 0)
    return ascii_lower(host), path, after


def _tokens(subject: Column) -> Column:
    words = F.split(ascii_lower(subject), "[^a-z0-9]+")
    # The empty token stands for rules that have no literal token.
    return F.array_distinct(F.array_append(words, F.lit("")))


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per page: the id, ``host``, ``path``, ``rule`` and ``verdict``.

    Each rule is filed under the one of its literal tokens that is rarest in
    the urls at hand; rules without one are filed under the empty token. The
    tokens of each distinct url fetch candidate rules by a join, and only for
    these the regular expression runs. Of host rules that fit, the longest
    decides (ties: greater name); else a fitting allowing pattern, else a
    fitting blocking one, else ``allow``. ``rule`` names the host rule, else it
    is null. Host rules see the path as written; patterns see the lower-cased
    url from ``//`` on.

    Urls are reduced to distinct ones first and the join back is salted, so
    one url may hold any share of the rows. The rules are broadcast after a
    count of them (50,000 at most), else joined by a shuffle.

    Null urls and urls without ``://`` have an empty host and path and fetch
    no rule: ``allow``. Null ids and repeated rows stay, each with its verdict.
    """
    small = rules.limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES
    near = F.broadcast if small else (lambda df: df)

    src = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"))
    distinct = src.filter(F.instr("__url", "://") > 0).select("__url").distinct()
    host, path, after = url_parts(F.col("__url"))
    seen = distinct.select(
        "__url",
        F.concat(F.lit("//"), host, path).alias("__exact"),
        F.concat(F.lit("//"), host, ascii_lower(after)).alias("__whole"),
    ).withColumn("__token", F.explode(_tokens(F.col("__whole"))))

    filed = rules.select("name", F.explode_outer("tokens").alias("__token"))
    wanted = filed.select("__token").distinct().filter(F.col("__token").isNotNull())
    counts = seen.join(near(wanted), "__token", "left_semi").groupBy("__token").agg(
        F.count(F.lit(1)).alias("__n")
    )
    rarest = W.partitionBy("name").orderBy(F.coalesce("__n", F.lit(0)), "__token")
    index = (
        filed.join(counts, "__token", "left")
        .withColumn("__rank", F.row_number().over(rarest))
        .filter("__rank = 1")
        .select("name", F.coalesce("__token", F.lit("")).alias("__token"))
        .join(rules.select("name", "kind", "action", "pattern"), "name")
    )
    hits = seen.join(near(index), "__token").filter(
        F.rlike(F.when(F.col("kind") == 1, F.col("__exact")).otherwise(F.col("__whole")), F.col("pattern"))
    )
    is_host = F.col("kind") == 1
    verdicts = hits.groupBy("__url").agg(
        F.max(F.when(is_host, F.struct(F.length("name").alias("size"), "name", "action"))).alias("__host_rule"),
        F.max(F.when(~is_host, F.col("action") == "allow")).alias("__allowed"),
        F.max(F.when(~is_host, F.lit(True))).alias("__patterns"),
    )
    joined = salted_left_join(src, verdicts, ["__url"], F.struct("__id"))
    by_method = F.when(F.col("__patterns") & ~F.col("__allowed"), "block").otherwise("allow")
    return joined.select(
        F.col("__id").alias(id_col),
        host.alias("host"),
        path.alias("path"),
        F.col("__host_rule.name").alias("rule"),
        F.coalesce(F.col("__host_rule.action"), by_method).alias("verdict"),
    )
