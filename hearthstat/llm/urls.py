"""URL filters: listed host and path rules first, pattern rules for the rest, both found by their rarest token.

A rule is a pattern over host and path, in the usual filter-list notation:
`||` is the start of a host or of a part of it after a dot, `^` a separator or
either end, `*` anything, and all else stands for itself. Its tokens are the runs
of ASCII letters and digits that a match must hold as whole tokens. Every rule is
filed under that of its tokens which the fewest URLs have; a URL's tokens fetch the
rules filed under them, and only those run their regular expression. Rules without
a token are fetched by every URL.

Of the listed rules that fit a URL the longest wins; of rules of one length, a
block. Where none fits, the longest fitting pattern decides, and else the default.
A null URL, or one without `://`, has an empty host and path and no tokens. Output
columns replace input columns of the same name; rows are neither lost nor merged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that are broadcast; a longer list is joined by shuffling.
BROADCAST_RULES = 50_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str
    pattern: str
    listed: bool = False

    @classmethod
    def host_path(cls, text: str, verdict: str) -> Rule:
        """A rule for a host with all its subdomains and the paths that start with a given one."""
        return cls(text, verdict, "||" + text, True)

    @classmethod
    def block(cls, pattern: str) -> Rule:
        return cls(pattern, "block", pattern)

    def regex(self) -> str:
        signs = {"||": r"^(?:[^/]*\.)?", "^": r"(?:^|[^A-Za-z0-9]|\z)", "*": "(?s:.*)"}
        parts = re.findall(r"\|\||.", self.pattern, re.S)
        return "".join(signs.get(p) or (p if re.match("[A-Za-z0-9/]", p) else "\\" + p) for p in parts)

    def tokens(self) -> list[str]:
        """Runs that nothing in a matching URL can lengthen."""
        whole = r"(?<![A-Za-z0-9*])[A-Za-z0-9]+(?![A-Za-z0-9*])"
        end = len(self.pattern)
        found = [m for m in re.finditer(whole, self.pattern) if m.start() > 0 and m.end() < end]
        return sorted({m[0] for m in found})


#: The rules that the registered query is asked for.
LISTED = [
    Rule.host_path("org/", "allow"),
    Rule.host_path("example.org/es/", "block"),
    Rule.host_path("example.org/en/1", "block"),
    Rule.host_path("com/fr/", "allow"),
    Rule.host_path("com/de/", "block"),
]
#: What it blocks besides: parts of hosts and paths that name spam and adult pages.
PATTERNS = [
    Rule.block(p)
    for p in (
        "^spam-farm.", "^link-farm.", "^free-bets.", "^casino^", "^porn^", "^xxx^", "^viagra^", "^warez^", "^phishing^",
        "^malware^", "^escorts^", "^free-downloads.", "/wp-login.php",
    )
]


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    url = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def _tokens(target: str) -> Column:
    """The distinct tokens of a URL, and the empty one, under which rules without tokens are filed."""
    return F.array_union(F.split(F.col(target), "[^A-Za-z0-9]+"), F.array(F.lit("")))


def _index(rules: list[Rule], targets: DataFrame) -> DataFrame:
    """Each rule under its rarest token."""
    spark = targets.sparkSession
    table = spark.createDataFrame(
        [(i, r.text, r.verdict, r.regex(), r.listed, r.tokens() or [""]) for i, r in enumerate(rules)],
        "id int, rule string, says string, regex string, listed boolean, tokens array<string>",
    )
    own = table.select("id", "rule", "says", "regex", "listed", F.explode("tokens").alias("token"))
    asked = own.select("token").distinct()
    asked = F.broadcast(asked) if len(rules) <= BROADCAST_RULES else asked
    seen = targets.select(F.explode(_tokens("target")).alias("token")).join(asked, "token", "left_semi")
    counts = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counted = own.join(counts, "token", "left").fillna(0, ["n"])
    rarest = F.min_by("token", F.struct("n", "token")).alias("token")
    return counted.groupBy("id", "rule", "says", "regex", "listed").agg(rarest).drop("id")


def judge(
    pages: DataFrame, listed: list[Rule] = LISTED, patterns: list[Rule] = PATTERNS, default: str = "allow"
) -> DataFrame:
    """`pages` (with a column url) and host, path, rule (the listed one), pattern (of the others), verdict."""
    pages = pages.drop("host", "path", "rule", "pattern", "verdict")
    host, path = host_and_path()
    pages = pages.withColumns({"host": host, "path": path})
    target = F.concat("host", "path")
    targets = pages.select(target.alias("target"))
    rules = [*listed, *patterns]
    if not rules:
        none = F.lit(None).cast("string")
        return pages.withColumns({"rule": none, "pattern": none, "verdict": F.lit(default)})
    index = _index(rules, targets)
    index = F.broadcast(index) if len(rules) <= BROADCAST_RULES else index
    fetched = targets.select("target", F.explode(_tokens("target")).alias("token")).join(index, "token")
    fitting = fetched.where(F.rlike("target", "regex"))
    order = F.struct(F.length("rule"), F.col("says") == "block", "rule", "says")
    best = fitting.groupBy(F.col("target").alias("_target")).agg(
        F.max(F.when(F.col("listed"), order)).alias("_listed"),
        F.max(F.when(~F.col("listed"), order)).alias("_other"),
    )
    judged = pages.withColumn("_target", target).join(best, "_target", "left")
    verdict = F.coalesce(F.col("_listed.says"), F.col("_other.says"), F.lit(default))
    return judged.withColumns(
        {"rule": F.col("_listed.rule"), "pattern": F.when(F.col("_listed").isNull(), F.col("_other.rule")),
         "verdict": verdict}
    ).drop("_target", "_listed", "_other")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


_FIT = "\n  UNION ALL ".join(
    f"SELECT '{r.text}' AS rule, '{r.verdict}' AS says, '{r.text.partition('/')[0]}' AS h, '/{r.text.partition('/')[2]}' AS p"
    for r in LISTED
)
_OTHER = " OR ".join(
    "regexp_matches(host || path, '" + r.regex() + "')" for r in PATTERNS
)
OP6_SQL = f"""
WITH rules AS ({_FIT}),
u AS (SELECT row_number() OVER () AS rid, page_id,
             CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
t AS (SELECT rid, page_id,
             translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
fits AS (SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says
         FROM t JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN {_OTHER} THEN 'block' ELSE 'allow' END) AS verdict
FROM t LEFT JOIN fits USING (rid)
"""
