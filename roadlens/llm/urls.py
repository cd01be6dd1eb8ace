"""Operator 8, URL filters: redirect equivalence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import components
from roadlens.session import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""


@dataclass(frozen=True)
class Rule:
    """Allow or block a host with its subdomains, below a path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """From the first :// up to /, ? or #, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is tested first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def node_of(url: Column) -> Column:
    """A url as a node: without fragment, scheme and host lower-cased; null without ://."""
    plain = F.regexp_replace(url, r"(?s)#.*", "")
    scheme = F.translate(F.regexp_extract(plain, r"(?s)\A(.*?://)", 1), UPPER, LOWER)
    return F.when(plain.contains("://"), F.concat(scheme, host_of(plain), F.regexp_extract(plain, r"(?s)\A.*?://[^/?#]*(.*)", 1)))


def resolved(base: Column, link: Column) -> Column:
    """A link in a page as a full url."""
    scheme, origin = F.regexp_extract(base, r"(?s)\A(.*?):", 1), F.regexp_extract(base, r"(?s)\A(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)\A(.*?://[^/?#]*/(?:[^?#]*/)?)", 1)
    return (
        F.when(link.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("#") | link.startswith("?"), F.concat(F.regexp_extract(base, r"(?s)\A([^?#]*)", 1), link))
        .otherwise(F.concat(F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder), link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """Redirect and canonical-link edges between urls: (a, b)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    canonical = F.transform(F.regexp_extract_all(html, F.lit(CANONICAL), F.lit(0)), lambda t: F.regexp_extract(t, HREF, 1))
    refresh = F.transform(F.regexp_extract_all(html, F.lit(REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, TARGET, 1))
    links = pages.where(F.col("url").contains("://")).select("url", F.explode(F.filter(F.concat(canonical, refresh), lambda x: x != "")).alias("link"))
    links = links.withColumn("link", F.replace(F.col("link"), F.lit("&amp;"), F.lit("&")))
    edges = links.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("url"), F.col("link"))).alias("b"))
    return edges.where("a is not null and b is not null and a <> b").distinct()


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A verdict for each page's url.

    A rule that fits a page decides it, the longest first.  Other pages take the decision of their aliases:
    urls joined by redirects (meta refresh) and canonical links, directly or through others, are one
    component, found by distributed connected components; urls that only occur as targets are judged by the
    rules too.  An explicit allow among the aliases takes precedence over blocks, a block over no rule; a page
    without any decision is allowed.

    Returns page_id, host, path, rule, verdict, by_alias (true if an alias decided): one row for each input
    row, repeated ones too.  A null url and a url without :// have empty host and path and no aliases; null html
    has no links; an empty table gives an empty result.  Only page_id, url and html are read, other columns may
    have any names.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias("own"), node_of(F.col("url")).alias("node"))
    edges = saved(alias_edges(pages), "aliases")
    if edges.isEmpty():
        decided = rows.withColumn("by", F.lit(None).cast("string"))
    else:
        comp = saved(components(edges), "components")
        judged = comp.withColumn("own", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules))
        by = judged.groupBy("component").agg(F.min("own.verdict").alias("by")).where("by is not null")  # allow sorts before block
        decided = rows.join(comp.join(by, "component").select("node", "by"), "node", "left")
    verdict = F.coalesce(F.col("own.verdict"), F.col("by"), F.lit("allow"))
    by_alias = F.col("own").isNull() & F.col("by").isNotNull()
    return decided.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), by_alias.alias("by_alias"))
