"""URL verdicts: rules on host and path, and block decisions that follow redirects and canonical links to all aliases."""

from __future__ import annotations

import re
from html import entities, unescape
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from coverlens.llm.common import components, fresh, without
from coverlens.session import stored

# (verdict, host, path): fits the host and its subdomains where the URL's path starts with the rule's; the longest wins.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
OWN = ("host", "path", "rule", "verdict", "alias_of")
_SCHEME = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*:")
# A name without a semicolon is none in an attribute's value if more of a word or an equals sign follows.
_REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|([a-zA-Z][a-zA-Z0-9]*(?:;|(?![a-zA-Z0-9;=]))))")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Query parameters that only track where a visitor came from.
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|ref|source)"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Up to the first slash, question mark or hash, A-Z in lower case; empty for null or without ``://``."""
    host = F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host to the first question mark or hash; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The URL's usual address: https, without port, fragment, tracking parameters and a slash at the end.

    Sites redirect the other spellings to it. Null or without ``://``: null.
    """
    rest = F.regexp_replace(_after_scheme(url), r"(?s)#.*$", "")
    query = F.regexp_extract(rest, r"(?s)\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^{TRACKING}(?:=|$)")), "&")
    host = F.regexp_replace(host_of(url), r":(?:80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.when(rest.isNotNull(), F.concat(F.lit("https://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def resolved(base: str | None, target: str | None) -> str | None:
    """The address that an attribute's value means on a page at ``base``, by RFC 3986; null if it is none with ``://``."""
    decoded = _REFERENCE.sub(lambda m: unescape(m[0]) if not m[1] or m[1] in entities.html5 else m[0], target or "").strip()
    if not decoded:
        return None
    try:
        found = decoded if _SCHEME.match(decoded) else urljoin(base or "", decoded)
    except ValueError:  # no address, such as one with half a bracket
        return None
    return found if _SCHEME.match(found) and "://" in found else None


@F.udf(StringType())
def _target(url, base, found):
    return resolved(resolved(url, base) or url, found)


def page_edges(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between URLs that name the same page: from each page to its usual address, to the target of its
    canonical link, and to the target of its refresh redirect. Character references in targets are decoded, and relative
    targets are resolved against the page's base element, or its URL."""
    tag = F.regexp_extract("html", r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    link = F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    meta = F.regexp_extract("html", r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    refresh = F.regexp_extract(meta, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1)
    base = F.regexp_extract("html", r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)""", 1)

    wanted = F.coalesce(F.col("html"), F.lit(""))
    links = F.when(wanted.rlike("(?i)canonical"), link)
    moved = F.when(wanted.rlike("(?i)refresh"), refresh)
    bases = F.when(wanted.rlike("(?i)<base"), base)
    named = F.filter(F.array(links, moved), lambda found: found != "")
    # A null stands for the page itself.
    found = pages.select("url", bases.alias("base"), F.explode(F.concat(F.array(F.lit(None).cast("string")), named)).alias("found"))
    itself = found.where("found IS NULL").select("url", canonical(F.col("url")).alias("b"))
    targets = found.where("found IS NOT NULL").select("url", _target("url", "base", "found").alias("target"))
    ends = itself.unionByName(targets.select("url", F.explode(F.array("target", canonical(F.col("target")))).alias("b")))
    return ends.where("url IS NOT NULL AND b IS NOT NULL AND url <> b").select(F.col("url").alias("a"), "b")


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule (as host + path, null if none fits) and verdict (the rule's, null if none fits)."""
    table = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    withs = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in reversed(table):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return withs.withColumns({"rule": rule, "verdict": verdict})


def verdicts(pages: DataFrame, edges: DataFrame, rules=RULES) -> DataFrame:
    """All rows and columns of ``pages`` (url) plus host, path, rule, verdict and alias_of.

    A URL that a rule fits has the rule's verdict. Any other is blocked if one of its aliases is blocked by a rule, else
    allowed; aliases are what ``edges`` (a, b) connect, over any number of steps, whether or not they are pages. An
    explicit allow holds for that URL although its aliases are blocked, and does not lift their block.
    alias_of is the smallest URL of a group of aliases, null for a URL without any. A null URL, or one without ``://``,
    has empty host and path and is allowed. Repeated rows are each returned. Input columns that have one of the added
    names are replaced.
    """
    pages = without(pages, *OWN)
    node, group, blocked = fresh(pages, "node", "group", "blocked")
    linked = stored(components(edges).select(F.col("node").alias("url"), "component"), "aliases")
    hit = ruled(linked, rules).where("verdict = 'block'").groupBy("component").agg(F.lit(True).alias("blocked"))
    linked = stored(linked.join(hit, "component", "left").select(F.col("url").alias(node), F.col("component").alias(group), F.col("blocked").alias(blocked)), "blocked-aliases")
    joined = ruled(pages, rules).join(linked, F.col("url") == F.col(node), "left")
    verdict = F.coalesce("verdict", F.when(F.col(blocked), F.lit("block")), F.lit("allow"))
    return joined.withColumns({"verdict": verdict, "alias_of": F.col(group)}).drop(node, group, blocked)
