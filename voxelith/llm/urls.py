"""URL rules whose decisions spread over redirects and canonical links; DataFrame functions only.

A rule has a host (it fits that host and all subdomains), a path prefix and a verdict; the longest fitting rule decides a url.
Urls without a rule of their own get the verdict of their equivalence class: pages are nodes, refresh redirects and canonical
links are edges (both taken from the page's head), and the classes are the connected components. A class in which some url is
allowed by a rule allows its other members; else one in which some url is blocked blocks them; else they are allowed.

Null urls and urls without `://` have an empty host and path, fit no rule and are in no class: they are allowed. Rows are
judged one by one, so repeated rows get equal verdicts; urls are equal if they are the same text without the fragment, with scheme
and host in lower case. Very long urls and pages are read whole; empty tables give empty ones. Columns named host, path, rule or verdict are replaced, others stay,
whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from .common import dropped, free_name, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


#: What precedes the host: all up to the first ://.
_HEAD = r"(?s)^.*?://"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _HEAD + r"([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _HEAD + r"[^/?#]*([^?#]*)", 1), F.lit(""))


def normal(url: Column) -> Column:
    """Scheme and host in lower case, no fragment; null without ://."""
    start = F.translate(F.regexp_extract(url, _HEAD + r"[^/?#]*", 0), UPPER, LOWER)
    rest = F.regexp_extract(url, _HEAD + r"[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(start, F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def _fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)


def rule_of(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """value(rule) of the longest rule that fits; of equally long ones the one that allows, then the first."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow")):
        out = F.when(_fits(r, host, path), F.lit(value(r))).otherwise(out)
    return out


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b, kind) normalised urls joined by a canonical link or a refresh redirect."""
    html, url = F.col(html_col).cast("string"), F.col(url_col).cast("string")
    tag = {
        "canonical": r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)""",
        "redirect": r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'\s>]+)""",
    }

    def every(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), lambda to: F.struct(F.lit(kind).alias("kind"), to.alias("to")))

    # most pages have neither; the cheap test comes first
    some = pages.where(html.rlike(r"(?i)\bcanonical\b|\brefresh\b")).select(url.alias("url"), html.alias("html"))
    found = some.select("url", F.explode(F.flatten(F.array(*[every(k, p) for k, p in tag.items()]))).alias("l")).select("url", "l.kind", F.replace(F.col("l.to"), F.lit("&amp;"), F.lit("&")).alias("to")).where("to <> ''")
    found = found.withColumns({"base": F.regexp_extract("url", _HEAD + r"[^/?#]*", 0), "path": path_of(F.col("url"))})
    folder = F.when(F.col("path") == "", F.lit("/")).otherwise(F.regexp_replace("path", r"[^/]*$", ""))
    whole = (
        F.when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(F.regexp_extract("base", r"^[^:]*:", 0), F.col("to")))
        .when(F.col("to").startswith("/"), F.concat("base", "to"))
        .otherwise(F.concat(F.col("base"), folder, F.col("to")))
    )
    return found.select(normal(F.col("url")).alias("a"), whole.alias("to"), "kind").select("a", normal(F.col("to")).alias("b"), "kind").where("a is not null and b is not null and a <> b")


def classes(edges: DataFrame) -> DataFrame:
    """(url, class) by connected components; the class is the smallest url."""
    return components(edges.select("a", "b")).select(F.col("node").alias("url"), F.col("component").alias("class"))


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict."""
    own = dropped(pages, "host", "path", "rule", "verdict")
    key, own_verdict, alias = (free_name(own, x) for x in ("key", "own", "spread"))
    url = F.col(url_col).cast("string")
    own = own.withColumns({"host": host_of(url), "path": path_of(url)})
    own = own.withColumns({"rule": rule_of(rules, F.col("host"), F.col("path"), lambda r: r.name), own_verdict: rule_of(rules, F.col("host"), F.col("path"), lambda r: r.verdict)})
    edges = saved(links(pages, url_col, html_col))
    if edges.isEmpty():
        return own.withColumn("verdict", F.coalesce(own_verdict, F.lit("allow"))).drop(own_verdict)
    members = saved(classes(edges))
    # a member's own rule counts whether or not its page is in the table
    member = members.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    decided = member.groupBy("class").agg(F.min(rule_of(rules, F.col("host"), F.col("path"), lambda r: r.verdict)).alias(alias)).where(F.col(alias).isNotNull())  # allow sorts before block
    spread = members.join(decided, "class").select(F.col("url").alias(key), alias)
    # rows without a url get keys that match nothing, dealt out by what else they hold
    out = own.withColumn(key, F.coalesce(normal(url), F.concat(F.lit(" "), F.xxhash64(html_col).cast("string")))).join(spread, key, "left")
    return out.withColumn("verdict", F.coalesce(own_verdict, alias, F.lit("allow"))).drop(key, own_verdict, alias)
