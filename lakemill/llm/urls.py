"""URL filters with redirect equivalence.

Rules (host, path, verdict) judge a URL if its host is the rule's or a subdomain of it and its path starts with the
rule's; the longest host, then the longest path, wins, and of equal rules allow. URLs without a rule of their own are
judged by their aliases: URLs are linked by the redirects and canonical links that pages declare, and by equal
normal forms, and the links' connected components are computed by distributed star steps. A component that holds an explicitly
allowed URL is allowed; else one that holds a blocked URL is blocked; else the default holds. So blocks spread to aliases,
and an allow takes precedence.

Finding the rule is a join of each different host's suffixes to the rules' hosts, then a search among a host's rules in order of
length; the rules are a list or a table of any length.

Cases: a null URL or one without ``://`` has empty host and path, no rule, and no aliases; hosts fold A-Z only; a
null page_id is kept; repeated rows are each judged; empty tables work; extra columns are ignored. The normal
form drops the scheme, a leading ``www.``, the fragment, tracking parameters, ``.html`` and closing slashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, graph

_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TAG = r"(?i)<(?:link|meta)\b[^>]*>"
_NAMES = [
    (r"(?i)^<link\b.*\brel\s*=\s*[\"']?canonical\b", r"(?i)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))"),
    (r"(?i)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b", r"(?i)\burl\s*=\s*()()[\"']?([^\"'\s>]+)"),
    (r"(?i)^<meta\b.*\bproperty\s*=\s*[\"']?og:url\b", r"(?i)\bcontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'\s>]+))"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without it."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), *_ASCII), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (host, path, ...) with rule and verdict of the winning rule (at, begin, verdict), or nulls.

    Each different host is joined to the rules by its suffixes; a row then tries its host's rules in order.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = rows.select("host").distinct().select("host", F.explode(suffixes).alias("at")).join(rules, "at")
    order = F.struct((-F.length("at")).alias("a"), (-F.length("begin")).alias("b"), "verdict", "at", "begin")
    fits = common.materialize(hosts.groupBy("host").agg(F.array_sort(F.collect_set(order)).alias("fits")), "rules")
    won = F.get(F.filter("fits", lambda r: F.col("path").startswith(r["begin"])), F.lit(0))
    out = rows.join(fits, "host", "left").withColumn("fits", won)
    return out.select(*rows.columns, F.concat("fits.at", "fits.begin").alias("rule"), F.col("fits.verdict").alias("verdict"))


def normal_form(url: Column) -> Column:
    """A key that aliases of one page share; null where the URL has no host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"\.html?$", ""), r"/+$", "")
    query = F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(query, lambda x: (x != "") & ~x.rlike(r"^(utm_\w*|ref|fbclid|gclid)=")))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _absolute(url: Column, link: Column) -> Column:
    """A link of a page as an absolute URL; null for a place in the page, another kind of link, or a page without host."""
    base, scheme = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
    path, tail = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    parts = F.split(F.concat(F.regexp_replace(F.concat(F.lit("/"), F.ltrim(path_of(url), F.lit("/"))), r"[^/]*$", ""), path), "/")
    up = lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).when(x == ".", out).otherwise(F.concat(out, F.array(x)))
    resolved = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), link)
        .when((base == "") | link.rlike(r"^(?:#|[a-zA-Z][a-zA-Z0-9+.-]*:|$)"), None)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.startswith("?"), F.concat(base, path_of(url), link))
        .otherwise(F.concat(base, resolved, tail))
    )


def declared(url: Column, html: Column) -> Column:
    """Absolute URLs that a page's canonical links, refreshes and og:url tags name."""

    def value(tag: Column) -> Column:
        out = F.lit("")
        for kind, pattern in _NAMES:
            out = F.when(tag.rlike(kind), F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])).otherwise(out)
        return F.regexp_replace(F.trim(out), r"(?i)&(?:amp|#38|#x26);", "&")

    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_TAG), F.lit(0))
    links = F.filter(F.transform(tags, lambda t: value(F.translate(t, "\r\n", "  "))), lambda x: x != "")
    return F.array_compact(F.array_distinct(F.transform(links, lambda x: _absolute(F.coalesce(url, F.lit("")), x))))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url, html); rules are (host, path, verdict)."""
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    table = rules.toDF("at", "begin", "verdict") if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(rules, "at string, begin string, verdict string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), normal_form(url).alias("node"), declared(url, html).alias("links"))
    rows = common.materialize(rows, "urls")
    links = rows.where("node is not null and size(links) > 0").select("node", F.explode("links").alias("url")).distinct()
    links = links.select("node", normal_form(F.col("url")).alias("other"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("other is not null")
    links = common.materialize(ruled(common.materialize(links, "links"), table), "links")
    classes = graph.components(links.select("node", "other"))
    rows = common.materialize(ruled(rows.select("page_id", "host", "path", "node"), table), "urls")
    # what is known of each normal form, combined before the shuffle, then of each component
    known = rows.where("node is not null and verdict is not null").select("node", "verdict").unionByName(links.where("verdict is not null").select(F.col("other").alias("node"), "verdict"))
    known = known.groupBy("node").agg(F.min("verdict").alias("verdict"))  # allow comes before block
    named = known.join(classes, "node", "left").select(F.coalesce("component", "node").alias("class"), "verdict").groupBy("class").agg(F.min("verdict").alias("spread"))
    judged = rows.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")).join(common.materialize(named, "spread"), "class", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", "spread", F.lit(default)).alias("verdict"))
