"""Block and allow decisions on URLs, carried over to aliases, in DataFrame operations only.

A rule is a host and a path prefix. It fits its host and all subdomains when the path starts with
its path; of several the longest wins. A URL without a rule gets the decision of its aliases: the URLs that
redirect and canonical links connect with it in any number of steps, and other spellings of the same URL (letter case of
scheme and host, default port, no path for `/`, fragment). Within such a component an explicit allow goes
before any block; without either it is allowed.

Links come from every `<link rel="canonical">` and `<meta http-equiv="refresh">` in the head of the page, and
from a table of redirects if there is one. Comments, scripts and styles do not count; the first tag that does not
belong in a head ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termbridge.llm.components import connected_components
from termbridge.session import cut_lineage

col = F.col
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"(?:utm_[a-z]+|fbclid|gclid|mc_cid|mc_eid)=[^&]*"
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|title)\b.*?(?:</\1\s*>|\z)"
HEAD = r"(?is)^(.*?)(?:</head\b|<(?!(?:html|head|title|base|link|meta|style|script|noscript|template)\b)[a-z]|\z)"
VALUE = r"""\s*=\s*(?:"([^"]*)|'([^']*)|([^\s"'>][^\s>]*))"""
ENTITIES = [("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
RULES = [  # fixed values: rule, verdict
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
]


def host(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def alias_key(url: Column, loose: bool = False) -> Column:
    """The form that all spellings of a URL share; null for text without `://`.

    ``loose`` also leaves out the scheme, `www.` and tracking parameters, though no link says that these URLs are one.
    """
    scheme = F.translate(F.regexp_extract(url, r"^(?s)(.*?)://", 1), UPPER, LOWER)
    query = F.regexp_extract(url, r"^(?s)[^?#]*\?([^#]*)", 1)
    name = host(url)
    name = F.when(scheme == "http", F.regexp_replace(name, ":80$", "")).when(scheme == "https", F.regexp_replace(name, ":443$", "")).otherwise(name)
    if loose:
        query = F.regexp_replace(F.concat(F.lit("&"), query), r"&" + TRACKING + r"(?=&|$)", "")
        query = F.regexp_replace(query, r"^&+|&+$", "")
        name, scheme = F.regexp_replace(name, r"^www\.", ""), F.lit("")
    place = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    key = F.concat(scheme, F.lit("://"), name, place, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(F.instr(url, "://") > 0, key)


def without_dots(place: Column) -> Column:
    """A path with its `.` and `..` steps taken."""
    steps = F.split(place, "/")
    nothing = F.array().cast("array<string>")
    taken = F.aggregate(
        F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))),
        nothing,
        lambda kept, x: F.when(x == ".", kept)
        .when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(x))),
    )
    closed = F.element_at(steps, -1).isin(".", "..")  # such an end names a folder
    end = F.when(closed & (F.size(taken) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(taken, "/"), end)


def absolute(link: Column, base: Column) -> Column:
    """A link of a page as a whole URL."""
    scheme = F.regexp_extract(base, r"^(?s)(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(base, r"^(?s).*?://([^/?#]*)", 1))
    here = F.when(path(base) == "", F.lit("/")).otherwise(path(base))
    folder = F.regexp_extract(here, r"^(?s)(.*/)", 1)
    place, rest = F.regexp_extract(link, r"^(?s)([^?#]*)", 1), F.regexp_extract(link, r"^(?s)[^?#]*(.*)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))  # mailto: and the like are no pages
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, without_dots(place), rest))
        .when(place != "", F.concat(site, without_dots(F.concat(folder, place)), rest))
        .when(link != "", F.concat(site, here, link))
    )


def decoded(text: Column) -> Column:
    """Text with its numeric ASCII references and the five XML ones replaced."""
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(&#(?:[0-9]{1,6}|[xX][0-9a-fA-F]{1,5});)")))

    def put(state: Column, mark: Column) -> Column:
        digits = F.regexp_extract(mark, r"&#[xX]?([0-9a-fA-F]+);", 1)
        code = F.when(mark.rlike("[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        return F.when(code.between(32, 126), F.replace(state, mark, F.char(code))).otherwise(state)

    # A decoded `&` must not begin another reference, so it stays `&amp;` until the last step.
    amp = F.regexp_replace(text, r"&#(?:0*38|[xX]0*26);", "&amp;")
    out = F.aggregate(numbers, amp, put)
    for mark, sign in ENTITIES:
        out = F.replace(out, F.lit(mark), F.lit(sign))
    return out


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, empty if it has none."""
    found = [F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}{VALUE}", k) for k in (1, 2, 3)]
    return decoded(F.concat(*found))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target): canonical and refresh links in the pages' heads."""
    marked = pages.where(col(html).rlike(r"(?i)canonical|http-equiv") & col(url).isNotNull())
    head = F.regexp_extract(F.regexp_replace(col(html), HIDDEN, ""), HEAD, 1)
    tags = F.regexp_extract_all(head, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"))
    tags = marked.select(col(url).alias("source"), F.explode(tags).alias("tag"))
    canonical = F.array_contains(F.split(F.lower(attribute(col("tag"), "rel")), r"\s+"), "canonical")
    refresh = F.lower(F.trim(attribute(col("tag"), "http-equiv"))) == "refresh"
    content = attribute(col("tag"), "content")
    moved = F.concat(*[F.regexp_extract(content, r"""(?is)\burl\s*=\s*(?:"([^"]*)|'([^']*)|([^"'].*))""", k) for k in (1, 2, 3)])
    is_link = F.lower(F.substring("tag", 2, 4)) == "link"
    link = F.when(is_link & canonical, attribute(col("tag"), "href")).when(~is_link & refresh, moved)
    links = tags.select("source", F.regexp_replace(link, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("link")).where("link <> ''")
    return links.select("source", absolute(col("link"), col("source")).alias("target"))


def with_rule(pages: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Adds rule and own (its verdict) to rows with host and path; ``key`` tells rows apart.

    Every suffix of the host is looked up in the table of rules, which has one row per host.
    """
    split = F.instr("rule", "/")
    parts = rules.where(split > 0).select(
        F.expr("substring(rule, 1, instr(rule, '/') - 1)").alias("suffix"),
        F.expr("substring(rule, instr(rule, '/'))").alias("prefix"),
        "rule",
        "verdict",
    )
    by_host = parts.groupBy("suffix").agg(
        F.collect_set(F.struct(F.length("rule").alias("size"), "rule", "prefix", "verdict")).alias("rules")
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    asked = pages.select(key, "path", F.explode(F.array_distinct(suffixes)).alias("suffix"))
    fits = asked.join(by_host, "suffix").select(
        key, F.explode(F.filter("rules", lambda r: col("path").startswith(r["prefix"]))).alias("r")
    )
    best = fits.groupBy(key).agg(F.max("r").alias("r"))
    return pages.join(best, key, "left").select(*pages.columns, col("r.rule").alias("rule"), col("r.verdict").alias("own"))


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", html: str | None = "html", redirects: DataFrame | None = None, loose: bool = False) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict.

    ``rules`` has rule (host followed by a path that starts with `/`) and verdict, allow or block; of equal
    rules with both verdicts allow counts. A null URL or one without `://` has empty host and path,
    no rule and no aliases. Rows may repeat or lack a page_id. An empty table gives no rows.
    ``redirects`` has source and target URLs. ``loose`` takes URLs as one that differ in scheme, `www.` or
    tracking parameters. Other columns are not read.
    """
    rows = pages.select(col(page_id).alias("page_id"), col(url).alias("url"), *([col(html).alias("html")] if html else []))
    placed = rows.select("page_id", "url", host(col("url")).alias("host"), path(col("url")).alias("path"))
    rules = rules.groupBy("rule").agg(F.min("verdict").alias("verdict"))  # "allow" comes before "block"
    links = None
    if html:
        links = cut_lineage(page_links(rows))  # read as nodes, names and edges; pages are parsed once
    if redirects is not None:
        known = redirects.select("source", "target")
        links = known if links is None else links.union(known)
    # The ends of links have a say even if they are no pages of the table.
    ends = placed.where("false").select("url") if links is None else links.select(F.explode(F.array("source", "target")).alias("url"))
    ends = ends.select("url", host(col("url")).alias("host"), path(col("url")).alias("path"))
    names = placed.select("host", "path").union(ends.select("host", "path")).distinct()
    ruled = with_rule(names.withColumn("key", F.concat("host", "path")), rules, "key").select("host", "path", "rule", "own")
    nodes = placed.withColumn("page", F.lit(True)).unionByName(ends.withColumn("page", F.lit(False)), allowMissingColumns=True)
    judged = nodes.withColumn("alias", alias_key(col("url"), loose)).join(ruled, ["host", "path"], "left")
    if links is not None:
        edges = links.select(alias_key(col("source"), loose).alias("a"), alias_key(col("target"), loose).alias("b"))
        found = connected_components(edges)
        judged = judged.join(found, judged["alias"] == found["node"], "left")
        group = F.coalesce("component", "alias")
    else:
        group = col("alias")
    judged = judged.withColumn("group", group)
    # A component is allowed by one explicit allow, else blocked by one block: the least verdict.
    said = judged.where("own IS NOT NULL AND group IS NOT NULL").groupBy("group").agg(F.min("own").alias("told"))
    verdict = F.coalesce("own", "told", F.lit("allow"))
    return judged.where("page").join(said, "group", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
