"""Block and allow rules for URLs, carried to aliases over redirects and canonical links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, spare
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: So many rules become one expression; longer lists, and tables, are joined. Both give the same.
EXPRESSION_RULES = 100


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def alias_of(url: Column) -> Column:
    """Host, path and query: what two spellings of one resource share, whatever their scheme or fragment. Null without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), rest))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits (of equally long ones that with the longest host, then an
    allow); nulls if none does."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "allow")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def rules_joined(rows: DataFrame, host: str, path: str, rules: DataFrame) -> DataFrame:
    """(r_host, r_path, found) for each host and path of rows that a rule fits; found as by rule_for.

    A host is cut into its domains (itself, and what follows each dot), and those that have rules meet them by domain and
    by the path's starts of the lengths that the domain's rules have. Nothing depends on how many rules there are."""
    rules = rules.select("verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    sizes = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("sizes"))
    labels = F.split(F.col("r_host"), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = rows.select(F.col(host).alias("r_host"), F.col(path).alias("r_path")).distinct()
    each = each.select("r_host", "r_path", F.explode(domains).alias("rule_host")).join(sizes, "rule_host")
    each = each.select("r_host", "r_path", "rule_host", F.explode("sizes").alias("size")).where(F.length("r_path") >= F.col("size"))
    each = each.withColumn("rule_path", F.substring("r_path", F.lit(1), F.col("size"))).join(rules, ["rule_host", "rule_path"])
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(rule), F.length("rule_host"), F.col("verdict") == "allow")
    return each.groupBy("r_host", "r_path").agg(F.max_by(F.struct(rule.alias("rule"), "verdict"), rank).alias("found"))


def with_rules(rows: DataFrame, host: str, path: str, name: str, rules: tuple[tuple[str, str, str], ...] | DataFrame) -> DataFrame:
    """rows and a column `name`: struct(rule, verdict) of the rule that decides, or null fields."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= EXPRESSION_RULES:
            return rows.withColumn(name, rule_for(F.col(host), F.col(path), rules))
        rules = rows.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    found = rules_joined(rows, host, path, rules).withColumnsRenamed({"r_host": f"{name}_host", "r_path": f"{name}_path", "found": f"{name}_found"})
    same = (F.col(host) == F.col(f"{name}_host")) & (F.col(path) == F.col(f"{name}_path"))
    out = rows.join(found, same, "left").withColumn(name, F.col(f"{name}_found"))
    return out.drop(f"{name}_host", f"{name}_path", f"{name}_found")


_DEAD = re.compile(r"<!--|<script\b", re.I)
_DEAD_END = {"<!--": re.compile(r"-->"), "<script": re.compile(r"</script\s*+>", re.I)}
_TAG = re.compile(r"<(link|meta)\s", re.I)
_ATTRIBUTE = re.compile(r"""(?<![\w-])([\w-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_REFRESH = re.compile(r"""url\s*=\s*["']?\s*([^"']*)""", re.I)


def _tags(html: str) -> Iterator[tuple[str, str]]:
    """(link or meta, what is inside) of the tags outside comments and scripts, in one scan: what has no end is looked for once."""
    live, at, endless = [], 0, set()
    for dead in _DEAD.finditer(html):
        kind = dead[0].lower()
        if dead.start() < at or kind in endless:
            continue
        if end := _DEAD_END[kind].search(html, dead.end()):
            live.append(html[at : dead.start()])
            at = end.end()
        else:
            endless.add(kind)
    html = " ".join([*live, html[at:]])
    at = 0
    for tag in _TAG.finditer(html):
        if tag.start() >= at:
            end = html.find(">", tag.end())
            if end < 0:
                return
            yield tag[1], html[tag.end() : end]
            at = end


def links_of(url: str, html: str) -> list[str]:
    """Absolute targets of a page's canonical links and refresh redirects; comments and scripts don't count."""
    out = []
    for kind, inside in _tags(html):
        own = {k.lower(): unescape(a or b or c).strip() for k, a, b, c in _ATTRIBUTE.findall(inside)}
        link = ""
        if kind.lower() == "link" and "canonical" in own.get("rel", "").lower().split():
            link = own.get("href", "")
        elif kind.lower() == "meta" and own.get("http-equiv", "").lower() == "refresh":
            found = _REFRESH.search(own.get("content", ""))
            link = found[1].strip() if found else ""
        if link and not link.startswith("#"):
            try:
                target = urljoin(url, link)
            except ValueError:  # a malformed address leads nowhere
                continue
            out += [target] if "://" in target else []
    return out


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): aliases of a page and of where its canonical link or refresh redirect leads. Only pages that may have
    one leave the JVM."""
    page, code = F.col(f"`{url}`"), F.col(f"`{html}`")
    rows = pages.where(page.contains("://") & code.rlike(r"(?i)canonical|http-equiv")).select(page.alias("url"), code.alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(u.as_py(), x) for u, h in zip(*batch.columns) for x in links_of(u.as_py(), h.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.string()) for i in (0, 1)], names=["a", "b"])

    links = rows.mapInArrow(run, "a string, b string")
    return links.select(alias_of(F.col("a")).alias("a"), alias_of(F.col("b")).alias("b"))


def filter_urls(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] | DataFrame = RULES,
    redirects: DataFrame | None = None,
    url: str = "url",
    html: str | None = "html",
) -> DataFrame:
    """pages and host, path, rule, verdict (where pages has such columns, the names with underscores before them).

    `rules` are (verdict, host, path), a tuple or, for lists of any length, a table with these columns. A rule fits its
    host and all subdomains if the URL's path starts with the rule's; the longest one decides. A page
    without a rule takes the verdict of its aliases: URLs that are joined to its own by canonical links, refresh
    redirects in the pages' html or the rows (source, target) of `redirects`, over any number of steps. It is blocked
    if a rule blocks one of them and no rule allows one, whether that alias is itself a page or not; else allowed.

    Components are computed on the links alone, in DataFrames; pages join their component by their own alias, which is
    host, path and query. A null URL, or one without ://, has empty host and path, no rule, no alias, and is allowed.
    Null html has no links; html is read whole, however long. Repeated pages keep their rows; an empty table gives an
    empty result.
    """
    host, path, rule, verdict, found, key, node, by = spare(pages, "host", "path", "rule", "verdict", "found", "key", "node", "by_alias")
    links = page_links(pages, url, html) if html else None
    if redirects is not None:
        given = redirects.select(alias_of(F.col("source")).alias("a"), alias_of(F.col("target")).alias("b"))
        links = given if links is None else links.unionByName(given)
    out = pages.withColumns({host: host_of(F.col(f"`{url}`")), path: path_of(F.col(f"`{url}`")), key: alias_of(F.col(f"`{url}`"))})
    out = with_rules(out, host, path, found, rules)
    own = F.col(f"{found}.verdict")
    if links is None:
        by_alias = F.lit(None)
    else:
        members = connected_components(links)
        members = members.unionByName(members.select(F.col("root").alias("node"), "root").distinct())
        at = F.concat(F.lit("x://"), "node")
        members = members.withColumns({"node_host": host_of(at), "node_path": path_of(at)})
        members = with_rules(members, "node_host", "node_path", "node_rule", rules).select("node", "root", "node_rule.verdict")
        told = members.groupBy("root").agg(F.bool_or(F.col("verdict") == "block").alias("block"), F.bool_or(F.col("verdict") == "allow").alias("allow"))
        blocked = told.where("block AND NOT coalesce(allow, false)").select("root")
        blocked = members.join(blocked, "root", "left_semi").select(F.col("node").alias(node), F.lit("block").alias(by))
        out = out.join(blocked, (F.col(key) == F.col(node)) & own.isNull(), "left")
        by_alias = F.col(by)
    return out.select(
        *[f"`{c}`" for c in pages.columns], host, path, F.col(f"{found}.rule").alias(rule), F.coalesce(own, by_alias, F.lit("allow")).alias(verdict)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: all pages, the four rules."""
    return filter_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    host = lambda u: f"translate(regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}')"
    path = lambda u: f"regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's')"
    alias = lambda u: f"{host(u)} || regexp_extract({u}, '^.*?://[^/?#]*([^#]*)', 1, 's')"
    fits = lambda h, p, x: f"(({x}.host = '{h}' OR ends_with({x}.host, '.{h}')) AND starts_with({x}.path, '{p}'))"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda x, k: "CASE " + " ".join(f"WHEN {fits(h, p, x)} THEN '{h + p if k else v}'" for v, h, p in ordered) + " END"
    value = lambda name: rf"""regexp_replace(regexp_replace(regexp_extract(tag, '\s{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1, 'is'), '^["'']|["'']$', '', 'g'), '&amp;', '&', 'g')"""
    return rf"""
WITH RECURSIVE u AS (SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN {host("url")} ELSE '' END AS host, CASE WHEN contains(url, '://') THEN {path("url")} ELSE '' END AS path,
    CASE WHEN contains(url, '://') THEN {alias("url")} END AS alias FROM pages),
tags AS (SELECT url, alias, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->|<script\b.*?</script\s*>', ' ', 'gis'), '<(?:link|meta)\s[^>]*>', 0, 'is')) AS tag FROM u WHERE alias IS NOT NULL AND regexp_matches(html, 'canonical|http-equiv', 'i')),
l AS (SELECT url, alias, trim(CASE WHEN regexp_matches(tag, '^<link', 'i') AND list_contains(string_split(lower({value("rel")}), ' '), 'canonical') THEN {value("href")}
    WHEN regexp_matches(tag, '^<meta', 'i') AND lower({value("http-equiv")}) = 'refresh' THEN regexp_extract({value("content")}, 'url\s*=\s*["'']?\s*([^"'']*)', 1, 'is') END) AS link FROM tags),
t AS (SELECT alias AS a, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN regexp_extract(url, '^(.*?:)//', 1, 's') || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || link WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:|^#') THEN NULL
    WHEN starts_with(link, '?') THEN regexp_extract(url, '^(.*?://[^?#]*)', 1, 's') || link
    ELSE regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || coalesce(nullif(regexp_extract(url, '^.*?://[^/?#]*([^?#]*/)', 1, 's'), ''), '/') || link END AS target FROM l WHERE link <> ''),
e AS (SELECT a, {alias("target")} AS b FROM t WHERE target IS NOT NULL), both_ways AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
n AS (SELECT a, b, {host("'x://' || b")} AS host, {path("'x://' || b")} AS path FROM reach),
v AS (SELECT a, {case("n", 0)} AS verdict FROM n), told AS (SELECT a FROM v GROUP BY a HAVING bool_or(verdict = 'block') AND NOT coalesce(bool_or(verdict = 'allow'), false))
SELECT page_id, host, path, {case("u", 1)} AS rule, coalesce({case("u", 0)}, CASE WHEN told.a IS NOT NULL THEN 'block' END, 'allow') AS verdict FROM u LEFT JOIN told ON told.a = u.alias
"""


SQL = _sql()
