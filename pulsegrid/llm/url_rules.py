"""URL filtering with redirect equivalence.

Block and allow rules are matched by host suffix and path prefix. An address is a node by its host, path and query; scheme,
fragment and slashes at the end of the path don't make another one. Redirects and canonical links (rel=canonical and meta
refresh of a page, a table of redirects where there is one, and the address without tracking parameters, which names the
same page) are edges between nodes; a connected component is one page under several addresses. A URL without a rule takes
its component's decision: allowed if any member is allowed by a rule, else blocked if any member is blocked by one, else the
default. A node without edges is a component as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import Scratch, fresh, without
from pulsegrid.llm.components import components

#: Up to this many rules are broadcast to the join with the hosts; more are shuffled to them.
BROADCAST_RULES = 100_000
#: Query parameters that say where a visitor came from, and not which page is meant.
TRACKING = "(utm_[a-z_]+|gclid|fbclid|msclkid|igshid|ref|ref_src)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PRODUCTION_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))

LINK_TAG = r"(?is)<link\b[^>]*\brel\s*=\s*[\x22']?canonical\b[^>]*>"
REFRESH_TAG = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\x22']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\x22']?([^\x22'\s>]+)"
#: With or without a quote before the target, inside that of the attribute.
REFRESH_TARGET = r"(?is)\burl\s*=\s*[\x22']?([^\x22'\s>;]+)"


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The URL as a node: host, path without slashes at its end, query; neither scheme nor fragment. Null without ://."""
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), path, query))


def _without_dots(path: Column) -> Column:
    """A path that begins with / after its . and .. segments are resolved."""
    step = lambda kept, part: F.when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))
    parts = F.aggregate(F.split(F.substring(path, 2, 1 << 30), "/"), F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(parts, "/"))).otherwise(path)


def target_of(link: Column, url: Column) -> Column:
    """A link as an absolute URL: as it is, or resolved against the page's host and directory; null for other schemes."""
    start = F.concat(F.lit("http://"), host_of(url))
    path, tail = F.regexp_extract(link, r"^[^?#]*", 0), F.regexp_extract(link, r"[?#].*$", 0)
    folder = F.regexp_replace(path_of(url), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    own = F.concat(start, path_of(url), F.when(tail.startswith("#"), F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)).otherwise(""), tail)
    return (
        F.when(F.coalesce(link, F.lit("")) == "", None)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(start, _without_dots(path), tail))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(path == "", own)
        .otherwise(F.concat(start, _without_dots(F.concat(folder, path)), tail))
    )


def plain_of(node: Column) -> Column:
    """A node without its tracking parameters."""
    query = F.regexp_extract(node, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^{TRACKING}(=|$)"))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(node.contains("?"), F.concat(F.regexp_extract(node, r"^[^?]*", 0), tail)).otherwise(node)


def match_rules(addresses: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """host, path, rule, verdict of the addresses (host, path; each once) that some rule fits: the longest, allow before
    block among equals.

    A host is looked up by all its suffixes, so the work grows with the labels of a host and not with the rules.
    """
    known = addresses.sparkSession.createDataFrame(list(rules), "suffix string, prefix string, verdict string")
    known = F.broadcast(known) if len(rules) <= BROADCAST_RULES else known
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = addresses.select("host", "path", F.explode(suffixes).alias("suffix")).join(known, "suffix").where(F.startswith("path", "prefix"))
    rule = F.concat("suffix", "prefix")
    best = F.max(F.struct(F.length(rule).alias("size"), (F.col("verdict") == "allow").alias("allows"), rule.alias("rule"), F.col("verdict").alias("verdict")))
    return fits.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def link_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(a_url, b_url) from all canonical links and refresh targets of the pages."""
    html, url = F.col(html_col), F.col(url_col)
    targets = lambda tag, pattern: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, pattern, 1))
    tags = pages.where(html.rlike(LINK_TAG) | html.rlike(REFRESH_TAG)).select(url.alias("a_url"), F.explode(F.concat(targets(LINK_TAG, HREF), targets(REFRESH_TAG, REFRESH_TARGET))).alias("link"))
    return tags.select("a_url", target_of(F.col("link"), F.col("a_url")).alias("b_url")).where("a_url is not null and b_url is not null")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], scratch: Scratch, *, url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """`pages` without its HTML, with host, path, rule, verdict and component (the smallest node of its component).

    `redirects` has from_url and to_url. A null URL, or one without ://, has an empty host and path, fits no rule, has
    no component and gets the default. Repeated rows are each judged; a column of the input that has the name of a new
    one is replaced. The result has as many rows as the input.
    """
    names = ("host", "path", "rule", "verdict", "component")
    kept = without(pages, "host", "path", "rule", "verdict", "component", html_col.lower() if html_col else "")
    node, own, most, comp = fresh(pages, "url_node", "own_verdict", "comp_verdict", "comp_name")
    named = lambda url: [host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node")]
    urls = pages.select(F.col(url_col).alias("u"))
    edges = urls.select(node_of(F.col("u")).alias("a")).where("a is not null").select("a", plain_of(F.col("a")).alias("b")).where("a <> b")
    if html_col or redirects is not None:
        found = [link_edges(pages, url_col, html_col)] if html_col else []
        if redirects is not None:
            found.append(redirects.select(F.col("from_url").alias("a_url"), F.col("to_url").alias("b_url")))
        links = scratch.write(found[0] if len(found) == 1 else found[0].unionByName(found[1]), "links")
        urls = urls.union(links.select(F.explode(F.array("a_url", "b_url"))))
        edges = edges.union(links.select(node_of(F.col("a_url")), node_of(F.col("b_url"))))
    # All addresses once; what is joined to pages below has been written, so that a frequent address can be split.
    addresses = scratch.write(urls.select(*named(F.col("u"))).where("node is not null").distinct(), "addresses")
    fits = scratch.write(match_rules(addresses.select("host", "path").distinct(), rules), "fits")
    member = scratch.write(components(edges, scratch, "aliases"), "member")
    rank = F.max(F.when(F.col("verdict") == "allow", 2).when(F.col("verdict") == "block", 1))
    by_node = scratch.write(addresses.join(fits, ["host", "path"], "left").groupBy("node").agg(rank.alias("r")), "by_node")
    placed = scratch.write(by_node.join(member, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "r"), "placed")
    decided = scratch.write(placed.where("r is not null").groupBy("component").agg(F.max("r").alias("most")), "decided")
    verdict = F.when(F.col("most") == 2, "allow").when(F.col("most") == 1, "block")
    aliases = scratch.write(placed.join(decided, "component", "left").select(F.col("node").alias(node), F.col("component").alias(comp), verdict.alias(most)), "decisions")
    scratch.drop("addresses", "member", "by_node", "placed", "decided")
    url = F.col(url_col)
    judged = pages.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias(node))
    with_address = judged.where(F.col(node).isNotNull()).join(fits.withColumnRenamed("verdict", own), ["host", "path"], "left").join(aliases, node, "left")
    first = with_address.select(*kept, "host", "path", "rule", F.coalesce(own, most, F.lit(default)).alias("verdict"), F.col(comp).alias("component"))
    # Rows without an address meet no table: their missing node is no key.
    none = F.lit(None).cast("string")
    return first.unionByName(judged.where(F.col(node).isNull()).select(*kept, "host", "path", none.alias("rule"), F.lit(default).alias("verdict"), none.alias("component")))


def _sql_rules(rules: Sequence[tuple[str, str, str]]) -> str:
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)


_SQL_HOST = "translate(coalesce(regexp_extract({u}, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_PATH = "coalesce(regexp_extract({u}, '://[^/?#]*([^?#]*)', 1), '')"
_SQL_NODE = f"case when contains({{u}}, '://') then {_SQL_HOST} || regexp_replace({_SQL_PATH}, '/+$', '') || regexp_extract({{u}}, '://[^?#]*(\\?[^#]*)', 1) end"


def _sql_dots(path: str) -> str:
    """SQL for a path that begins with / after its . and .. segments are resolved."""
    steps = f"list_reduce(list_transform(string_split(substr({path}, 2), '/'), lambda s: [s]), lambda kept, s: case when s = ['..'] then kept[1:greatest(len(kept) - 1, 0)] when s = ['.'] then kept else list_concat(kept, s) end, []::varchar[])"
    return f"case when regexp_matches({path}, '/\\.\\.?(/|$)') then '/' || array_to_string({steps}, '/') else {path} end"


def oracle(rules: Sequence[tuple[str, str, str]] = PRODUCTION_RULES) -> str:
    link, refresh, href, to = (v.replace("'", "''") for v in (LINK_TAG, REFRESH_TAG, HREF, REFRESH_TARGET))
    targets = lambda tag, pattern: f"list_transform(regexp_extract_all(html, '{tag}', 0), lambda t: regexp_extract(t, '{pattern}', 1))"
    host, path = _SQL_HOST.format(u="a_url"), _SQL_PATH.format(u="a_url")
    return f"""
with recursive rules(h, p, v) as (values {_sql_rules(rules)}),
tags as (select url as a_url, unnest(list_concat({targets(link, href)}, {targets(refresh, to)})) as link from pages where url is not null and html is not null),
parts as (
  select a_url, link, 'http://' || {host} as start, {path} as own, regexp_replace({path}, '[^/]*$', '') as folder,
    regexp_extract(link, '^[^?#]*', 0) as lpath, regexp_extract(link, '[?#].*$', 0) as tail, regexp_extract(a_url, '://[^?#]*(\\?[^#]*)', 1) as query
  from tags where link <> ''),
joined as (select *, case when folder = '' then '/' else folder end || lpath as full_path from parts),
targets as (
  select a_url, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link when starts_with(link, '//') then 'http:' || link
    when starts_with(link, '/') then start || {_sql_dots("lpath")} || tail
    when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
    when lpath = '' then start || own || case when starts_with(tail, '#') then query else '' end || tail
    else start || {_sql_dots("full_path")} || tail end as b_url
  from joined),
links as (select a_url, b_url from targets where b_url is not null),
urls as (select url as u from pages union select a_url from links union select b_url from links),
fit as (
  select u, {_SQL_NODE.format(u="u")} as node, max_by(h || p, length(h || p)) as rule, max_by(v, length(h || p)) as v
  from urls left join rules on ({_SQL_HOST.format(u="u")} = h or ends_with({_SQL_HOST.format(u="u")}, '.' || h)) and starts_with({_SQL_PATH.format(u="u")}, p)
  group by u),
own as (select distinct node from fit where contains(node, '?')),
kept as (select node, list_filter(string_split(regexp_extract(node, '\\?(.*)$', 1), '&'), lambda q: q <> '' and not regexp_matches(lower(q), '^{TRACKING}(=|$)')) as q from own),
plain as (select node as a, regexp_extract(node, '^[^?]*', 0) || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end as b from kept),
pairs as (
  select a.node as a, b.node as b from links join fit a on a.u = a_url join fit b on b.u = b_url where a.node is not null and b.node is not null
  union select a, b from plain where a <> b),
edges as (select a, b from pairs union select b, a from pairs),
reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a),
comp as (select a as node, least(a, min(b)) as component from reach group by a),
verdicts as (
  select coalesce(component, node) as component, max(case v when 'allow' then 2 when 'block' then 1 end) as r
  from fit left join comp using (node) where node is not null group by 1)
select p.page_id, {_SQL_HOST.format(u="p.url")} as host, {_SQL_PATH.format(u="p.url")} as path, f.rule,
  coalesce(f.v, case s.r when 2 then 'allow' when 1 then 'block' end, 'allow') as verdict, coalesce(c.component, f.node) as component
from pages p left join fit f on f.u is not distinct from p.url left join comp c on c.node = f.node left join verdicts s on s.component = coalesce(c.component, f.node)
"""
