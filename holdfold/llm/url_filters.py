"""URL block and allow rules that follow redirects and canonical links.

DataFrame functions only.  A rule is (host, path, action): it fits a URL whose host is
the rule's or a subdomain of it and whose path starts with the rule's path; the longest
fitting rule wins (host and path together; of equally long ones the smaller string).
Aliases are found as connected components over links between normalised addresses.
Within a component an explicit allow comes before a block, and both reach every alias
that no rule of its own decides; what nothing reaches is allowed.

A page's links are the targets of all its canonical tags and refresh redirects, with the
usual character references decoded, against the page's own address: absolute, scheme-relative,
rooted, relative to the page's folder (dot segments resolved), or a query alone.  A fragment
alone leads nowhere.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no
rule and has no aliases; repeated rows each get a row; an empty table gives an empty
result; further columns of the input are ignored, whatever their names.  A page's html is
searched where it lies, in one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Up to so many rules are tested in the row; more are joined on host suffixes.
INLINE_RULES = 64

#: Query parameters that say where a visitor came from, not which page it is (fixed values).
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def normal_form(url: Column) -> Column:
    """Key under which the spellings of one address meet; null without a scheme.

    Scheme, fragment, a leading ``www.``, ``m.`` or ``amp.``, tracking parameters and a
    last slash don't count.
    """
    rest = after_scheme(url)
    host = F.regexp_replace(host_of(url), r"^(?:(?:www|m|amp)\.)(?=[^.]+\.)", "")
    path = F.regexp_replace(path_of(url), r"/$", "")
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.concat(F.lit("&"), query), rf"&(?:{TRACKING})=[^&]*", "")
    kept = F.regexp_replace(kept, r"^&+|&+$", "")
    return F.when(rest.isNotNull(), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


#: Character references that addresses are written with, and what they stand for (fixed values).
REFERENCES = (("&quot;|&#34;|&#x22;", '"'), ("&apos;|&#39;|&#x27;", "'"), ("&#47;|&#x2f;|&sol;", "/"), ("&#58;|&#x3a;|&colon;", ":"), ("&#63;|&#x3f;|&quest;", "?"), ("&#61;|&#x3d;|&equals;", "="), ("&amp;|&#38;|&#x26;", "&"))


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    value = F.regexp_replace(F.regexp_replace(found, rf"(?i)^\s{name}\s*=\s*", ""), "^[\"']|[\"']$", "")
    for pattern, char in REFERENCES:
        value = F.regexp_replace(value, f"(?i){pattern}", char)
    return F.nullif(F.trim(value), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path from the root with its dot segments resolved."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda out, x: F.when(x == ".", out).when(x == "..", F.when(F.size(out) > 1, F.slice(out, 1, F.size(out) - 1)).otherwise(out)).otherwise(F.concat(out, F.array(x))),
    )
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))


def absolute(target: Column, base: Column) -> Column:
    """A link's target against the page's URL; null for a fragment alone and for other schemes without ``://``."""
    scheme = F.substring_index(base, "://", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(after_scheme(base), r"^[^/?#]*", 0))
    path = path_of(base)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/?(.*/)?[^/]*$", 1))
    tail = F.regexp_extract(target, r"[?#].*$", 0)
    own = F.regexp_extract(target, r"^[^?#]*", 0)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("/"), F.concat(root, without_dots(own), tail))
        .when(target.startswith("?"), F.concat(root, path, target))
        .otherwise(F.concat(root, without_dots(F.concat(folder, own)), tail))
    )


def links_of(html: Column) -> Column:
    """Targets of all canonical links and refresh redirects in a page, as an array without nulls."""
    canonical = F.regexp_extract_all(html, F.lit(r"(?i)<link\s(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*>"), F.lit(0))
    refresh = F.regexp_extract_all(html, F.lit(r"(?i)<meta\s(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*>"), F.lit(0))
    of_refresh = lambda tag: F.nullif(F.regexp_extract(_attribute(tag, "content"), r"(?i)url\s*=\s*[\"']?([^\"'\s]+)", 1), F.lit(""))
    return F.array_distinct(F.array_compact(F.concat(F.transform(canonical, lambda tag: _attribute(tag, "href")), F.transform(refresh, of_refresh))))


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) URLs that the pages themselves declare equal or redirect to."""
    tagged = pages.where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)\b(?:canonical|refresh)\b"))
    found = tagged.select("url", F.explode(links_of(F.col("html"))).alias("to"))
    return found.select(F.col("url").alias("src"), absolute(F.col("to"), F.col("url")).alias("dst")).where("dst is not null")


def own_rule(urls: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, key: str = "key") -> DataFrame:
    """``urls`` (key, host, path) with the columns rule and action of the longest rule that fits, else null."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= INLINE_RULES:
            host, path = F.col("host"), F.col("path")
            fits = [
                F.when(
                    ((host == h) | host.endswith("." + h)) & path.startswith(p),
                    F.struct(F.lit(-len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(action).alias("action")),
                )
                for h, p, action in rules
            ]
            if not fits:
                return urls.withColumns({"rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})
            best = F.array_min(F.array_compact(F.array(*fits)))
            return urls.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "action": F.col("_best.action")}).drop("_best")
        rules = urls.sparkSession.createDataFrame(list(rules), "host string, path string, action string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    wide = urls.select(key, "path", F.explode(suffixes).alias("suffix"))
    right = rules.select(F.col("host").alias("suffix"), F.col("path").alias("_p"), F.col("action").alias("_a"))
    hit = wide.join(right, "suffix").where(F.col("path").startswith(F.col("_p")))
    rule = F.concat("suffix", "_p")
    best = hit.groupBy(key).agg(F.min(F.struct((-F.length(rule)).alias("n"), rule.alias("rule"), F.col("_a").alias("action"))).alias("_best"))
    return urls.join(best, key, "left").withColumns({"rule": F.col("_best.rule"), "action": F.col("_best.action")}).drop("_best")


def judge(pages: DataFrame, rules, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, host, path, rule, verdict.

    ``redirects``: further (src, dst) URLs, such as a crawler's log of HTTP redirects.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    url = F.col("url")
    links = page_links(pages)
    if redirects is not None:
        links = links.union(redirects.select("src", "dst"))
    pairs = links.select("src", "dst").where("src is not null and dst is not null").distinct()
    pairs = scratch.write(pairs, "links")
    rows = pages.select("page_id", "url").withColumns({"host": host_of(url), "path": path_of(url), "node": normal_form(url)})
    if isinstance(rules, DataFrame) or len(rules) > INLINE_RULES:
        rows = rows.withColumn("key", F.concat_ws("\u0000", "host", "path"))
        judged = own_rule(rows.select("key", "host", "path").distinct(), rules).select("key", "rule", "action")
        rows = rows.join(judged, "key", "left").drop("key")
    else:
        rows = own_rule(rows, rules)
    flags = [F.max(F.col("action") == "allow").alias("allows"), F.max(F.col("action") == "block").alias("blocks")]
    seen = rows.where("node is not null and action is not null").select("node", "action")
    if pairs.limit(1).count():
        ends = pairs.select(F.explode(F.array("src", "dst")).alias("url")).distinct()
        ends = ends.withColumns({"host": host_of(url), "path": path_of(url), "node": normal_form(url)}).where("node is not null")
        ends = own_rule(ends.withColumn("key", url), rules)
        seen = seen.union(ends.where("action is not null").select("node", "action"))
        by_url = ends.select("url", "node")
        number = scratch.write(ends.select("node").distinct().select("node", F.monotonically_increasing_id().alias("id")), "nodes")
        ids = by_url.join(number, "node").select("url", "id")
        edges = pairs.join(ids.select(F.col("url").alias("src"), F.col("id").alias("a")), "src").join(ids.select(F.col("url").alias("dst"), F.col("id").alias("b")), "dst")
        parts = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch)
        group = number.join(parts, number.id == parts.node).select(number.node, "component")
        by_node = seen.groupBy("node").agg(*flags)
        by_part = by_node.join(group, "node").groupBy("component").agg(F.max("allows").alias("allows"), F.max("blocks").alias("blocks"))
        linked = group.join(by_part, "component").select("node", "allows", "blocks")
        flagged = by_node.union(linked).groupBy("node").agg(F.max("allows").alias("allows"), F.max("blocks").alias("blocks"))
    else:
        flagged = seen.groupBy("node").agg(*flags)
    alone = F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))  # meets nothing, and no two meet in one task
    out = rows.withColumn("node", F.coalesce("node", alone)).join(flagged, "node", "left")
    verdict = F.coalesce("action", F.when(F.col("allows"), "allow").when(F.col("blocks"), "block"), F.lit(default))
    return out.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"))
