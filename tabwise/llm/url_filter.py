"""URL filter with redirect equivalence.

Explicit rules judge a url by host and path, the longest rule winning.  Urls
without a rule of their own take the verdict of their alias class: connected
components over redirect (meta refresh) and canonical-link edges.  A blocked
member blocks the class; an explicitly allowed member takes precedence over
that.  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabwise.llm.components import connected_components
from tabwise.llm.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none or the url is null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(rest: Column) -> Column:
    """Lower-cased host of what follows the scheme."""
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def node(rest: Column) -> Column:
    """Key of a url as a place: host and port, path and query, without scheme and fragment; null if there is no host."""
    return F.when(rest != "", F.concat(host(rest), F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1), r"^(?=\?|$)", "/")))


def matching_rule(host_col: Column, path_col: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule (host, path, verdict), or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    return F.coalesce(*[
        F.when(((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p),
               F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in ordered])


def resolved(target: Column, rest: Column) -> Column:
    """What follows the scheme in ``target``, resolved against a base url; null when empty or not a web address."""
    root = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    folder = F.regexp_extract(rest, r"^[^/?#]*([^?#]*/)", 1)
    return (F.when((target == "") | target.rlike("(?i)^(javascript|mailto|data|tel):"), None)
            .when(target.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), after_scheme(target))
            .when(target.startswith("//"), F.substring(target, 3, 1 << 30))
            .when(target.startswith("/"), F.concat(root, target))
            .when(target.startswith("#"), rest)
            .when(target.startswith("?"), F.concat(root, path(rest), target))
            .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), target)))


_ATTRIBUTE = r"""(?is)\b{0}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def attribute(tag: Column, name: str) -> Column:
    pattern = _ATTRIBUTE.format(name)
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def alias_edges(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): node of each page and node of its canonical link or refresh target.

    Tags, targets and nodes are small tables of their own: in one plan the
    optimiser would write the nested expressions out many times over.
    """
    tags = scratch.write(
        pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)canonical|refresh"))
        .select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))).alias("tag")), "tags")
    tag = F.col("tag")
    canonical = tag.rlike("(?i)^<link") & attribute(tag, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")
    refresh = tag.rlike("(?i)^<meta") & (F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh")
    found = (F.when(canonical, attribute(tag, "href"))
             .when(refresh, F.regexp_extract(attribute(tag, "content"), r"(?is)url\s*=\s*[\"']?([^\"']*)", 1)))
    targets = scratch.write(tags.select(after_scheme(F.col("url")).alias("rest"),
                                        F.trim(F.replace(found, F.lit("&amp;"), F.lit("&"))).alias("target")), "targets")
    places = scratch.write(targets.where("rest <> '' AND target <> ''")
                           .select("rest", resolved(F.col("target"), F.col("rest")).alias("to")), "places")
    return places.select(node(F.col("rest")).alias("a"), node(F.col("to")).alias("b"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages (page_id, url, html)``: page_id, host, path, rule, verdict, via.

    ``edges (a, b)`` may add redirects known from elsewhere, as node keys (see
    ``node``).  ``rule`` is the page's own rule or null, ``via`` says what
    decided: rule, class or default (allow).  A url that is null or has no
    ``://`` has empty host and path, fits no rule and has no aliases.  A null
    html gives no edges.  Repeated rows are judged alike; an empty table gives
    none.  ``rules`` is a short list: it becomes one expression.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    found = alias_edges(pages, scratch)
    if edges is not None:
        found = found.unionByName(edges.select("a", "b"))
    own = matching_rule(F.col("host"), F.col("path"), rules)
    judged = (pages.select("page_id", F.coalesce(after_scheme(F.col("url")), F.lit("")).alias("_rest"))
              .select("page_id", host(F.col("_rest")).alias("host"), path(F.col("_rest")).alias("path"), node(F.col("_rest")).alias("_node"))
              .withColumn("_own", own))
    classes = connected_components(found, scratch)
    if classes.isEmpty():
        judged = judged.withColumn("_class", F.lit(None).cast("string"))
    else:
        # The verdict of a class: any member's explicit allow, else any member's block.
        members = classes.withColumns({"host": host(F.col("node")), "path": path(F.col("node"))})
        by_class = members.withColumn("v", own["verdict"]).where("v IS NOT NULL").groupBy("component").agg(F.min("v").alias("_class"))
        named = members.join(by_class, "component").select(F.col("node").alias("_node"), "_class")
        judged = judged.join(named, "_node", "left")
    return judged.select(
        "page_id", "host", "path", F.col("_own.rule").alias("rule"),
        F.coalesce("_own.verdict", "_class", F.lit("allow")).alias("verdict"),
        F.when(F.col("_own").isNotNull(), "rule").when(F.col("_class").isNotNull(), "class").otherwise("default").alias("via"))
