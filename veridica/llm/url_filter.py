"""URL filter with redirect equivalence.

A rule (host, path, verdict) fits a url on its host or a subdomain whose path starts with the
rule's; the longest fitting rule (host plus path) wins. Urls joined by redirects or canonical
links are one resource: connected components carry block decisions to the aliases that no rule
fits. Explicit allow has precedence: a page that a rule allows stays allowed, and a component with
an explicitly allowed page blocks none of its unruled pages.

Links may be relative: they are resolved against the page's url, dot segments included. A base
element is not looked at.

Defined results: a null url, or one without `://`, has empty host and path, fits no rule and has
no links, as it names no resource; of equally long rules allow wins; repeated rows each get
their row; pages' other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridica.llm.graph import connected_components

#: Fixed values of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def split_url(df: DataFrame) -> DataFrame:
    """df (with url) plus host and path."""
    rest = F.coalesce(F.when(F.instr("url", "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def judge(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """df (with host and path) plus rule and rule_verdict; the rules are a fixed list in the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, kind in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[2] == "allow")):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def resource(url: Column) -> Column:
    """What links compare: the url without scheme and fragment, host in lower case; null without `://`."""
    rest = F.regexp_extract(url, r"(?s)^[^:/?#]*://([^#]*)", 1)
    host = F.regexp_extract(rest, r"^[^/?]*", 0)
    return F.when(rest != "", F.concat(F.lower(host), F.substring(rest, F.length(host) + 1, F.length(rest))))


def resolved(base: Column, target: Column) -> Column:
    """target as an absolute url: with its own scheme, or relative to the host, the root, the folder or the page of base."""
    scheme = F.regexp_extract(base, r"^([^:/?#]*://)", 1)
    rest = F.regexp_extract(base, r"(?s)^[^:/?#]*://([^?#]*)", 1)
    host = F.regexp_extract(rest, r"^[^/]*", 0)
    page = F.substring(rest, F.length(host) + 1, F.length(rest))
    folder = F.concat(F.regexp_extract(page, r"^(.*/)", 1), F.when(page.contains("/"), F.lit("")).otherwise(F.lit("/")))
    asked = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    query = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    path = F.when(asked == "", page).when(asked.startswith("/"), asked).otherwise(F.concat(folder, asked))
    parts = F.split(path, "/")
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda kept, part: F.when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(part == ".", kept).otherwise(F.concat(kept, F.array(part))))
    slash = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    inside = F.concat(scheme, host, F.array_join(walked, "/"), slash, query)
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(F.regexp_replace(scheme, "//$", ""), target)).when(~target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), inside)


def page_links(pages: DataFrame) -> DataFrame:
    """(u, v): resources joined by a canonical link or a refresh redirect in the html."""
    tags = F.regexp_extract_all("html", F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    linked = pages.where(F.col("html").ilike("%canonical%") | F.col("html").ilike("%http-equiv%")).where(F.instr("url", "://") > 0).select("url", F.explode(tags).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"(?i)rel\s*=\s*[\"']?canonical"), F.regexp_extract("tag", r"(?i)href\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.when(F.col("tag").rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh"), F.regexp_extract("tag", r"(?i)url\s*=\s*[\"']?([^\"'\s>]+)", 1))
    named = linked.withColumn("target", F.nullif(F.coalesce(canonical, refresh), F.lit(""))).where("target is not null")
    return named.select(resource(F.col("url")).alias("u"), resource(resolved(F.col("url"), F.col("target"))).alias("v")).where("u is not null and v is not null")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, alias_of (the component's first resource).

    redirects: further pairs of urls (source, target). Components and their decisions are
    aggregated before the join, so that a component of any size moves as one row per url.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(resource(F.col("source")).alias("u"), resource(F.col("target")).alias("v")))
    components = connected_components(links)
    judged = judge(split_url(pages.select("page_id", "url")), rules).withColumn("id", resource(F.col("url")))
    named = judged.where("id is not null")
    decided = named.join(components, "id").groupBy("component").agg(F.bool_or(F.col("rule_verdict") == "block").alias("blocked"), F.bool_or(F.col("rule_verdict") == "allow").alias("allowed"))
    inherited = F.when(F.col("blocked") & ~F.coalesce("allowed", F.lit(False)), "block").otherwise("allow")
    by_id = components.join(decided, "component").select("id", "component", inherited.alias("inherited"))
    # pages without a resource, or a component, meet in no join key
    linked = named.join(by_id, "id", "left").unionByName(judged.where("id is null"), allowMissingColumns=True)
    return linked.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "inherited", F.lit("allow")).alias("verdict"), F.coalesce("component", "id").alias("alias_of"))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
s AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(h, q, kind) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT page_id, max_by(h || q, length(h || q)) AS rule, max_by(kind, length(h || q)) AS kind
      FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT s.page_id, host, path, rule, coalesce(kind, 'allow') AS verdict FROM s LEFT JOIN f USING (page_id)
"""
