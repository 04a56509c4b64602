"""URL filter: rules on host and path, carried to aliases over redirect and canonical-link edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm.shared import LOWER, UPPER, connected_components, materialise

#: The rules of the query, as host, path, action.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Query fields that only track visits.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)="


def _after(url: Column) -> Column:
    """What follows the first `://`; empty for null or without it."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def plain_url(url: Column) -> Column:
    """The address with scheme and host in lower case and without fragment."""
    at, after = F.locate("://", url), F.split(_after(url), "#", 2)[0]
    return F.concat(F.translate(F.substring(url, F.lit(1), at + 2), UPPER, LOWER), url_host(url), F.substring(after, F.length(url_host(url)) + 1, F.length(after)))


def resolved(base: Column, target: Column) -> Column:
    """The address a link target names on the page `base`; null for other schemes, fragments and empty targets."""
    target = F.regexp_replace(F.trim(target), "(?i)&(amp|#38|#x26);", "&")
    scheme, after = F.substring(base, F.lit(1), F.locate("://", base) - 1), F.split(_after(base), r"[?#]", 2)[0]
    host = F.regexp_extract(after, r"^[^/]*", 0)
    folder = F.regexp_extract(after, r"^[^/]*(/.*)?/", 0)
    rest = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), _after(target))
        .when(F.startswith(target, F.lit("//")), F.substring(target, F.lit(3), F.length(target)))
        .when(target.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|#|$)"), F.lit(None))
        .when(F.startswith(target, F.lit("/")), F.concat(host, target))
        .when(F.startswith(target, F.lit("?")), F.concat(after, target))
        .otherwise(F.concat(F.when(folder == "", F.concat(host, F.lit("/"))).otherwise(folder), target))
    )
    own = F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.regexp_extract(target, r"^[^:]*", 0)).otherwise(scheme)
    path, tail = F.regexp_extract(rest, r"^[^?#]*", 0), F.regexp_extract(rest, r"[?#].*$", 0)
    steps = F.split(path, "/", -1)
    up = lambda acc, x: F.when(x == "..", F.regexp_replace(acc, r"/[^/]*$", "")).when(x == ".", acc).otherwise(F.concat(acc, F.lit("/"), x))
    return F.concat(own, F.lit("://"), F.aggregate(F.slice(steps, F.lit(2), F.greatest(F.size(steps), F.lit(1))), steps[0], up), tail)


def canonical_url(url: Column) -> Column:
    """The address a site would name as canonical: https, no `www.` or `m.`, fragment, tracking fields or last slash."""
    after = F.split(_after(url), "#", 2)[0]
    query = F.split(after, r"\?", 2)
    fields = F.sort_array(F.filter(F.split(F.coalesce(F.get(query, F.lit(1)), F.lit("")), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    host, path = url_host(url), F.regexp_replace(url_path(url), "/+$", "")
    return F.concat(F.lit("https://"), F.regexp_replace(host, r"^(www|m)\.", ""), path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(F.lit("")))


#: Tags that name another address for the page, their attribute that says so, and where the address is.
_CANONICAL = r"""(?is)\srel\s*=\s*("([^"]*\s)?canonical[\s"]|'([^']*\s)?canonical[\s']|canonical[\s/>])"""
_REFRESH = r"""(?is)\shttp-equiv\s*=\s*["']?refresh["'\s/>]"""
_HREF = r"""(?is)\shref\s*=\s*["']?([^"'\s>]*)"""
_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>;]*)"""


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html", canonical_forms: bool = True) -> DataFrame:
    """`(a, b)`: each url with its own form and with the form of every canonical and refresh target.

    Targets are read from all `link` and `meta` tags and resolved against the page's url. Both ends get the same
    form: the canonical one, in which sites write one page's variants alike (a source of edges of its own), or the
    plain one if `canonical_forms` is false.
    """
    url, html = F.col(f"`{url_col}`"), F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    form = canonical_url if canonical_forms else plain_url
    tags = lambda name, says, where: F.transform(F.filter(F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0)), lambda t: t.rlike(says)), lambda t: F.regexp_extract(t, where, 1))
    targets = F.concat(tags("link", _CANONICAL, _HREF), tags("meta", _REFRESH, _URL))
    known = pages.where(F.locate("://", url) > 0)
    found = known.select(url.alias("a"), F.explode(F.concat(F.array(url), F.transform(targets, lambda t: resolved(url, t)))).alias("to"))
    return found.where("to is not null").select("a", form(F.col("to")).alias("b")).where("a <> b").distinct()


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rules table `(host, path, action)` from literals."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in rules])))


def match_rules(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds `host`, `path`, `rule` and `action` of the longest rule that fits (null if none).

    Hosts are resolved first, each once: the suffixes of a host at its dots meet the rules by equality, and
    the host keeps the list of its rules. Pages then meet their host. Of rules with equal host and path,
    block wins only if no allow is given.
    """
    at = pages.withColumns({"host": url_host(F.col(f"`{url_col}`")), "path": url_path(F.col(f"`{url_col}`"))})
    by_host = rules.groupBy(F.col("host").alias("__suffix")).agg(F.collect_set(F.struct(F.length(F.concat("host", "path")).alias("n"), F.concat("host", "path").alias("rule"), F.col("path").alias("start"), F.when(F.col("action") == "allow", 1).otherwise(0).alias("allow"))).alias("__rules"))
    labels = F.split("__host", r"\.", -1)
    suffixes = at.select(F.col("host").alias("__host")).distinct().select("__host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("__suffix"))
    hosts = materialise(suffixes.join(by_host, "__suffix").groupBy("__host").agg(F.flatten(F.collect_list("__rules")).alias("__rules")), "url-hosts")
    best = F.array_max(F.filter("__rules", lambda r: F.startswith(F.col("path"), r["start"])))
    return at.join(hosts, at["host"] == hosts["__host"], "left").withColumn("__best", best).withColumns({"rule": F.col("__best.rule"), "action": F.when(F.col("__best.allow") == 1, "allow").when(F.col("__best.allow") == 0, "block")}).drop("__host", "__rules", "__best")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", edges: DataFrame | None = None, canonical_forms: bool = True) -> DataFrame:
    """Judges every page: `id, host, path, rule, verdict, component`.

    A rule that fits decides. Other pages follow their class of aliases, the connected component of their
    url over redirect and canonical-link edges (from the pages themselves, see `link_edges`, and `edges(a, b)` if
    given):
    block if a page of the class is blocked by a rule and none is allowed by one, else allow. `component`
    is the smallest url of the class, the url itself if it has no alias, null for a null url.

    Pages with null urls or without `://` have empty host and path, match no rule (unless one has an empty
    host) and are allowed. Repeated rows are each judged. Other columns are not carried. One very common
    url or host meets one row of the other side, which adaptive skew joins split.
    """
    base = pages.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{url_col}`").alias("__url"), F.col(f"`{html_col}`").alias("__html"))
    judged = match_rules(base.drop("__html"), rules, "__url")
    links = link_edges(base, "__url", "__html", canonical_forms)
    if edges is not None:
        links = links.union(edges.select("a", "b")).distinct()
    classes = connected_components(links)
    ruled = judged.where("rule is not null").groupBy(F.col("__url").alias("node")).agg(F.max(F.when(F.col("action") == "block", 1).otherwise(0)).alias("block"), F.max(F.when(F.col("action") == "allow", 1).otherwise(0)).alias("allow"))
    state = classes.join(ruled, "node").groupBy("label").agg(F.max("block").alias("block"), F.max("allow").alias("allow"))
    nodes = materialise(classes.join(state, "label", "left").select(F.col("node").alias("__node"), "label", (F.coalesce("block", F.lit(0)) > F.coalesce("allow", F.lit(0))).alias("__blocked")), "url-classes")
    out = judged.join(nodes, F.col("__url") == F.col("__node"), "left")
    verdict = F.when(F.col("action").isNotNull(), F.col("action")).when(F.col("__blocked"), "block").otherwise("allow")
    return out.select(F.col("__id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.coalesce("label", "__url").alias("component"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return filter_urls(pages, rule_table(spark, RULES))


_AFTER = "CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END"
ORACLE = f"""
WITH RECURSIVE p AS (SELECT page_id, url, coalesce(html, '') AS html, {_AFTER} AS rest FROM pages),
h AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  list_sort(list_filter(string_split(regexp_extract(string_split(rest, '#')[1], '^[^?]*\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS fields FROM p),
c AS (SELECT *, 'https://' || regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END AS canonical FROM h),
tags AS (SELECT DISTINCT url, regexp_replace(trim(target), '(?i)&(amp|#38|#x26);', '&', 'g') AS target, rest, split_part(split_part(rest, '?', 1), '#', 1) AS bare FROM (
  SELECT url, rest, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?is)<link\\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\\srel\\s*=\\s*("([^"]*\\s)?canonical[\\s"]|''([^'']*\\s)?canonical[\\s'']|canonical[\\s/>])')), lambda t: regexp_extract(t, '(?is)\\shref\\s*=\\s*["'']?([^"''\\s>]*)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\\shttp-equiv\\s*=\\s*["'']?refresh["''\\s/>]')), lambda t: regexp_extract(t, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>;]*)', 1)))) AS target
  FROM c WHERE position('://' IN url) > 0)),
joined AS (SELECT url, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(target, position('://' IN target) + 3) WHEN target LIKE '//%' THEN substr(target, 3)
  WHEN regexp_matches(target, '^([A-Za-z][A-Za-z0-9+.-]*:|#|$)') THEN NULL WHEN target LIKE '/%' THEN split_part(bare, '/', 1) || target WHEN target LIKE '?%' THEN bare || target
  ELSE coalesce(nullif(regexp_extract(bare, '^[^/]*(/.*)?/'), ''), split_part(bare, '/', 1) || '/') || target END AS rest FROM tags),
found AS (SELECT url, list_reduce(list_concat([split_part(path, '/', 1)], string_split(path, '/')[2:]), lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN x = '.' THEN acc ELSE acc || '/' || x END) || tail AS rest
  FROM (SELECT url, regexp_extract(rest, '^[^?#]*') AS path, regexp_extract(rest, '[?#].*$') AS tail FROM joined WHERE rest IS NOT NULL)),
aim AS (SELECT url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  list_sort(list_filter(string_split(regexp_extract(string_split(rest, '#')[1], '^[^?]*\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS fields FROM found),
targets AS (SELECT url AS a, canonical AS b FROM c WHERE position('://' IN url) > 0 UNION ALL
  SELECT url, 'https://' || regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END FROM aim),
edges AS (SELECT DISTINCT a, b FROM targets WHERE b IS NOT NULL AND b <> '' AND a <> b),
sides AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT DISTINCT a AS node, a AS other FROM sides UNION SELECT r.node, s.b FROM reach r JOIN sides s ON r.other = s.a),
label AS (SELECT node, min(other) AS component FROM reach GROUP BY 1),
rules(rh, rp, action) AS (VALUES {", ".join(str(r) for r in RULES)}),
fits AS (SELECT page_id, url, html, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action FROM c JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1, 2, 3),
state AS (SELECT component, max(CASE WHEN action = 'block' THEN 1 ELSE 0 END) > max(CASE WHEN action = 'allow' THEN 1 ELSE 0 END) AS blocked FROM label JOIN fits ON node = url GROUP BY 1)
SELECT c.page_id, host, path, rule, coalesce(action, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict, coalesce(component, c.url) AS component
FROM c LEFT JOIN (SELECT DISTINCT * FROM fits) f ON f.page_id = c.page_id AND f.url = c.url AND f.html = c.html LEFT JOIN label ON node = c.url LEFT JOIN state USING (component)
"""
