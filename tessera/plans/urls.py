"""Queries over URLs of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import hops as HOPS
from .registry import query

DOMAINS, DENIED = ["example.org", "example.com"], ["spam-farm.example.org"]
PATTERNS = ["/login", "pills", "/admin"]
#: Rows that the page table lacks: ports, users, escapes, other schemes.
EXTRA = ["HTTP://WWW.Example.ORG:80//a//b/?b=2&a=1&utm_source=x#f", "https://user:pw@example.org/x", "ftp://example.org/a", "", "https://10.1.2.3/x", "http://localhost/a", "https://example.org:8443/a.PDF?x=", "https://a.b.example.net./p/q/r.html", "https://192.168.0.9/x.js", "mailto:a@b.example", "https://example.org", "https://8.8.8.8/download?id=1", "https://example.com/img/a.png?from=q&z=1"]
_LIT = ", ".join("('" + x + "')" for x in EXTRA)

URLS = f"WITH u AS (SELECT url FROM pages UNION ALL SELECT * FROM (VALUES {_LIT}) v(url)), "
# parts of a URL, written apart from the Spark expressions
P = r"""p AS (SELECT url, trim(url) AS x, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS sch, regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS auth,
  regexp_extract(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*):', ''), '^(?://[^/]*)?(.*)$', 1) AS path, regexp_extract(regexp_replace(trim(url), '#.*$', ''), '\?(.*)$', 1) AS q FROM u),
h AS (SELECT *, regexp_replace(lower(regexp_extract(regexp_replace(auth, '^.*@', ''), '^([^:]*)', 1)), '\.+$', '') AS host, regexp_extract(auth, ':([0-9]*)$', 1) AS port FROM p),
pairs AS (SELECT *, list_filter(string_split(q, '&'), lambda z: z <> '') AS kv FROM h),
c AS (SELECT *, CASE WHEN sch = '' THEN 'https' ELSE sch END AS s2, regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '/{2,}', '/', 'g') AS p2,
  array_to_string(list_sort(list_filter(kv, lambda z: lower(regexp_extract(z, '^([^=]*)', 1)) NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','from','share_token','weixin','wx','sid','sessionid','phpsessid','jsessionid','aspxsessionid') AND regexp_extract(z, '=(.*)$', 1) <> '')), '&') AS q2,
  array_to_string(list_sort(list_filter(kv, lambda z: NOT starts_with(lower(regexp_extract(z, '^([^=]*)', 1)), 'utm_') AND lower(regexp_extract(z, '^([^=]*)', 1)) NOT IN ('from', 'spm'))), '&') AS q3 FROM pairs),
k AS (SELECT *, CASE WHEN x = '' THEN '' WHEN s2 NOT IN ('http', 'https') THEN x ELSE s2 || '://' || host || CASE WHEN port = '' OR (s2 = 'http' AND port = '80') OR (s2 = 'https' AND port = '443') THEN '' ELSE ':' || port END || p2 || CASE WHEN q2 <> '' THEN '?' || q2 ELSE '' END END AS canonical,
  (host = 'example.org' OR ends_with(host, '.example.org') OR host = 'example.com' OR ends_with(host, '.example.com')) AS inside, lower(path) AS lp,
  CASE WHEN contains(lower(path), '.') THEN list_extract(string_split(lower(path), '.'), -1) ELSE '' END AS ext,
  regexp_matches(host, '^(localhost|.*\.local|(0|10|127)\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|)$') AS private FROM c) """
SKIP = "(" + ", ".join(f"'{x}'" for x in U.SKIPPED) + ")"


def urls(t):
    extra = t.spark.createDataFrame([(x,) for x in EXTRA], "url string")
    return t("pages").select("url").union(extra)


@query("url_canonicalize", URLS + P + "SELECT url, canonical FROM k")
def url_canonicalize(t):
    return urls(t).select("url", U.canonical("url").alias("canonical"))


@query("url_canonical_crawl", URLS + P + "SELECT url, sch || '://' || lower(auth) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q3 <> '' THEN '?' || q3 ELSE '' END AS canonical FROM k WHERE sch IN ('http', 'https')")
def url_canonical_crawl(t):
    return urls(t).where(U.scheme(F.col("url")).isin("http", "https")).select("url", U.canonical_crawl("url").alias("canonical"))


@query("url_match_key", URLS.rstrip(", ") + r" SELECT url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '^[a-z][a-z0-9+.-]*://', ''), '/{2,}', '/', 'g'), '/$', '') AS match_key FROM u")
def url_match_key(t):
    return urls(t).select("url", U.match_key("url").alias("match_key"))


@query("url_parts", URLS + P + f"SELECT url, host, ext AS extension, ext IN {SKIP} AS skippable FROM k")
def url_parts(t):
    return urls(t).select("url", U.host("url").alias("host"), U.extension("url").alias("extension"), U.skippable("url").alias("skippable"))


@query("host_official", URLS + P + "SELECT host, inside AND NOT (host = 'spam-farm.example.org' OR ends_with(host, '.spam-farm.example.org')) AS official, count(*) AS n FROM k GROUP BY 1, 2")
def host_official(t):
    h = U.host("url")
    return urls(t).select(h.alias("host"), U.official(h, DOMAINS, DENIED).alias("official")).groupBy("host", "official").agg(F.count("*").alias("n"))


@query("url_forbidden", URLS.rstrip(", ") + " SELECT url, contains(lower(url), '/login') OR contains(lower(url), 'pills') OR contains(lower(url), '/admin') AS forbidden FROM u")
def url_forbidden(t):
    return urls(t).select("url", U.forbidden(F.col("url"), PATTERNS).alias("forbidden"))


@query("host_class", URLS + P + "SELECT CASE WHEN host = '' OR host = 'spam-farm.example.org' THEN 'forbidden' WHEN inside THEN 'official' ELSE 'candidate' END AS class, count(*) AS n FROM k GROUP BY 1")
def host_class(t):
    return urls(t).groupBy(U.host_class(U.host("url"), DOMAINS, DENIED).alias("class")).agg(F.count("*").alias("n"))


@query("ip_private", URLS + P + "SELECT url, private FROM k")
def ip_private(t):
    return urls(t).select("url", U.private_host(U.host("url")).alias("private"))


@query("url_gate", URLS + P + f"""SELECT url, reason = 'ok' AS allowed, reason, CASE WHEN reason IN ('empty_url', 'unsupported_scheme', 'userinfo_not_allowed', 'invalid_url', 'no_host') THEN '' ELSE canonical END AS canonical FROM (SELECT *, CASE WHEN x = '' THEN 'empty_url' WHEN sch NOT IN ('http', 'https') THEN 'unsupported_scheme' WHEN contains(auth, '@') THEN 'userinfo_not_allowed' WHEN host = '' THEN 'no_host'
  WHEN contains(lower(url), '/login') OR contains(lower(url), 'pills') OR contains(lower(url), '/admin') THEN 'forbidden_path' WHEN private THEN 'private_or_internal_host' WHEN host = 'spam-farm.example.org' THEN 'forbidden_domain' WHEN NOT inside THEN 'offsite_candidate_only'
  WHEN starts_with(host, 'blog.') THEN 'source_inactive' WHEN ext IN {SKIP} THEN 'unsupported_extension' WHEN length(regexp_replace(path, '[^/]', '', 'g')) > 2 THEN 'max_depth_exceeded' ELSE 'ok' END AS reason FROM k)""")
def url_gate(t):
    u = F.col("url")
    depth = F.char_length(F.regexp_replace(U.path(u), "[^/]", ""))
    g = U.gate(urls(t), "url", domains=DOMAINS, denied=DENIED, patterns=PATTERNS, inactive=U.host(u).startswith("blog."), depth=depth, max_depth=2)
    return g.select("url", "allowed", "reason", "canonical")


@query("url_source_join", URLS + P + "SELECT url, n_name AS source FROM k LEFT JOIN nation ON host = 'www.' || lower(n_name) || '.example.org' OR (n_nationkey = 3 AND host IN ('www.example.org', 'example.org'))")
def url_source_join(t):
    n = t("nation").select(F.col("n_name").alias("source"), F.explode(F.array_union(F.array(F.concat(F.lit("www."), F.lower("n_name"), F.lit(".example.org"))), F.when(F.col("n_nationkey") == 3, F.array(F.lit("www.example.org"), F.lit("example.org"))).otherwise(F.array().cast("array<string>")))).alias("host"))
    return urls(t).withColumn("host", U.host("url")).join(n, "host", "left").select("url", "source")


@query("url_attachment", URLS + P + f"SELECT url, CASE WHEN ext IN ('pdf', 'docx') THEN true WHEN ext IN {SKIP} THEN false ELSE regexp_matches(lower(url), 'download|attach|upload|file|fujian|getfile') END AS attachment FROM k")
def url_attachment(t):
    return urls(t).select("url", U.attachment_candidate("url", ["pdf", "docx"]).alias("attachment"))


@query("url_parent", URLS + P + """SELECT url, s2 || '://' || regexp_extract(canonical, '^[a-z]+://([^/?#]*)', 1) || CASE WHEN length(regexp_replace(p2, '[^/]', '', 'g')) <= 1 THEN '/' || CASE WHEN q2 <> '' THEN '?' || q2 ELSE '' END ELSE CASE WHEN regexp_replace(p2, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(p2, '/[^/]*$', '') END END AS parent FROM k WHERE sch IN ('http', 'https')""")
def url_parent(t):
    return urls(t).where(U.scheme(F.col("url")).isin("http", "https")).select("url", U.parent_page("url").alias("parent"))


@query("url_allowed", URLS + P + "SELECT url, sch IN ('http', 'https') AND NOT contains(auth, '@') AND port IN ('', '80', '443') AND (host = 'example.org' OR ends_with(host, '.example.org')) AND NOT (starts_with(host, 'mail.') OR starts_with(host, 'blog.')) AND NOT regexp_matches(lp, '/login|/admin/|captcha') AS allowed FROM k")
def url_allowed(t):
    return urls(t).select("url", U.crawl_allowed(F.col("url"), "example.org", ["mail.", "blog."], "/login|/admin/|captcha").alias("allowed"))


@query("url_official", URLS + P + "SELECT url, sch IN ('http', 'https') AND NOT contains(auth, '@') AND inside AND NOT ends_with(host, 'spam-farm.example.org') AND NOT (contains(lp, '/login') OR contains(lp, 'pills') OR contains(lp, '/admin')) AS official FROM k")
def url_official(t):
    return urls(t).select("url", U.official_url(F.col("url"), DOMAINS, DENIED, PATTERNS).alias("official"))


@query("url_allowlist", URLS + P + "SELECT url, CASE WHEN sch IN ('http', 'https') AND NOT contains(auth, '@') AND inside THEN x ELSE '' END AS shown FROM k")
def url_allowlist(t):
    return urls(t).select("url", U.allowed_or_empty(F.col("url"), DOMAINS).alias("shown"))


@query("url_public", URLS + P + "SELECT url, CASE WHEN sch IN ('http', 'https') AND NOT contains(auth, '@') AND host <> '' AND NOT private THEN x ELSE '' END AS shown FROM k")
def url_public(t):
    return urls(t).select("url", U.public_or_empty(F.col("url")).alias("shown"))


def _domains(t):
    """Per source: hosts of its own and shared parents, some twice."""
    s = F.col("source")
    return t("documents").groupBy(s).agg(F.count("*").alias("n")).select(s, F.array(F.concat(s, F.lit(".Example.org")), F.lit("a.b.example.net"), F.when(F.col("n") % 2 == 0, F.lit("example.org")).otherwise(F.lit("b.example.net")), F.lit("bad domain"), F.lit("x.example"), F.when(F.length(s) > 4, F.lit("x.example")).otherwise(F.lit("y.example"))).alias("domains"))


DOM = """WITH g AS (SELECT source, [source || '.Example.org', 'a.b.example.net', CASE WHEN count(*) % 2 = 0 THEN 'example.org' ELSE 'b.example.net' END, 'bad domain', 'x.example', CASE WHEN length(source) > 4 THEN 'x.example' ELSE 'y.example' END] AS domains FROM documents GROUP BY 1),
e AS (SELECT source, unnest(domains) AS raw, unnest(range(1, 7)) AS i FROM g), l AS (SELECT source, i, lower(trim(raw)) AS d FROM e WHERE NOT regexp_matches(raw, '[ /:()]')),
b AS (SELECT * FROM l a WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.source = a.source AND o.i <> a.i AND (o.d = a.d OR ends_with(a.d, '.' || o.d)))) """


@query("domains_broadest", DOM + "SELECT source, string_agg(d, ',' ORDER BY i) AS kept FROM b GROUP BY 1")
def domains_broadest(t):
    usable = F.filter(F.transform("domains", lambda d: F.lower(F.btrim(d))), lambda d: ~d.rlike(r"[ /:()]"))
    return _domains(t).withColumn("usable", usable).select("source", F.array_join(U.broadest(F.col("usable")), ",").alias("kept"))


@query("query_scoped", DOM + "SELECT source, 'Where is it? ' || string_agg('site:' || d, ' OR ' ORDER BY i) AS scoped FROM b GROUP BY 1")
def query_scoped(t):
    return _domains(t).select("source", U.scoped_query(F.lit("  Where is it? "), F.col("domains")).alias("scoped"))


@query("source_route", URLS + P + "SELECT url, CASE WHEN host IN ('www.example.org', 'example.org') THEN 'portal' WHEN starts_with(host, 'blog.') THEN 'community' WHEN inside THEN 'department' ELSE 'other' END AS route FROM k")
def source_route(t):
    h = U.host("url")
    return urls(t).select("url", F.when(h.isin("www.example.org", "example.org"), "portal").when(h.startswith("blog."), "community").when(U.in_domains(h, DOMAINS), "department").otherwise("other").alias("route"))


@query("transport_url", URLS + P + "SELECT url, CASE WHEN host IN ('example.org', 'www.example.org') THEN 'http:' || regexp_replace(url, '^[^:]*:', '') ELSE url END AS transport FROM k")
def transport_url(t):
    return urls(t).select("url", U.transport(F.col("url"), ["example.org", "www.example.org"]).alias("transport"))


@query("robots_allowed", r"""SELECT page_id, CASE WHEN length(host) % 2 = 1 THEN true WHEN regexp_matches(place, '^/.*\?page=') THEN false WHEN starts_with(place, '/en/1') THEN true WHEN starts_with(place, '/en/') THEN false ELSE true END AS allowed
FROM (SELECT page_id, regexp_extract(url, '//([^/?#:]*)', 1) AS host, CASE WHEN regexp_extract(url, '//[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '//[^/?#]*([^?#]*)', 1) END || regexp_extract(url, '\?[^#]+') AS place FROM pages)""")
def robots_allowed(t):
    """Pages that the robots files of their hosts let through; hosts of odd length have none."""
    hosts = t("pages").select(U.host("url").alias("host")).distinct()
    content = F.lit("User-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*?page=\n\nUser-agent: other\nDisallow: /\n")
    rules = HOPS.robots_rules(hosts.where("length(host) % 2 = 0").withColumn("content", content), "tessera")
    return HOPS.robots_allowed(t("pages").select("page_id", "url"), rules).select("page_id", "allowed")


@query("redirect_chains", """WITH RECURSIVE p AS (SELECT url, min(page_id) AS pid FROM pages GROUP BY url), m AS (SELECT max(pid) + 1 AS n FROM p),
hop AS (SELECT p.url, CASE WHEN p.pid % 4 = 0 THEN 200 ELSE 302 END AS status, CASE WHEN p.pid % 4 = 0 THEN NULL WHEN p.pid % 15 = 1 THEN '' ELSE coalesce(q.url, 'http://gone.example/') END AS location FROM (SELECT p.*, (pid * 7 + 3) % n AS nxt FROM p, m) p LEFT JOIN p q ON q.pid = p.nxt),
walk AS (SELECT url, url AS place, 0 AS hops, CAST(NULL AS VARCHAR) AS fault, false AS done FROM hop
UNION ALL SELECT w.url, CASE WHEN h.status = 302 AND h.location <> '' AND w.hops < 4 THEN h.location ELSE w.place END, CASE WHEN h.status = 302 AND h.location <> '' AND w.hops < 4 AND NOT contains(h.location, 'spam') THEN w.hops + 1 ELSE w.hops END,
CASE WHEN h.url IS NULL THEN 'not_landed' WHEN h.status <> 302 THEN NULL WHEN h.location = '' THEN 'redirect_without_location' WHEN w.hops >= 4 THEN 'too_many_redirects' WHEN contains(h.location, 'spam') THEN 'redirect_disallowed' END,
h.url IS NULL OR h.status <> 302 OR h.location = '' OR w.hops >= 4 OR contains(h.location, 'spam') FROM walk w LEFT JOIN hop h ON h.url = w.place WHERE NOT w.done)
SELECT w.url, w.place AS final_url, CASE WHEN coalesce(w.fault, '') <> 'redirect_disallowed' THEN h.status END AS status, w.hops, w.fault FROM walk w LEFT JOIN hop h ON h.url = w.place WHERE w.done""")
def redirect_chains(t):
    """Three of four pages are taken for redirects to another page."""
    p = t("pages").groupBy("url").agg(F.min("page_id").alias("pid"))
    total = p.agg((F.max("pid") + 1).alias("n"))  # one row
    nxt = p.crossJoin(total).withColumn("nxt", (F.col("pid") * 7 + 3) % F.col("n"))
    to = p.select(F.col("pid").alias("nxt"), F.col("url").alias("to"))
    location = F.when(F.col("pid") % 4 == 0, None).when(F.col("pid") % 15 == 1, "").otherwise(F.coalesce("to", F.lit("http://gone.example/")))
    hops = nxt.join(to, "nxt", "left").select("url", F.when(F.col("pid") % 4 == 0, 200).otherwise(302).alias("status"), location.alias("location"))
    return HOPS.redirect_chains(hops, lambda u: ~F.contains(u, F.lit("spam")))
