"""URL expressions: parts, canonical forms, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import any_of, col, let

#: Parameters that only track visits.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "from", "share_token", "weixin", "wx", "sid", "sessionid", "phpsessid", "jsessionid", "aspxsessionid"]
#: File types without text.
SKIPPED = ["jpg", "jpeg", "png", "gif", "bmp", "svg", "webp", "ico", "mp3", "mp4", "avi", "mov", "wmv", "flv", "css", "js", "json", "woff", "woff2", "ttf", "eot", "swf", "exe", "dmg", "apk", "iso"]
#: Parts of an address that tell of a file.
ATTACHMENT_HINTS = ["download", "attach", "upload", "file", "fujian", "getfile"]

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, _SCHEME, 1))


def authority(u: Column) -> Column:
    return F.regexp_extract(u, _AUTHORITY, 1)


def userinfo(u: Column) -> Column:
    return F.regexp_extract(authority(u), r"^(.*)@", 1)


def host(u: Column | str) -> Column:
    """Lower-cased host without final dots; '' if there is none."""
    h = F.regexp_extract(F.regexp_replace(authority(col(u)), r"^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1)
    return F.regexp_replace(F.lower(h), r"\.+$", "")


def port(u: Column) -> Column:
    return F.regexp_extract(authority(u), r":([0-9]*)$", 1)


def path(u: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), _SCHEME, ""), r"^(?://[^/]*)?(.*)$", 1)


def query(u: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(u, r"#.*$", ""), r"\?(.*)$", 1)


def _kept(q: Column, keep) -> Column:
    pairs = F.filter(F.split(q, "&"), lambda p: p != "")
    name = lambda p: F.lower(F.regexp_extract(p, "^([^=]*)", 1))
    return F.array_join(F.array_sort(F.filter(pairs, lambda p: keep(name(p), F.regexp_extract(p, "=(.*)$", 1)))), "&")


def canonical(u: Column | str, keep_query: bool = True) -> Column:
    """Lower-cased scheme and host, no default port, single slashes in the path, sorted
    parameters without tracking and empty ones, no fragment. URLs of other schemes stay
    as they are. Percent escapes are kept as written."""
    u = F.btrim(col(u))
    s = F.when(scheme(u) == "", F.lit("https")).otherwise(scheme(u))
    p = port(u)
    default = ((s == "http") & (p == "80")) | ((s == "https") & (p == "443")) | (p == "")
    net = F.when(default, host(u)).otherwise(F.concat(host(u), F.lit(":"), p))
    tail = F.regexp_replace(F.when(path(u) == "", F.lit("/")).otherwise(path(u)), "/{2,}", "/")
    kept = _kept(query(u), lambda n, v: ~n.isin(TRACKING) & (v != "")) if keep_query else F.lit("")
    full = F.concat(s, F.lit("://"), net, tail, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(F.coalesce(u, F.lit("")) == "", F.lit("")).when(~s.isin("http", "https"), u).otherwise(full)


def canonical_crawl(u: Column | str) -> Column:
    """The crawler's form: keeps ports and blank values, drops utm_*, from and spm."""
    u = col(u)
    kept = _kept(query(u), lambda n, v: ~n.startswith("utm_") & ~n.isin("from", "spm"))
    tail = F.when(path(u) == "", F.lit("/")).otherwise(path(u))
    return F.concat(scheme(u), F.lit("://"), F.lower(authority(u)), tail, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def match_key(u: Column | str) -> Column:
    """Without scheme and fragment, with single slashes and none at the end."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.btrim(col(u))), r"#.*$", ""), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(x, "/{2,}", "/"), "/$", "")


def extension(u: Column | str) -> Column:
    p = F.lower(path(col(u)))
    return F.when(F.instr(p, ".") > 0, F.element_at(F.split(p, r"\."), -1)).otherwise("")


def skippable(u: Column | str) -> Column:
    return extension(u).isin(SKIPPED)


def attachment_candidate(u: Column | str, allowed: list[str]) -> Column:
    e, low = extension(u), F.lower(col(u))
    return F.when(e.isin(allowed), True).when(e.isin(SKIPPED), False).otherwise(any_of([low.contains(h) for h in ATTACHMENT_HINTS]))


def in_domains(h: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    return any_of([(h == d.lower()) | h.endswith("." + d.lower()) for d in domains])


def official(h: Column, domains: list[str], denied: list[str] = ()) -> Column:
    return in_domains(h, list(domains)) & ~in_domains(h, list(denied))


def forbidden(u: Column, patterns: list[str]) -> Column:
    low = F.lower(u)
    return any_of([low.contains(p.lower()) for p in patterns])


def host_class(h: Column, domains: list[str], denied: list[str]) -> Column:
    return F.when((h == "") | h.isin([d.lower() for d in denied]), "forbidden").when(official(h, domains), "official").otherwise("candidate")


def private_host(h: Column) -> Column:
    """Local names and IPv4 literals of private, loopback, link-local, multicast,
    reserved or unspecified ranges; no names are resolved."""
    quad = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"
    o = [F.coalesce(F.regexp_extract(h, quad, i).try_cast("int"), F.lit(-1)) for i in range(1, 5)]
    ip = h.rlike(quad) & (o[0] <= 255) & (o[1] <= 255) & (o[2] <= 255) & (o[3] <= 255)
    inside = o[0].isin(0, 10, 127) | (o[0] >= 224) | ((o[0] == 172) & o[1].between(16, 31)) | ((o[0] == 192) & (o[1] == 168)) | ((o[0] == 169) & (o[1] == 254)) | ((o[0] == 198) & o[1].isin(18, 19)) | ((o[0] == 192) & (o[1] == 0) & o[2].isin(0, 2)) | ((o[0] == 198) & (o[1] == 51) & (o[2] == 100)) | ((o[0] == 203) & (o[1] == 0) & (o[2] == 113))
    return (h == "") | (h == "localhost") | h.endswith(".local") | (ip & inside)


def gate(df: DataFrame, url: str, *, domains: list[str], denied: list[str], patterns: list[str], inactive: Column, depth: Column, max_depth: int, attachment: bool = False) -> DataFrame:
    """Adds allowed, reason and canonical: the first failing test names the reason.
    Host and canonical form are columns of their own, so each is computed once."""
    u = F.col(url)
    df = df.withColumn("canonical", canonical(u)).withColumn("_depth", depth).withColumn("_inactive", inactive)
    df = df.withColumn("_host", host("canonical")).withColumn("_port", port(u))
    low, h, p = F.lower(u), F.col("_host"), F.col("_port")
    df = df.withColumn("_class", host_class(h, domains, denied))
    bad_port = (p != "") & (F.coalesce(p.try_cast("long"), F.lit(99999)) > 65535)
    reason = (
        F.when(F.coalesce(u, F.lit("")) == "", "empty_url")
        .when(~low.startswith("http://") & ~low.startswith("https://"), "unsupported_scheme")
        .when(F.instr(authority(u), "@") > 0, "userinfo_not_allowed")
        .when(bad_port, "invalid_url")
        .when(h == "", "no_host")
        .when(forbidden(u, patterns), "forbidden_path")
        .when(private_host(h), "private_or_internal_host")
        .when(F.col("_class") == "forbidden", "forbidden_domain")
        .when(F.col("_class") != "official", "offsite_candidate_only")
        .when(F.col("_inactive"), "source_inactive")
    )
    if not attachment:
        reason = reason.when(skippable("canonical"), "unsupported_extension")
    df = df.withColumn("reason", reason.when(F.col("_depth") > max_depth, "max_depth_exceeded").otherwise("ok"))
    early = F.col("reason").isin("empty_url", "unsupported_scheme", "userinfo_not_allowed", "invalid_url", "no_host")
    return df.withColumn("canonical", F.when(early, "").otherwise(F.col("canonical"))).withColumn("allowed", F.col("reason") == "ok").drop("_depth", "_inactive", "_host", "_port", "_class")


def parent_page(u: Column | str) -> Column:
    """The URL without the last part of its path."""
    c = canonical(u)
    net, p, q = authority(c), path(c), query(c)
    flat = F.char_length(p) - F.char_length(F.replace(p, F.lit("/"), F.lit(""))) <= 1
    up = F.regexp_replace(p, "/[^/]*$", "")
    full = F.when(flat, F.concat(F.lit("/"), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))).otherwise(F.when(up == "", "/").otherwise(up))
    return F.concat(scheme(c), F.lit("://"), net, full)


def resolved(base: Column | str, href: Column | str) -> Column:
    """A link as an absolute URL: `.` and `..` of its path are followed, its query and
    fragment kept, those of the base left. '' for an empty link and for those that lead to no
    page (scripts, mail, phone, inline data, places in the same page)."""
    trimmed = F.regexp_replace(col(href), r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return let(F.struct(col(base).alias("base"), trimmed.alias("href")), lambda x: _resolved(x["base"], x["href"]))


def _resolved(base: Column, h: Column) -> Column:
    root = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    above = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    up = lambda seen, x: F.when(x == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).when(x == ".", seen).otherwise(F.concat(seen, F.array(x)))

    def walked(parts: Column) -> Column:
        kept = F.aggregate(parts, F.array().cast("array<string>"), up)
        return F.array_join(F.concat(kept, F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/")

    def joined(p: Column) -> Column:
        whole = F.when(p == "", above).when(p.startswith("/"), p).otherwise(F.concat(F.regexp_replace(above, "[^/]*$", ""), p))
        way = let(whole, lambda w: F.when(w == "", "").otherwise(F.concat(F.lit("/"), let(F.split(F.regexp_replace(w, "^/", ""), "/"), walked))))
        return F.concat(root, way, F.substr(h, F.char_length(p) + 1))

    return (
        F.when(F.coalesce(h, F.lit("")) == "", "").when(h.rlike("^(?:javascript:|mailto:|tel:|data:|#)"), "")
        .when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*:", 0), h))
        .when(root == "", h).otherwise(let(F.regexp_extract(h, r"^[^?#]*", 0), joined))
    )


def crawl_allowed(u: Column, domain: str, prefixes: list[str], block: str) -> Column:
    h, p = host(u), port(u)
    return scheme(u).isin("http", "https") & (userinfo(u) == "") & p.isin("", "80", "443") & in_domains(h, [domain]) & ~any_of([h.startswith(x) for x in prefixes]) & ~path(u).rlike(f"(?i){block}")


def official_url(u: Column, domains: list[str], denied: list[str], patterns: list[str]) -> Column:
    h, p = host(u), F.lower(path(u))
    return F.coalesce(scheme(u).isin("http", "https") & (userinfo(u) == "") & in_domains(h, domains) & ~in_domains(h, denied) & ~any_of([p.contains(x.lower()) for x in patterns]), F.lit(False))


def allowed_or_empty(u: Column, domains: list[str], limit: int = 2048) -> Column:
    x = F.btrim(u)
    ok = (F.octet_length(x) <= limit) & scheme(x).isin("http", "https") & (F.instr(authority(x), "@") == 0) & in_domains(host(x), domains)
    return F.when(F.coalesce(ok, F.lit(False)), x).otherwise("")


def public_or_empty(u: Column) -> Column:
    """The URL if it is http(s), has a host, no user and isn't local or private."""
    x, h = F.btrim(u), host(F.btrim(u))
    o = [F.coalesce(F.regexp_extract(h, r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$", i).try_cast("int"), F.lit(-1)) for i in range(1, 5)]
    local = (h == "localhost") | h.endswith(".local") | (o[0] == 10) | (o[0] == 127) | ((o[0] == 172) & o[1].between(16, 31)) | ((o[0] == 192) & (o[1] == 168)) | ((o[0] == 169) & (o[1] == 254)) | (h == "0.0.0.0")
    ok = scheme(x).isin("http", "https") & (h != "") & (F.instr(authority(x), "@") == 0) & ~local
    return F.when(F.coalesce(ok, F.lit(False)), x).otherwise("")


def transport(u: Column, plain_hosts: list[str]) -> Column:
    """http instead of https for hosts without working TLS."""
    return F.when(host(u).isin(plain_hosts), F.concat(F.lit("http:"), F.regexp_replace(u, "^[^:]*:", ""))).otherwise(u)


def broadest(domains: Column) -> Column:
    """Domains of an array that no other entry equals or contains; an entry that occurs
    twice counts as covered by its copy, so both go."""
    covers = lambda d, i: F.exists(F.transform(domains, lambda o, j: (i != j) & ((d == o) | d.endswith(F.concat(F.lit("."), o)))), lambda x: x)
    marked = F.transform(domains, lambda d, i: F.when(~covers(d, i), d))
    return F.array_compact(marked)


def scoped_query(question: Column, domains: Column) -> Column:
    """The question followed by site: clauses for the broadest usable domains."""
    usable = F.filter(F.transform(domains, lambda d: F.lower(F.btrim(d))), lambda d: (d != "") & ~d.rlike(r"[ /:()]"))
    kept = broadest(usable)
    clauses = F.array_join(F.transform(kept, lambda d: F.concat(F.lit("site:"), d)), " OR ")
    return F.when(F.size(kept) == 0, F.btrim(question)).otherwise(F.concat(F.btrim(question), F.lit(" "), clauses))
