"""What a crawl may fetch and where its redirects end, over landed robots files and hops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

REDIRECTS = (301, 302, 303, 307, 308)


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """host and rules (pattern, allow, size) of robots files (host, content) for an agent: the
    rules of all groups that name it (a name that the agent begins with, whatever its case);
    without such a group those for `*`. A group is a run of User-agent lines and what follows
    them; an empty Disallow forbids nothing. The file of a host is folded in its row."""
    line = lambda x: F.btrim(F.regexp_replace(x, "#.*$", ""))
    field = lambda x: F.struct(F.lower(F.btrim(F.regexp_extract(x, r"^([^:]*):", 1))).alias("name"), F.btrim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value"))
    fields = F.transform(F.filter(F.transform(F.split(F.coalesce("content", F.lit("")), "\r\n|\r|\n"), line), lambda x: F.contains(x, F.lit(":"))), field)
    fields = F.filter(fields, lambda f: f["name"].isin("user-agent", "allow", "disallow"))
    rule = "array<struct<pattern:string,allow:boolean,size:int>>"
    none = F.array().cast(rule)
    start = F.struct(F.lit(False).alias("own"), F.lit(False).alias("any"), F.lit(False).alias("body"), F.lit(False).alias("named"), none.alias("mine"), none.alias("rest"))

    def add(s: Column, f: Column) -> Column:
        head = f["name"] == "user-agent"
        fresh = head & s["body"]  # a User-agent line after rules begins a new group
        name = F.lower(f["value"])
        own = F.when(fresh, False).otherwise(s["own"]) | (head & (name != "*") & (name != "") & F.startswith(F.lit(agent.lower()), name))
        every = F.when(fresh, False).otherwise(s["any"]) | (head & (name == "*"))
        new = F.array(F.struct(f["value"].alias("pattern"), (f["name"] == "allow").alias("allow"), F.char_length(f["value"]).alias("size")))
        counts = ~head & (f["value"] != "")
        return F.struct(
            own.alias("own"), every.alias("any"), (~head).alias("body"), (s["named"] | own).alias("named"),
            F.when(counts & own, F.concat(s["mine"], new)).otherwise(s["mine"]).alias("mine"), F.when(counts & every, F.concat(s["rest"], new)).otherwise(s["rest"]).alias("rest"),
        )

    return robots.select("host", F.aggregate(fields, start, add, lambda s: F.when(s["named"], s["mine"]).otherwise(s["rest"])).alias("rules"))


def _regex(pattern: Column) -> Column:
    """A robots pattern as a regular expression: * is any run, $ at the end the end."""
    end = pattern.endswith("$")
    body = F.when(end, F.substr(pattern, F.lit(1), F.char_length(pattern) - 1)).otherwise(pattern)
    quoted = F.regexp_replace(body, r"([\\\^\$\.\|\?\+\(\)\[\]\{\}])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*+", ".*"), F.when(end, "$").otherwise(""))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (with a column url) with allowed: the longest rule of its host that fits path and
    query decides, of equally long ones the one that allows; without a fitting rule, or a
    robots file, a url is allowed. rules: as robots_rules() gives them."""
    at = F.concat(F.when(U.path(F.col("url")) == "", "/").otherwise(U.path(F.col("url"))), F.when(U.query(F.col("url")) != "", F.concat(F.lit("?"), U.query(F.col("url")))).otherwise(""))
    found = urls.withColumn("_host", U.host("url")).withColumn("_at", at).join(rules.withColumnRenamed("host", "_host"), "_host", "left")
    fits = F.filter("rules", lambda r: F.regexp(F.col("_at"), _regex(r["pattern"])))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"], r["allow"])))
    return found.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_host", "_at", "rules")


def redirect_chains(hops: DataFrame, allowed: Callable[[Column], Column], most: int = 4) -> DataFrame:
    """Where each landed url ends: url, final_url, status, hops, fault. hops: url, status,
    location, one row each. A redirect leads to its location, resolved against its url. The
    first violation ends a chain: redirect_without_location, too_many_redirects (one more
    than `most`), redirect_disallowed (final_url is then the target that isn't allowed), or
    not_landed. Chains are followed by pointer jumping: the table of what 2^k hops do is joined
    with itself, so `most` hops take log2(most) joins."""
    h = F.col
    jumps = h("status").isin(*REDIRECTS)
    bare = F.coalesce(F.btrim("location"), F.lit("")) == ""
    target = U.resolved("url", "location")
    # one hop: at (where one is then), n (hops taken), fault
    one = hops.select(
        "url",
        F.when(jumps & ~bare, target).otherwise(h("url")).alias("at"),
        F.when(jumps & ~bare & allowed(target), 1).otherwise(0).alias("n"),
        F.when(jumps & bare, "redirect_without_location").when(jumps & ~F.coalesce(allowed(target), F.lit(False)), "redirect_disallowed").alias("fault"),
    )

    def after(first: DataFrame, then: DataFrame, full: int) -> DataFrame:
        """What `then` does where `first` took all its `full` hops."""
        t = then.select(h("url").alias("at"), h("at").alias("_at"), h("n").alias("_n"), h("fault").alias("_fault"), F.lit(True).alias("_there"))
        goes = (h("n") == full) & h("fault").isNull()
        return first.join(t, "at", "left").select(
            "url", F.when(goes & h("_there"), h("_at")).otherwise(h("at")).alias("at"), (h("n") + F.when(goes, F.coalesce("_n", F.lit(0))).otherwise(0)).alias("n"),
            F.when(goes, F.when(h("_there").isNull(), "not_landed").otherwise(h("_fault"))).otherwise(h("fault")).alias("fault"),
        )

    done, taken, power, size = None, 0, one, 1
    while size <= most:
        if most & size:
            done = power if done is None else after(done, power, taken)
            taken += size
        if 2 * size <= most:
            power = after(power, power, size)
        size *= 2
    ends = hops.select(h("url").alias("at"), h("status").alias("_status"), jumps.alias("_jumps"), bare.alias("_bare"))
    start = done if done is not None else hops.select("url", h("url").alias("at"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("fault"))
    over = h("fault").isNull() & (h("n") == most) & F.coalesce("_jumps", F.lit(False))
    fault = F.when(over, F.when(h("_bare"), "redirect_without_location").otherwise("too_many_redirects")).when(h("fault").isNull() & h("_jumps").isNull(), "not_landed").otherwise(h("fault"))
    return start.join(ends, "at", "left").select("url", h("at").alias("final_url"), F.when(fault.isNull() | (fault != "redirect_disallowed"), h("_status")).alias("status"), h("n").alias("hops"), fault.alias("fault"))
