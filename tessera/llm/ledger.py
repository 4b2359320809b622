"""Secret scans with an incremental ledger of blobs, in DataFrame functions only.

Every version of a text is addressed by its content (SHA-256). The ledger is a folder of
Parquet files with one row for each scan of a blob: the rules, each with its version, that
were run on it, and what they found. A scan looks up which pairs of a blob and a rule
version the ledger lacks, reads one text of each such blob, runs only the missing rules on
it, appends the rows, and joins the findings of the current rules back to all versions. A row
of the ledger is whole in itself, so a scan that dies half way leaves rows that count, and
the next scan does what is missing; rows that two scans write alike are merged when read."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept_in_scope, shared_dir


@dataclass(frozen=True)
class Rule:
    """A pattern (leftmost matches that don't overlap; it never matches nothing); a match
    counts if its part `group` has at least `least` code points. A changed rule gets a new
    version."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed patterns. Where only the length of a maximal run counts, it stands in the pattern.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("login", 1, r"://[^\x20\x09-\x0D/:@]{1,250}:[^\x20\x09-\x0D/@]{1,250}@"),
)
LEDGER = "blob string, rules array<string>, findings array<struct<kind: string, version: int, start: bigint, end: bigint>>"
#: Most unseen blobs whose addresses (about 100 bytes each) are sent to all executors.
FEW = 100_000
#: Shares into which the versions of each blob are dealt when findings are joined to them.
SHARES = 16


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, blob, text: every row with the address of its text; null counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))


def read(spark: SparkSession, ledger: str) -> DataFrame:
    """The rows of a ledger; none if the folder does not exist yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(LEDGER).parquet(ledger)
    return spark.createDataFrame([], LEDGER)


def unseen(held: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, rules: for each blob of held the keys of the rules that the ledger lacks, if
    there are any."""
    done = ledger.select("blob", F.explode("rules").alias("_r")).groupBy("blob").agg(F.collect_set("_r").alias("_done"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    missing = F.array_except(wanted, F.coalesce("_done", F.array().cast("array<string>")))
    return held.select("blob").distinct().join(done, "blob", "left").select("blob", missing.alias("rules")).where(F.size("rules") > 0)


def _lengths(rule: Rule) -> Column:
    """Of the text's matches: the lengths of what stands before each (from the match before
    it), of the match and of the part that counts. The pieces between the matches come from
    a split at the same pattern, so places are sums of lengths. Null if there is none."""
    found = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    gaps = F.split("text", rule.pattern, -1)
    size = lambda x: F.transform(x, lambda s: F.length(s).cast("long"))
    rows = F.arrays_zip(size(F.slice(gaps, F.lit(1), F.size(found))).alias("gap"), size(found).alias("size"), size(part).alias("part"))
    asked = F.array_contains("rules", rule.key) & F.col("text").rlike(rule.pattern)
    return F.when(asked, F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"), rows.alias("rows")))


def findings(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, findings of texts (blob, text, rules): what the rules whose keys stand in
    `rules` find in a text, as kind, version, start, end in code points. Blobs without
    findings have no row."""
    by_rule = texts.select("blob", F.explode(F.filter(F.array(*[_lengths(r) for r in rules]), lambda x: x.isNotNull())).alias("_r"))
    rows = by_rule.select("blob", "_r.kind", "_r.version", "_r.least", F.posexplode("_r.rows").alias("_i", "_m"))
    upto = Window.partitionBy("blob", "kind", "version").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("_m.gap") + F.col("_m.size")).over(upto)).where(F.col("_m.part") >= F.col("least"))
    span = F.struct("kind", "version", (F.col("end") - F.col("_m.size")).alias("start"), "end")
    return placed.groupBy("blob").agg(F.collect_list(span).alias("findings"))


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Brings the ledger up to date: scans what it lacks of the texts of docs (doc_id,
    text) and appends the rows."""
    spark = docs.sparkSession
    held = versions(docs).select("blob", "text")
    todo = unseen(held, read(spark, ledger), rules).persist()
    try:
        if todo.count() <= FEW:  # the texts that were seen before aren't shuffled
            texts = held.join(F.broadcast(todo), "blob").dropDuplicates(["blob"])
        else:  # copies go before the shuffle
            texts = held.dropDuplicates(["blob"]).join(todo, "blob")
        rows = todo.join(findings(texts, rules), "blob", "left")
        none = F.array().cast("array<struct<kind: string, version: int, start: bigint, end: bigint>>")
        rows.select("blob", "rules", F.coalesce("findings", none).alias("findings")).write.mode("append").parquet(ledger)
    finally:
        todo.unpersist()


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, blob (SHA-256 of the text, hex) and findings, an
    array of kind, version, start, end (code points, end exclusive) by start, then in the
    order of rules. ledger: a folder that all executors reach, kept between calls; None
    makes a new one in the shared folder, so that everything is scanned.

    Null and empty texts are one blob without findings; a null doc_id is kept; rows that
    repeat get their findings each; a text that many rows hold is scanned once; very long
    texts are scanned whole; an empty table gives no rows; further columns, whatever their
    names, are left out. Findings of rules that are not asked for, or of other versions of
    them, stay in the ledger and are not returned."""
    spark = docs.sparkSession
    ledger = ledger or kept_in_scope(f"{shared_dir(spark)}/ledgers/{uuid.uuid4().hex}")
    scan(docs, ledger, rules)
    keys, kinds = F.array(*[F.lit(r.key) for r in rules]), F.array(*[F.lit(r.kind) for r in rules])
    found = read(spark, ledger).select("blob", F.explode("findings").alias("f")).where(F.array_contains(keys, F.concat("f.kind", F.lit("@"), "f.version")))
    ordered = F.array_sort(F.collect_set(F.struct("f.start", F.array_position(kinds, F.col("f.kind")).alias("place"), "f.end", "f.kind", "f.version")))
    spans = F.transform(ordered, lambda x: F.struct(x.kind.alias("kind"), x.version.alias("version"), x.start.alias("start"), x.end.alias("end")))
    by_blob = found.groupBy("blob").agg(spans.alias("findings")).withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    rows = versions(docs).select("doc_id", "blob", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).cast("int").alias("_share"))
    none = F.array().cast("array<struct<kind: string, version: int, start: bigint, end: bigint>>")
    return rows.join(by_blob, ["blob", "_share"], "left").select("doc_id", "blob", F.coalesce("findings", none).alias("findings"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def _either(words: str) -> str:
    """A pattern in which ASCII letters stand for both cases, and for no other sign."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


def _sql_rule(rule: Rule, place: int) -> str:
    pattern = rule.pattern
    if pattern.startswith("(?i)"):
        words, rest = pattern[4:].split(")", 1)
        pattern = _either(words) + ")" + rest
    pattern = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, r, '{rule.kind}' AS kind, {place} AS place, {rule.least} AS least,
        list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x)) AS gaps,
        list_transform(regexp_extract_all(t, '{pattern}'), lambda x: length(x)) AS sizes,
        list_transform(regexp_extract_all(t, '{pattern}', {rule.group}), lambda x: length(x)) AS counted
    FROM rows_ WHERE regexp_matches(t, '{pattern}')"""


OP12_SQL = f"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
lengths AS ({" UNION ALL ".join(_sql_rule(x, i) for i, x in enumerate(RULES))}),
each AS (SELECT r, kind, place, least, gaps, sizes, counted, unnest(range(1, len(sizes) + 1)) AS i FROM lengths),
spans AS (
    SELECT r, kind, place, (list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0))::BIGINT AS s, sizes[i] AS size
    FROM each WHERE counted[i] >= least
),
joined AS (
    SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || s || ':' || (s + size), ',' ORDER BY s, place) FILTER (place < {len(BASE)}) AS base,
        string_agg(kind || ':' || s || ':' || (s + size), ',' ORDER BY s, place) AS spans
    FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM rows_ LEFT JOIN joined USING (r)
"""
