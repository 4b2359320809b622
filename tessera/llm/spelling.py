"""Spelling variant grouping by anagram hashing.

A word's anagram key is the sum of a power of each of its letters, so words of the same
letters share it whatever their order. One added or removed letter changes the key by that
letter's value, one replaced letter by the difference of two values. Each word therefore
stands under its own key and under the key less each of its letters: two words that differ
by an added letter meet where one's reduced key is the other's own, two that differ by a
replaced letter where their keys less the two letters agree. Letter order then decides.

Permutations of the same letters would all meet under one key. The letters of two words
that differ in one place also agree before or behind the middle, so that half goes into the
join: it keeps groups small, and no pair of near words is lost by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

MIN_LETTERS, MIN_COUNT, FACTOR, ONE_IN = 6, 5, 5, 199
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUNS = "[a-zÀ-ÿ]+"


def letter_value(letter: Column) -> Column:
    """The fifth power of a letter's number: a to z are 1 to 26, U+00C0 to U+00FF 27 to 90.
    The sum over any string that Spark can hold fits a long."""
    code = F.ascii(letter)
    x = F.when(code < 128, code - 96).otherwise(code - 0xC0 + 27).cast("long")
    return x * x * x * x * x


def anagram_key(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda total, c: total + F.when(c == "", F.lit(0)).otherwise(letter_value(c)))


def vocabulary(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """word, n: words of at least min_letters code points and how often they occur, if at
    least min_count times, over the whole texts. Of every one_in-th pair of doc_id and run
    (by crc32) one letter is left out, as a writer would."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(_RUNS), F.lit(0))).alias("_run"),
    ).where(F.length("_run") >= min_letters)
    h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    at = (h % F.length("_run")).cast("int")
    left_out = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    words = runs.select(F.when(h % one_in == 0, left_out).otherwise(F.col("_run")).alias("word"))
    return words.where(F.length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: all ordered pairs of distinct words of (word, n) that differ
    by exactly one inserted, deleted or replaced code point, each once."""
    size = F.length("word")
    less = F.concat(F.array(F.lit("")), F.array_distinct(F.filter(F.split("word", ""), lambda c: c != "")))
    under = words.withColumn("_key", anagram_key(F.col("word"))).select("word", "n", "_key", F.explode(less).alias("_less"))
    one = F.col("_less") != ""
    under = under.select(
        "word", "n", "_less",
        F.when(one, F.col("_key") - letter_value(F.col("_less"))).otherwise(F.col("_key")).alias("_key"),
        F.when(one, size - 1).otherwise(size).alias("_size"),
    )
    before = F.shiftright("_size", 1)
    behind = F.col("_size") - before
    halves = F.array(
        F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), before).alias("half")),
        F.struct(F.lit(1).alias("side"), F.substring("word", size - behind + 1, behind).alias("half")),
    )
    rows = under.withColumn("_half", F.explode(halves)).select("word", "n", "_less", "_key", "_size", F.col("_half.side").alias("_side"), F.col("_half.half").alias("_half"))
    a = rows.where(one).alias("a")
    # Spark takes exploded rows to be as many as before; a broadcast of them would fill the driver
    b = rows.hint("merge").alias("b")
    met = a.join(b, ["_key", "_size", "_side", "_half"]).where((F.col("b._less") == "") | (F.col("a._less") < F.col("b._less")))
    first = F.substring("a.word", F.lit(1), before) == F.substring("b.word", F.lit(1), before)
    found = met.where((F.col("_side") == 0) | ~first).where(F.levenshtein("a.word", "b.word", 1) == 1)
    both = F.array(
        F.struct(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n")),
        F.struct(F.col("b.word").alias("word"), F.col("b.n").alias("n"), F.col("a.word").alias("other"), F.col("a.n").alias("other_n")),
    )
    return found.select(F.explode(both).alias("_p")).select("_p.*")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following (word, form) ends. A form's count is at least FACTOR
    times its word's, so nothing goes in circles; each round doubles the steps taken."""
    now = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        now = settle(now.select("word", "root").join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")))
        if now.where("_moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, factor: int = FACTOR, one_in: int = ONE_IN) -> DataFrame:
    """One row per word: word, form (the near word that occurs most, ties to the smaller in
    code-point order, if it occurs at least factor times as often; else null), root (from
    word, forms followed to the last; word itself if it has none), n, n_near, form_n.

    Null and empty texts have no words; a null doc_id counts as an empty string; repeated
    rows count each; very long texts and runs are read whole; an empty table gives no rows;
    further columns are left out, whatever their names. factor must be above 1."""
    words = settle(vocabulary(docs, min_letters, min_count, one_in))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("_best"))
    enough = -F.col("_best.less") >= F.col("n") * factor
    known = settle(words.join(best.hint("merge"), "word", "left").select(
        "word",
        F.when(enough, F.col("_best.form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, -F.col("_best.less")).alias("form_n"),
    ))
    ends = roots(known.where(F.col("form").isNotNull()))
    return known.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same rows for DuckDB. Its crc32 is written out over the bytes of the string; letters
#: beyond ASCII take two bytes in UTF-8.
OP11_SQL = r"""
WITH RECURSIVE steps AS (
    SELECT i AS byte, 0 AS step, i::BIGINT AS c FROM range(256) t(i)
    UNION ALL
    SELECT byte, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE step < 8
),
crc_table AS (SELECT list(c ORDER BY byte) AS tab FROM steps WHERE step = 8),
runs AS (
    SELECT doc_id, run, count(*) AS times FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
        FROM documents)
    WHERE length(run) >= 6 GROUP BY doc_id, run
),
bytes AS (
    SELECT doc_id, run, times, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS b
    FROM runs
),
hashed AS (
    SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS h
    FROM bytes, crc_table
),
written AS (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed
),
words AS (
    SELECT word, sum(times)::BIGINT AS n FROM written WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
),
cut AS (
    SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, 1000000) t(i) WHERE i <= length(word)
),
spots AS (SELECT word, n, i, left(word, i - 1) || '*' || substr(word, i + 1) AS spot FROM words, range(1, 1000000) t(i) WHERE i <= length(word)),
pairs AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM spots a JOIN spots b ON a.spot = b.spot AND a.word <> b.word
    UNION ALL SELECT c.word, c.n, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
    UNION ALL SELECT w.word, w.n, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
known AS (
    SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 5 * w.n THEN r.other END AS form, CASE WHEN r.other_n >= 5 * w.n THEN r.other_n END AS form_n
    FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1
),
walk AS (
    SELECT word, word AS place, 0 AS hops FROM known
    UNION ALL SELECT walk.word, known.form, hops + 1 FROM walk JOIN known ON known.word = walk.place WHERE known.form IS NOT NULL
)
SELECT k.word, k.form, (SELECT arg_max(place, hops) FROM walk WHERE walk.word = k.word) AS root, k.n::BIGINT AS n, k.n_near::BIGINT AS n_near, k.form_n::BIGINT AS form_n FROM known k
"""
