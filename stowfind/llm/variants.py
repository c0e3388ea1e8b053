"""Spelling variants of words by asymmetric q-chunks.

Words are counted over whole texts. Two words are near if one code point is inserted, deleted or replaced. Of a pair,
the shorter word (of equal ones the smaller) gives two disjoint chunks, its first and its last half; the longer gives
its positional grams of that size. One edit leaves a chunk whole, shifted by at most the difference of the lengths,
zero or one, so chunks and grams meet on letters, place and lengths. Only the grams at a word's start and end can lie
within that shift of a chunk, so no others are written.

Half of a short word is shared by thousands. The letters outside the whole chunk are therefore halved once more: the
edit leaves one of these quarters whole as well, and it is part of the key. Candidates grow with the words that share
three quarters of their letters; a key that is still frequent is split by Spark's skew join. Every candidate is
verified by its edit distance. Near words are grouped for the most frequent one, and forms are followed to their roots
by doubling, whose rounds are bounded by the counts: each step of a chain multiplies the count by ``ratio``.

All of it is DataFrame expressions. ``noisy`` words carry a letter lost by rule (see ``counted_words``).

Cases: a null text has no words; a null id loses no letters; repeated rows count again; ties of the counts go to the
smaller word in code-point order; an empty table, and texts without letters, give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowfind.llm.common import scratch

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOSES = 199  # of so many runs one loses a letter


def counted_words(docs: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, counted over all texts.

    With h the CRC-32 of ``<doc_id>:<run>``, a run with h divisible by ``LOSES`` loses its code point h modulo length.
    Runs below ``min_length`` are dropped before the shuffle, as they only get shorter.
    """
    runs = docs.select(
        F.col("doc_id").cast("long").cast("string").alias("doc"),
        F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_length)
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    lost = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), lost), F.expr("substring(run, 2 + cast(h % length(run) as int))"))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % LOSES == 0, shorter).otherwise(F.col("run")).alias("word"))
    return (words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_count))


def keys(word: Column, length: Column, partner: Column) -> Column:
    """Keys of a word in a pair whose shorter word has ``length`` letters and whose longer has ``partner``."""
    half = (length / 2).cast("int")
    inner = ((length - half) / 2).cast("int")
    outer = length - half - inner

    def key(kind: str, *parts: Column) -> Column:
        return F.concat_ws(":", F.lit(kind), length.cast("string"), partner.cast("string"), *parts)

    return F.array(
        key("first", F.left(word, half + inner)),
        key("first and end", F.left(word, half), F.right(word, outer)),
        key("last and start", F.left(word, inner), F.right(word, half)),
        key("last", F.right(word, half + outer)))


def near_pairs(words: DataFrame, min_length: int = 6) -> DataFrame:
    """(a, n_a, b, n_b): each pair of near words once."""
    size = F.length("word")
    both = F.array(F.lit(0), F.lit(1))
    chunks = (words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(both).alias("more"))
              .withColumn("key", F.explode(keys(F.col("a"), F.length("a"), F.length("a") + F.col("more")))))
    grams = (words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), size.alias("size"),
                          F.explode(both).alias("less")).where(F.col("size") - F.col("less") >= min_length)
             .select("b", "n_b", F.explode(keys(F.col("b"), F.col("size") - F.col("less"), F.col("size"))).alias("key")))
    met = chunks.join(grams, "key").where((F.col("more") == 1) | (F.col("a") < F.col("b")))
    return (met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")
            .dropDuplicates(["a", "b"]))


def followed(forms: DataFrame, rounds: int) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, each round doubling the steps."""
    roots = scratch(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        above = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = scratch(roots.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root")),
                        "roots")
    return roots


def spelling_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of at least ``min_length`` and ``min_count``."""
    words = scratch(counted_words(docs, min_length, min_count), "words")
    pairs = scratch(near_pairs(words, min_length), "near-words")
    sides = (pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
             .unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b"))
    best = best.select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n"))
    strong = F.col("near_n") >= ratio * F.col("n")
    placed = scratch(
        words.join(best, "word", "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                F.when(strong, F.col("near")).alias("form"), F.when(strong, F.col("near_n")).alias("form_n")), "forms")
    most = placed.agg(F.max("n")).first()[0] or 1
    steps = max(1, int(math.log(most, ratio)))
    roots = followed(placed.where(F.col("form").isNotNull()), math.ceil(math.log2(steps)) if steps > 1 else 0)
    return (placed.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def _crc_table() -> list[int]:
    """The table of CRC-32 by bytes, from its polynomial."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return table


# The same result stated over deletions: words that share a deletion at one place, or of which one is the other's.
SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{LETTERS}')) AS run FROM documents
), per_doc AS (
  SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT doc_id, run, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
      string_split(doc_id::VARCHAR || ':' || run, ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))),
      lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1]))) AS h
  FROM per_doc
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN doc_id IS NOT NULL AND h % 199 = 0
      THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2)
      ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), shorter AS (
  SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place FROM near
), formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.m >= 5 * w.n THEN r.other END AS form,
    CASE WHEN r.m >= 5 * w.n THEN r.m END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
), chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
), ends AS (
  SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word
"""
