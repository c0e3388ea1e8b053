"""Field-weighted BM25 over AND-of-OR queries with a trailing prefix term."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowfind.functions.text import ALIASES, expand, query_terms, tokenize
from stowfind.operators.joins import MAX_BYTES, MAX_ROWS, lookup_join
from stowfind.operators.ordered import top_n
from stowfind.session import scratch, spread

# BM25 parameters and the floor for terms in most rows.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6
DIGITS = 12
# All characters a token can start with.
LEADS = "0123456789abcdefghijklmnopqrstuvwxyz"


@dataclass
class Terms:
    """Query terms and what one look at the queries tells about their size.

    rows     query_id, n_groups, group_no, phrase_no, term, is_prefix, phrase
    queries  number of queries
    small    the terms certainly fit a broadcast
    shortest length of the shortest prefix term
    leads    first characters of all terms
    """

    rows: DataFrame
    queries: int
    small: bool
    shortest: int
    leads: list[str]

    def prune(self, table: DataFrame) -> DataFrame:
        """Rows with a first character that occurs; a partition filter on saved tables."""
        return table.filter(F.col("lead").isin(self.leads))

    @classmethod
    def of(cls, queries: DataFrame, texts: DataFrame | None = None,
           aliases: dict[str, list[str]] = ALIASES) -> Terms:
        """Terms of ``texts``, or of the queries; sizes are bounded from the queries in one job.

        A token yields at most one term for itself and one per synonym.
        """
        tokens = queries.select(tokenize(F.col("query")).alias("t"), F.octet_length("query").alias("b"))

        def add(mask: Column, token: Column) -> Column:
            place = F.call_function("instr", F.lit(LEADS), F.substring(token, 1, 1))
            return mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place - 1))

        mask = F.aggregate(expand(F.col("t"), aliases), F.lit(0).cast("long"), add)
        seen = tokens.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.size("t")).alias("tokens"), F.sum("b").alias("bytes"),
            F.bit_or(mask).alias("mask"), F.min(F.length(F.try_element_at("t", F.lit(-1)))).alias("shortest")).first()
        most = 1 + max((len(a) for a in aliases.values()), default=0)
        small = (seen["tokens"] or 0) * most <= MAX_ROWS and (seen["bytes"] or 0) + 64 * (
            seen["tokens"] or 0) * most <= MAX_BYTES
        shortest = seen["shortest"] or 1
        leads = [c for i, c in enumerate(LEADS) if (seen["mask"] or 0) >> i & 1]
        rows = query_terms(queries if texts is None else texts, aliases)
        phrase = F.when(F.col("is_prefix"), F.concat("term", F.lit("*"))).otherwise(F.col("term"))
        return cls(rows.withColumn("phrase", phrase), seen["n"], small, shortest, leads)


def postings(docs: DataFrame, keys: list[str], fields: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per token occurrence: keys, doc_len, token, lead and field weight ``w``.

    ``fields`` maps a name to its token array column and weight. Nothing is
    shuffled. ``lead`` is the first character, a partition column of saved postings.
    """

    def weigh(column: str, weight: float) -> Column:
        return F.transform(F.col(column),
                           lambda t: F.struct(t.alias("token"), F.lit(float(weight)).alias("w")))

    flat = docs.select(*keys, document_length(fields).alias("doc_len"),
                       F.inline(F.concat(*[weigh(c, w) for c, w in fields.values()])))
    return flat.withColumn("lead", F.substring("token", 1, 1))


def document_length(fields: dict[str, tuple[str, float]]) -> Column:
    return sum((F.size(c) for c, _ in fields.values()), F.lit(0))


def phrase_hits(post: DataFrame, terms: Terms) -> DataFrame:
    """Postings with the phrases they match, exactly or by prefix, as equi-joins.

    Each token is looked up as a whole, and under those of its prefixes whose
    length some prefix term with the same beginning has; so a token costs a few
    probes and no vocabulary pass is needed.
    """
    k = terms.shortest
    phrases = terms.rows.select(
        "phrase", F.col("term").alias("_key"), F.substring("term", 1, 1).alias("lead"),
        F.when(F.col("is_prefix"), F.length("term")).otherwise(0).alias("_len")).distinct()
    starts = phrases.filter("_len > 0").groupBy(F.substring("_key", 1, k).alias("_start")).agg(
        F.collect_set("_len").alias("_lengths"))
    seen = terms.prune(post).withColumn("_start", F.substring("token", 1, k))
    # Starts are at most as many as terms.
    seen = lookup_join(seen, starts, ["_start"], "left", fits=terms.small)
    # A token shorter than the length asked for gives a key that no prefix term of that length has.
    lengths = F.concat(F.array(F.lit(0)), F.coalesce("_lengths", F.array().cast("array<int>")))
    seen = seen.select(*post.columns, F.explode(lengths).alias("_len"))
    key = F.when(F.col("_len") == 0, F.col("token")).otherwise(F.expr("substring(token, 1, _len)"))
    return lookup_join(seen.withColumn("_key", key), phrases, ["lead", "_len", "_key"],
                       fits=terms.small).drop("_len", "_key")


def corpus_stats(docs: DataFrame, doc_len: Column, copies: Column) -> DataFrame:
    """One row: number of rows and their average length."""
    return docs.agg(
        F.sum(copies).cast("double").alias("n_docs"),
        (F.sum(doc_len * copies) / F.sum(copies)).alias("avg_len"),
    )


def boolean_match(post: DataFrame, terms: Terms, keys: list[str]) -> DataFrame:
    """(query_id, keys) of rows that match all groups of a query, unscored."""
    hits = phrase_hits(post, terms).select("phrase", *keys).distinct()
    rows = terms.rows.select("phrase", "query_id", "n_groups", "group_no").distinct()
    groups = lookup_join(hits, rows, ["phrase"], fits=terms.small).select(
        "query_id", *keys, "n_groups", "group_no").distinct()
    whole = groups.groupBy("query_id", *keys, "n_groups").count()
    return whole.filter("count = n_groups").select("query_id", *keys)


def bm25(post: DataFrame, stats: DataFrame, terms: Terms, keys: list[str], copies: str | None = None,
         write_hits: bool = False) -> DataFrame:
    """(query_id, keys, score) of rows that match all groups of a query; lower is better.

    A query first meets only the rows of its rarest group, so rows of frequent
    phrases are never paired with queries that they cannot answer; queries with a
    group that no row has are dropped before. ``copies`` names a column telling
    for how many corpus rows a key stands. The rows of a key are brought together
    once, and the aggregations by key reuse that. ``write_hits`` writes them to the
    shared folder, for postings that are costly to derive and would be derived again
    for the document frequencies.
    """
    extra = [copies] if copies else []
    hits = phrase_hits(post, terms)
    per_phrase = hits.repartition(*keys).groupBy(*keys, "phrase", "doc_len", *extra).agg(F.sum("w").alias("f"))
    if write_hits:
        per_phrase = scratch(per_phrase, "hits")
    df = per_phrase.groupBy("phrase").agg(
        (F.sum(copies) if copies else F.count(F.lit(1))).cast("double").alias("df"))
    raw_idf = F.log((F.col("s.n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    corpus = stats.select(F.struct("n_docs", "avg_len")).scalar()
    idf = df.withColumn("s", corpus).select(
        "phrase", "df", F.col("s.avg_len").alias("avg_len"),
        F.when(raw_idf > 0, raw_idf).otherwise(IDF_FLOOR).alias("idf"))
    # As many rows as there are terms, so as bounded as these.
    asked = terms.rows.select("phrase", "query_id", "n_groups", "group_no").join(idf, "phrase")
    groups = asked.groupBy("query_id", "n_groups", "group_no").agg(
        F.sum("df").alias("most"), F.collect_list(F.struct("phrase", "idf", "avg_len")).alias("phrases"))
    group = F.struct("most", "group_no", "phrases")
    whole = groups.groupBy("query_id", "n_groups").agg(
        F.count(F.lit(1)).alias("met"), F.sort_array(F.collect_list(group)).alias("groups")).filter("met = n_groups")
    # A query's groups, the rarest first.
    whole = scratch(whole.select("query_id", "groups"), "asked")
    leads = whole.select("query_id", F.col("groups")[0]["phrases"]["phrase"].alias("lead"), "groups").select(
        "*", F.explode("lead").alias("phrase"))
    # Only phrases of rarest groups are looked up; a row for each phrase held would copy all that are held as often.
    asked = leads.select("phrase").distinct().withColumn("leads", F.lit(True))
    by_key = lookup_join(per_phrase, asked, ["phrase"], "left", fits=terms.small).groupBy(*keys, "doc_len", *extra).agg(
        F.map_from_entries(F.collect_list(F.struct("phrase", "f"))).alias("held"),
        F.collect_list(F.when(F.col("leads"), F.col("phrase"))).alias("looked_up"))
    met = lookup_join(by_key.select("*", F.explode("looked_up").alias("phrase")).drop("looked_up"), leads, ["phrase"],
                      fits=terms.small)
    # A row that holds several phrases of the rarest group meets the query by the first of them only.
    met = met.filter(F.filter("lead", lambda p: F.map_contains_key("held", p))[0] == F.col("phrase"))

    def parts(g: Column) -> Column:
        def add(total: Column, p: Column) -> Column:
            f = F.try_element_at("held", p["phrase"])
            return total + F.coalesce(p["idf"] * f * (K1 + 1) / (
                f + K1 * (1 - B + B * F.col("doc_len") / p["avg_len"])), F.lit(0.0))

        return F.aggregate(g["phrases"], F.lit(0.0), add)

    answered = F.forall("groups", lambda g: F.exists(g["phrases"], lambda p: F.map_contains_key("held", p["phrase"])))
    total = F.aggregate("groups", F.lit(0.0), lambda t, g: t + parts(g))
    return met.filter(answered).select("query_id", *keys, F.round(-total, DIGITS).alias("score"))


def text_documents(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Plain texts as one-field documents."""
    return spread(documents.select(key, text), key).select(key, tokenize(F.col(text)).alias("tokens"))


def rank_texts(documents: DataFrame, key: str, text: str, queries: DataFrame, n: int) -> DataFrame:
    """Best ``n`` texts per query by BM25: (query_id, key, score, rank); queries of the same tokens are scored once."""
    docs = text_documents(documents, key, text)
    fields = {"text": ("tokens", 1.0)}
    said = queries.select("query_id", F.array_join(tokenize(F.col("query")), " ").alias("query"))
    texts = said.filter("query <> ''").groupBy("query").agg(F.min("query_id").alias("query_id"))
    terms = Terms.of(queries, texts)
    stats = corpus_stats(docs, document_length(fields), F.lit(1))
    scores = bm25(postings(docs, [key], fields), stats, terms, [key], write_hits=True)
    best = top_n(scores, ["query_id"], [F.asc("score"), F.asc(key)], n).withColumnRenamed("query_id", "text_id")
    named = lookup_join(said, texts.withColumnRenamed("query_id", "text_id"), ["query"], fits=terms.small)
    return best.join(named.drop("query"), "text_id").select("query_id", key, "score", "rank")
