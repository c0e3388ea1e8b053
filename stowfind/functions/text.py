"""Text columns: tokens, synonyms, query terms, serialised documents, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default one-level synonyms.
ALIASES: dict[str, list[str]] = {
    "diamond": ["gem", "gemstone", "precious"],
    "sword": ["weapon", "melee"],
    "axe": ["tool", "weapon", "chopping"],
    "pickaxe": ["tool", "mining"],
    "shovel": ["tool", "digging"],
    "hoe": ["tool", "farming"],
    "helmet": ["armor", "head"],
    "chestplate": ["armor", "chest"],
    "leggings": ["armor", "legs"],
    "boots": ["armor", "feet"],
    "food": ["edible"],
    "mending": ["durability", "repair", "restoration"],
    "log": ["logs"],
    "logs": ["log"],
    "plank": ["planks"],
    "planks": ["plank"],
}

# The task prefixes two encoder families expect.
NOMIC_PREFIX = {
    "RETRIEVAL_QUERY": "search_query: ",
    "RETRIEVAL_DOCUMENT": "search_document: ",
    "CLUSTERING": "clustering: ",
    "CLASSIFICATION": "classification: ",
}
E5_QUERY_PREFIX = (
    "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: "
)

_NO_STRINGS = "array<string>"


def no_strings() -> Column:
    return F.array().cast(_NO_STRINGS)


def tokenize(text: Column) -> Column:
    """Lower-case ASCII letter and digit runs; everything else separates."""
    cleaned = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.when(cleaned != "", F.split(cleaned, " ")).otherwise(no_strings())


def token_list(texts: Column) -> Column:
    """Tokens of all texts of an array, in order."""
    return F.coalesce(F.flatten(F.transform(texts, tokenize)), no_strings())


def aliases_for(token: Column, aliases: dict[str, list[str]] = ALIASES) -> Column:
    if not aliases:
        return no_strings()
    pairs = [p for k, v in aliases.items() for p in (F.lit(k), F.array(*[F.lit(a) for a in v]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), token), no_strings())


def expand(tokens: Column, aliases: dict[str, list[str]] = ALIASES) -> Column:
    """Distinct tokens together with their synonyms."""
    synonyms = F.flatten(F.transform(tokens, lambda t: aliases_for(t, aliases)))
    return F.array_distinct(F.concat(tokens, synonyms))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_query(text: Column) -> Column:
    """Whitespace-normalised query, NULL when nothing is left."""
    return F.nullif(collapse(text), F.lit(""))


def blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"^\s*$")


def query_terms(queries: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Query text to rows (query_id, n_groups, group_no, phrase_no, term, is_prefix).

    Terms of a group are alternatives, groups must all match, and only the
    last query token is a prefix. Duplicate tokens stay.
    """
    tokens = queries.select("query_id", tokenize(F.col("query")).alias("tokens"))
    groups = tokens.select(
        "query_id", F.size("tokens").alias("n_groups"),
        F.posexplode("tokens").alias("group_no", "token"),
    )
    phrases = groups.select(
        "query_id", "n_groups", "group_no", "token",
        F.posexplode(
            F.concat(F.array("token"), F.array_sort(aliases_for(F.col("token"), aliases)))
        ).alias("phrase_no", "term"),
    )
    return phrases.select(
        "query_id", "n_groups", "group_no", "phrase_no", "term",
        ((F.col("phrase_no") == 0) & (F.col("group_no") == F.col("n_groups") - 1)).alias("is_prefix"),
    )


def embedding_text(d: Column) -> Column:
    """``label: value`` lines of a descriptor in their fixed order."""

    def lines(label: str, values: Column) -> Column:
        clean = F.filter(F.transform(values, collapse), lambda v: v != "")
        return F.coalesce(F.transform(clean, lambda v: F.concat(F.lit(label + ": "), v)), no_strings())

    def keyed(entries: Column) -> Column:
        return F.transform(
            F.array_sort(F.map_entries(entries)),
            lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
        )

    parts = F.concat(
        lines("material", F.array(d["material_key"])),
        lines("display", d["display_text"]),
        lines("lore", d["lore"]),
        lines("enchantment", F.array_sort(F.map_keys(d["enchantments"]))),
        lines("attribute", keyed(d["attributes"])),
        lines("trait", d["traits"]),
        lines("metadata", keyed(d["scalar_metadata"])),
        lines("tag", d["custom_tags"]),
    )
    return F.array_join(F.transform(parts, lambda p: F.concat(p, F.lit("\n"))), "")


def task_prefix(text: Column, strategy: str, task: Column) -> Column:
    """Prefix a text the way the encoder family wants it for the task."""
    if strategy == "NONE":
        return text
    if strategy == "E5_INSTRUCT":
        return F.when(task == "RETRIEVAL_QUERY", F.concat(F.lit(E5_QUERY_PREFIX), text)).otherwise(text)
    if strategy != "NOMIC":
        raise ValueError(f"unknown prefix strategy {strategy}")
    prefix = F.lit(NOMIC_PREFIX["RETRIEVAL_DOCUMENT"])
    for name in ("RETRIEVAL_QUERY", "CLUSTERING", "CLASSIFICATION"):
        prefix = F.when(task == name, F.lit(NOMIC_PREFIX[name])).otherwise(prefix)
    return F.concat(prefix, text)


def title_name(key: Column) -> Column:
    """Human name of a namespaced key."""
    bare = F.regexp_replace(key, "^[^:]*:(?=.)", "")
    return F.when(blank(key), F.lit("")).otherwise(F.initcap(F.replace(bare, F.lit("_"), F.lit(" "))))


def leaf_name(d: Column) -> Column:
    shown = F.filter(d["display_text"], lambda t: ~blank(t))
    return F.coalesce(F.try_element_at(shown, F.lit(1)), title_name(d["material_key"]))


def indexed_key(prefix: Column, index: Column) -> Column:
    digits = index.cast("string")
    return F.concat(prefix, F.lit("."), F.when(index < 100, F.lpad(digits, 3, "0")).otherwise(digits))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def score_text(score: Column) -> Column:
    return F.format_string("%.2f", score)


def found_line(query: Column, stacks: Column, distance: Column) -> Column:
    shown = F.coalesce(F.upper(collapse(query)), F.lit(""))
    return F.format_string("%s FOUND · %d · %dm", shown, stacks, F.round(distance, 0).cast("long"))
