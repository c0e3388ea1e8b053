"""Descriptor columns: canonical form, merge, hashes and search fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowfind.functions.text import ALIASES, aliases_for, blank, no_strings, token_list, tokenize

MAX_ENTRIES = 256
MAX_CODE_POINTS = 256

# BM25 column weights and sparse category weights.
FIELD_WEIGHTS = {"material": 10.0, "display": 8.0, "tags": 6.0, "enchantments": 5.0, "lore": 2.0}
SPARSE_WEIGHTS = {
    "material": 8.0, "display": 8.0, "custom_tag": 6.0, "enchantment": 5.0, "attribute": 5.0,
    "trait": 4.0, "metadata_key": 3.0, "metadata_value": 3.0, "lore": 2.0,
}

LISTS = ("display_text", "lore")
SETS = ("traits", "custom_tags")
MAPS = ("enchantments", "attributes", "scalar_metadata")


def descriptor(material: Column, display=None, lore=None, enchantments=None, attributes=None,
               traits=None, metadata=None, tags=None) -> Column:
    """A descriptor struct; parts left out are empty."""

    def part(value, kind):
        empty = F.array() if kind.startswith("array") else F.create_map()
        value = empty if value is None else F.coalesce(value, empty.cast(kind))
        return value.cast(kind)

    return F.struct(
        material.alias("material_key"),
        part(display, "array<string>").alias("display_text"),
        part(lore, "array<string>").alias("lore"),
        part(enchantments, "map<string,int>").alias("enchantments"),
        part(attributes, "map<string,double>").alias("attributes"),
        part(traits, "array<string>").alias("traits"),
        part(metadata, "map<string,string>").alias("scalar_metadata"),
        part(tags, "array<string>").alias("custom_tags"),
    )


def bounded(d: Column, entries: int = MAX_ENTRIES, points: int = MAX_CODE_POINTS) -> Column:
    """Canonical descriptor: sorted, cut to ``points`` code points and ``entries`` entries."""

    def cut(text: Column) -> Column:
        return F.substring(text, 1, points)

    def texts(values: Column) -> Column:
        return F.filter(F.transform(values, cut), lambda v: ~blank(v))

    def mapping(values: Column, text_values: bool) -> Column:
        pairs = F.transform(
            F.array_sort(F.map_entries(values)),
            lambda e: F.struct(cut(e["key"]).alias("key"),
                               (cut(e["value"]) if text_values else e["value"]).alias("value")),
        )
        keep = F.filter(pairs, lambda e: ~blank(e["key"]) & (~blank(e["value"]) if text_values else F.lit(True)))
        keys = F.transform(keep, lambda e: e["key"])
        first = F.filter(keep, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
        return F.map_from_entries(F.slice(first, 1, entries))

    return F.struct(
        cut(d["material_key"]).alias("material_key"),
        *[F.slice(F.array_sort(texts(d[c])), 1, entries).alias(c) for c in ("display_text", "lore")],
        mapping(d["enchantments"], False).alias("enchantments"),
        mapping(d["attributes"], False).alias("attributes"),
        F.slice(F.array_sort(F.array_distinct(texts(d["traits"]))), 1, entries).alias("traits"),
        mapping(d["scalar_metadata"], True).alias("scalar_metadata"),
        F.slice(F.array_sort(F.array_distinct(texts(d["custom_tags"]))), 1, entries).alias("custom_tags"),
    )


def merge(base: Column, extra: Column) -> Column:
    """Add a contribution: lists append, sets join, and keyed base values stay."""
    order = ("material_key", "display_text", "lore", "enchantments", "attributes", "traits",
             "scalar_metadata", "custom_tags")

    def part(name: str) -> Column:
        if name == "material_key":
            return base[name]
        if name in LISTS:
            return F.array_sort(F.concat(base[name], extra[name]))
        if name in SETS:
            return F.array_sort(F.array_union(base[name], extra[name]))
        missing = F.map_filter(extra[name], lambda k, v: ~F.map_contains_key(base[name], k))
        return F.map_concat(base[name], missing)

    return F.struct(*[part(n).alias(n) for n in order])


def enchantment_traits(d: Column) -> Column:
    entries = F.array_sort(F.map_entries(d["enchantments"]))
    leveled = F.transform(entries, lambda e: F.concat(e["key"], F.lit("_"), e["value"].cast("string")))
    return F.when(
        F.size(entries) > 0,
        F.concat(F.array(F.lit("enchanted")), F.transform(entries, lambda e: e["key"]), leveled),
    ).otherwise(no_strings())


def raw_features(raw: DataFrame, flags: list[str]) -> DataFrame:
    """Traits and attribute keys from raw attribute columns.

    True flags become traits, ``memberships`` are added, and an attribute's key
    joins attribute, modifier, slot group and lower-cased operation.
    """
    set_flags = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in flags]))
    key = F.concat_ws("|", "attribute", "modifier", "slot_group", F.lower("op"))
    return raw.withColumn("traits", F.concat(set_flags, "memberships")).withColumn("attribute_key", key)


def semantic_hash(d: Column) -> Column:
    """SHA-256 of everything but the amount; maps hash as sorted entries."""
    return F.sha2(F.to_json(F.struct(
        d["material_key"].alias("m"),
        F.array_sort(d["display_text"]).alias("d"),
        F.array_sort(d["lore"]).alias("l"),
        F.array_sort(F.map_entries(d["enchantments"])).alias("e"),
        F.array_sort(F.map_entries(d["attributes"])).alias("a"),
        F.array_sort(F.array_distinct(d["traits"])).alias("t"),
        F.array_sort(F.map_entries(d["scalar_metadata"])).alias("s"),
        F.array_sort(F.array_distinct(d["custom_tags"])).alias("c"),
    )), 256)


def search_fields(d: Column, aliases: dict[str, list[str]] = ALIASES) -> dict[str, Column]:
    """The five full-text fields as arrays of distinct tokens."""
    material = F.array_distinct(tokenize(d["material_key"]))
    display = F.array_distinct(token_list(d["display_text"]))
    lore = F.array_distinct(token_list(d["lore"]))
    enchantments = F.array_distinct(
        token_list(F.concat(F.map_keys(d["enchantments"]), F.map_keys(d["attributes"]))))
    own = F.array_distinct(token_list(F.concat(d["custom_tags"], d["traits"])))
    everything = F.concat(material, display, lore, enchantments, own)
    synonyms = F.flatten(F.transform(everything, lambda t: aliases_for(t, aliases)))
    return {
        "material": material,
        "display": display,
        "tags": F.array_distinct(F.concat(own, synonyms)),
        "enchantments": enchantments,
        "lore": lore,
    }


def weighted_texts(d: Column) -> Column:
    """Array of (text, weight): each text of a descriptor with its category weight."""

    def part(values: Column, category: str) -> Column:
        return F.transform(
            values, lambda v: F.struct(v.alias("text"), F.lit(SPARSE_WEIGHTS[category]).alias("weight")))

    return F.concat(
        part(F.array(d["material_key"]), "material"),
        part(d["display_text"], "display"),
        part(d["custom_tags"], "custom_tag"),
        part(F.map_keys(d["enchantments"]), "enchantment"),
        part(F.map_keys(d["attributes"]), "attribute"),
        part(d["traits"], "trait"),
        part(F.map_keys(d["scalar_metadata"]), "metadata_key"),
        part(F.map_values(d["scalar_metadata"]), "metadata_value"),
        part(d["lore"], "lore"),
    )


DIGEST_PIECES = ("h1", "h2", "h3", "h4")


def content_digest_columns(slot: Column, payload: Column) -> list[Column]:
    """Four 64-bit pieces of the slot hash, all of it, to be summed per container."""
    digest = F.sha2(F.concat_ws("|", slot.cast("string"), payload), 256)
    return [
        F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)").alias(name)
        for i, name in enumerate(DIGEST_PIECES)
    ]


def content_fingerprint(items: DataFrame, key: str, slot: Column, payload: Column) -> DataFrame:
    """Order-free content hash per container.

    The slot hashes are added up, so partial sums combine before the shuffle and
    a container with very many slots never sits in one task.
    """
    pieces = items.select(key, *content_digest_columns(slot, payload))
    sums = pieces.groupBy(key).agg(
        F.count(F.lit(1)).alias("slots"), *[F.sum(p).alias(p) for p in DIGEST_PIECES])
    shown = [F.col(c).cast("string") for c in ("slots", *DIGEST_PIECES)]
    return sums.select(key, "slots", F.sha2(F.concat_ws("|", *shown), 256).alias("fingerprint"))
