"""Registered queries for text and descriptor columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowfind.catalog.base import query, sql, text_of, tokens_sql
from stowfind.functions import descriptor as D
from stowfind.functions import taxonomy as X
from stowfind.functions import text as T
from stowfind.sources.tables import Tables

# Material names handed to parts in turn, so that every rule family occurs.
WARES = """
    diamond_sword iron_pickaxe golden_axe stone_shovel wooden_hoe netherite_helmet leather_boots
    chainmail_leggings diamond_chestplate turtle_helmet elytra shield bow crossbow trident mace arrow
    spectral_arrow tipped_arrow firework_rocket snowball ender_pearl wind_charge shears flint_and_steel
    fishing_rod carrot_on_a_stick lead name_tag brush spyglass compass recovery_compass clock filled_map
    water_bucket lava_bucket milk_bucket powder_snow_bucket pufferfish_bucket axolotl_bucket bone_meal
    written_book wolf_armor golden_horse_armor leather_horse_armor zombie_head wither_skeleton_skull
    carved_pumpkin white_shulker_box light_blue_wool red_bed bedrock glass_pane white_concrete_powder
    cyan_glazed_terracotta oak_log dark_oak_planks spruce_door crimson_stem sandstone cobblestone
    deepslate_gold_ore raw_iron copper_ingot iron_nugget emerald lapis_block coal charcoal chest
    trapped_chest barrel bundle redstone_ore powered_rail comparator repeater quartz amethyst_shard
    nether_star bread
""".split()

WARES_SQL = {"wares": ("", (
    "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE 'minecraft:' END || list_extract(["
    + ", ".join(f"'{w}'" for w in WARES)
    + f"], CAST(p_partkey % {len(WARES)} + 1 AS INT)) AS material_key, p_size FROM part"))}


def wares(t: Tables):
    """Parts with a material name each; a quarter comes without namespace."""
    key = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(w) for w in WARES]), (key % len(WARES) + 1).cast("int"))
    space = F.when(key % 4 == 3, F.lit("")).otherwise(F.lit("minecraft:"))
    return t.read("part").select("p_partkey", F.concat(space, name).alias("material_key"), "p_size")


def joined(values, sort: bool = True):
    return F.array_join(F.array_sort(values) if sort else values, " ")


@query("f01_tokenize", sql("", f"""
    SELECT doc_id, len(toks) AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5
    FROM (SELECT doc_id, {tokens_sql('text')} AS toks FROM documents)"""))
def f01(t):
    tokens = T.tokenize(F.col("text"))
    return t.read("documents").select("doc_id", tokens.alias("toks")).select(
        "doc_id", F.size("toks").cast("long").alias("n_tokens"),
        F.md5(F.array_join("toks", " ")).alias("tokens_md5"))


@query("f02_aliases", sql("wares aliases", f"""
    SELECT p_partkey, token, alias
    FROM (SELECT p_partkey, unnest({tokens_sql('material_key')}) AS token FROM wares) JOIN aliases USING (token)""",
    WARES_SQL))
def f02(t):
    tokens = wares(t).select("p_partkey", F.explode(T.tokenize(F.col("material_key"))).alias("token"))
    return tokens.select("p_partkey", "token", F.explode(T.aliases_for(F.col("token"))).alias("alias"))


_TOKENS = {"tk": ("wares", f"SELECT p_partkey, unnest({tokens_sql('material_key')}) AS token FROM wares")}


@query("f03_expand", sql("tk aliases", """
    SELECT p_partkey, string_agg(token, ' ' ORDER BY token) AS expanded
    FROM (SELECT p_partkey, token FROM tk UNION SELECT p_partkey, alias FROM tk JOIN aliases USING (token))
    GROUP BY p_partkey""", WARES_SQL | _TOKENS))
def f03(t):
    return wares(t).select("p_partkey", joined(T.expand(T.tokenize(F.col("material_key")))).alias("expanded"))


@query("f04_search_fields", sql("fields descs", """
    SELECT copies, material AS material_key, p_type, p_brand, p_size, has_lore,
           string_agg(token, ' ' ORDER BY token) FILTER (field = 'material') AS material,
           string_agg(token, ' ' ORDER BY token) FILTER (field = 'display') AS display,
           string_agg(token, ' ' ORDER BY token) FILTER (field = 'tags') AS tags,
           string_agg(token, ' ' ORDER BY token) FILTER (field = 'enchantments') AS enchantments,
           coalesce(string_agg(token, ' ' ORDER BY token) FILTER (field = 'lore'), '') AS lore
    FROM (SELECT fields.*, copies, material, p_type, p_brand, p_size, has_lore FROM fields JOIN descs USING (d))
    GROUP BY d, copies, material, p_type, p_brand, p_size, has_lore"""))
def f04(t):
    from stowfind.plans.index import distinct_descriptors

    d = F.col("descriptor")
    fields = D.search_fields(d)
    return distinct_descriptors(t.slim_items(), t.parts()).select(
        "copies", d["material_key"].alias("material_key"), d["traits"][0].alias("p_type"),
        d["custom_tags"][0].alias("p_brand"), d["scalar_metadata"]["size"].cast("int").alias("p_size"),
        (F.size(d["lore"]) > 0).alias("has_lore"), *[joined(c).alias(n) for n, c in fields.items()])


def _terms_sql():
    from stowfind.catalog.base import terms_parts

    return sql("terms", """
        SELECT query_id, CAST(n_groups AS INT) AS n_groups, CAST(group_no AS INT) AS group_no,
               CAST(phrase_no AS INT) AS phrase_no, term, is_prefix FROM terms""", terms_parts("squeries"))


@query("f05_query_terms", _terms_sql())
def f05(t):
    return T.query_terms(t.supplier_queries())


@query("f06_normalize_query", """
    SELECT conv_id, turn, md5(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS text_md5
    FROM conversations""")
def f06(t):
    return t.read("conversations").select(
        "conv_id", "turn", F.md5(F.coalesce(T.normalize_query(F.col("text")), F.lit(""))).alias("text_md5"))


# The text of a part's descriptor, all its fields.
_EMBEDDED = """'material: ' || material || chr(10) || 'display: ' || p_name || chr(10)
        || CASE WHEN has_lore THEN 'lore: made of ' || p_brand || chr(10) ELSE '' END
        || CASE WHEN has_ench THEN 'enchantment: mending' || chr(10) ELSE '' END
        || 'attribute: weight=' || p_size || '.0' || chr(10) || 'trait: ' || p_type || chr(10)
        || 'metadata: size=' || p_size || chr(10) || 'tag: ' || p_brand || chr(10)"""


@query("f07_embedding_text", sql("parts", f"""
    SELECT p_partkey, md5({_EMBEDDED}) AS text_md5 FROM parts"""))
def f07(t):
    return t.parts().select("p_partkey", F.md5(T.embedding_text(F.col("descriptor"))).alias("text_md5"))


@query("f08_task_prefix", """
    SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN 'search_query: ' WHEN 1 THEN 'search_document: '
                       WHEN 2 THEN 'clustering: ' ELSE 'classification: ' END || text) AS nomic_md5,
           md5(CASE doc_id % 4 WHEN 0 THEN 'Instruct: Given a web search query, retrieve relevant passages that '
               || 'answer the query' || chr(10) || 'Query: ' ELSE '' END || text) AS e5_md5
    FROM documents""")
def f08(t):
    names = F.array(*[F.lit(n) for n in T.NOMIC_PREFIX])
    task = F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.col("text")
    return t.read("documents").select(
        "doc_id", F.md5(T.task_prefix(text, "NOMIC", task)).alias("nomic_md5"),
        F.md5(T.task_prefix(text, "E5_INSTRUCT", task)).alias("e5_md5"))


@query("f09_semantic_hash", sql("items", """
    SELECT min(item_id) AS first_item, count(*) AS items, CAST(sum(amount) AS BIGINT) AS amount
    FROM items GROUP BY d"""))
def f09(t):
    hashed = t.items().withColumn("h", D.semantic_hash(F.col("descriptor")))
    return hashed.groupBy("h").agg(F.min("item_id").alias("first_item"), F.count(F.lit(1)).alias("items"),
                                   F.sum("amount").alias("amount")).drop("h")


def _piece(i: int) -> str:
    return f"CAST(sum(CAST(CAST('0x' || substr(h, {16 * i + 1}, 16) AS UBIGINT) AS HUGEINT)) AS VARCHAR)"


@query("f10_content_fingerprint", sql("items parts", f"""
    SELECT container_id, count(*) AS slots,
           sha256(concat_ws('|', count(*), {', '.join(_piece(i) for i in range(4))})) AS fingerprint
    FROM (SELECT container_id, sha256(slot || '|' || body || ' x' || amount) AS h
          FROM items JOIN (SELECT DISTINCT d, md5({_EMBEDDED}) AS body FROM parts) USING (d))
    GROUP BY container_id"""))
def f10(t):
    payload = F.concat(F.md5(T.embedding_text(F.col("descriptor"))), F.lit(" x"), F.col("amount").cast("string"))
    return D.content_fingerprint(t.items(), "container_id", F.col("path")[0]["slot"], payload)


_TITLE = "array_to_string(list_transform(string_split(replace({}, '_', ' '), ' '), " \
         "lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
_BARE = "regexp_replace({}, '^[^:]*:(.)', '\\1')"


@query("f11_title_name", sql("wares", f"""
    SELECT p_partkey, {_TITLE.format(_BARE.format('material_key'))} AS name FROM wares""", WARES_SQL))
def f11(t):
    return wares(t).select("p_partkey", T.title_name(F.col("material_key")).alias("name"))


@query("f12_leaf_name", sql("parts", f"""
    SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE {_TITLE.format(_BARE.format('material'))} END
           AS name FROM parts"""))
def f12(t):
    d = F.col("descriptor")
    shown = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.array(F.lit(" ")), d["display_text"])) \
        .otherwise(F.array(F.lit("")))
    plain = t.parts().select("p_partkey", D.descriptor(d["material_key"], display=shown).alias("d"))
    return plain.select("p_partkey", T.leaf_name(F.col("d")).alias("name"))


@query("f13_score_band", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           CASE WHEN l_discount * 10 >= 0.7 THEN 'high' WHEN l_discount * 10 >= 0.4 THEN 'medium' ELSE 'low' END
           AS band, printf('%.2f', l_discount) AS shown, CAST(floor(l_extendedprice / 64 + 0.5) AS BIGINT) AS metres
    FROM lineitem""")
def f13(t):
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        T.score_band(F.col("l_discount") * 10).alias("band"), T.score_text(F.col("l_discount")).alias("shown"),
        F.floor(F.col("l_extendedprice") / 64 + 0.5).alias("metres"))


@query("f14_bounded_descriptor", """
    SELECT doc_id, len(kept) AS n_lines, md5(array_to_string(kept, chr(10))) AS lines_md5, len(tags) AS n_tags,
           md5(array_to_string(tags, chr(10))) AS tags_md5
    FROM (SELECT doc_id, list_slice(list_sort(cut), 1, 256) AS kept,
                 list_slice(list_sort(list_distinct(cut)), 1, 256) AS tags
          FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
                       lambda s: array_to_string(list_slice(regexp_extract_all(s, '(?s).'), 1, 256), '')),
                       lambda s: NOT regexp_full_match(s, '[ \\t\\n\\x0B\\f\\r]*')) AS cut FROM documents))""")
def f14(t):
    lines = F.split("text", "\n")
    raw = D.descriptor(F.lit("document"), display=lines, tags=lines)
    kept = t.read("documents").select("doc_id", D.bounded(raw).alias("d"))
    shown, tags = F.col("d.display_text"), F.col("d.custom_tags")
    return kept.select(
        "doc_id", F.size(shown).cast("long").alias("n_lines"), F.md5(F.array_join(shown, "\n")).alias("lines_md5"),
        F.size(tags).cast("long").alias("n_tags"), F.md5(F.array_join(tags, "\n")).alias("tags_md5"))


def _rules_sql() -> dict:
    def text(value):
        return "NULL" if value is None else f"'{value}'"

    rows = ", ".join(
        f"({text(p)}, {text(also)}, {text(unless)}, "
        f"[{', '.join(map(text, traits))}]::VARCHAR[], [{', '.join(map(text, tags))}]::VARCHAR[])"
        for p, also, unless, traits, tags in X.rule_table())
    return {
        "rules": ("", f"SELECT * FROM (VALUES {rows}) t(pattern, also, unless, traits, tags)"),
        "hits": ("wares rules", """
            SELECT material_key, traits, tags
            FROM (SELECT DISTINCT material_key, upper(regexp_replace(material_key, '^[^:]*:', '')) AS m FROM wares)
            JOIN rules ON regexp_matches(m, pattern) AND (also IS NULL OR regexp_matches(m, also))
                      AND (unless IS NULL OR NOT regexp_matches(m, unless))"""),
        "tagged": ("hits", """
            SELECT material_key,
                   (SELECT string_agg(v, ' ' ORDER BY v) FROM (SELECT DISTINCT unnest(traits) AS v FROM hits h
                        WHERE h.material_key = m.material_key)) AS traits,
                   (SELECT string_agg(v, ' ' ORDER BY v) FROM (SELECT DISTINCT unnest(tags) AS v FROM hits h
                        WHERE h.material_key = m.material_key)) AS tags
            FROM (SELECT DISTINCT material_key FROM wares) m"""),
    }


@query("f16_taxonomy", sql("tagged", """
    SELECT p_partkey, material_key, coalesce(traits, '') AS traits, coalesce(tags, '') AS tags
    FROM wares JOIN tagged USING (material_key)""", WARES_SQL | _rules_sql()))
def f16(t):
    rows = wares(t)
    return rows.join(X.material_traits(rows), "material_key").select(
        "p_partkey", "material_key", joined(F.col("traits")).alias("traits"), joined(F.col("tags")).alias("tags"))


def enchanted(t: Tables):
    key, size = F.col("p_partkey"), F.col("p_size")
    levels = F.when(key % 3 == 0, F.create_map(F.lit("mending"), size % 5 + 1)) \
        .when(key % 3 == 1, F.create_map(F.lit("mending"), F.lit(1), F.lit("sharpness"), size % 4 + 1))
    return wares(t).select("p_partkey", "material_key", "p_size", D.descriptor(
        F.col("material_key"), enchantments=levels, traits=F.array(F.lit("item"), F.lit("wood")),
        metadata=F.create_map(F.lit("size"), size.cast("string"))).alias("d"))


_ENCHANTED = {"ench": ("wares", """
    SELECT p_partkey, material_key, p_size,
           CASE p_partkey % 3 WHEN 0 THEN ['enchanted', 'mending', 'mending_' || (p_size % 5 + 1)]
                WHEN 1 THEN ['enchanted', 'mending', 'mending_1', 'sharpness', 'sharpness_' || (p_size % 4 + 1)]
                ELSE [] END AS extra FROM wares""")}


@query("f15_merge", sql("ench tagged", f"""
    SELECT p_partkey, {text_of("list_distinct(list_concat(['item', 'wood'], extra, string_split(coalesce(traits, 'item'), ' ')))")}
           AS traits, coalesce(tags, '') AS tags, 'kept' AS origin, CAST(p_size AS VARCHAR) AS size
    FROM ench JOIN tagged USING (material_key)""", WARES_SQL | _ENCHANTED | _rules_sql()))
def f15(t):
    base = enchanted(t).join(X.material_traits(wares(t)), "material_key")
    traits, tags = X.contribution(F.col("d"), F.col("traits"), F.col("tags"))
    extra = D.bounded(D.descriptor(
        F.lit("ignored"), traits=traits, tags=tags,
        metadata=F.create_map(F.lit("size"), F.lit("lost"), F.lit("origin"), F.lit("kept"))))
    merged = base.select("p_partkey", D.merge(F.col("d"), extra).alias("m"))
    return merged.select(
        "p_partkey", joined(F.col("m.traits")).alias("traits"), joined(F.col("m.custom_tags")).alias("tags"),
        F.col("m.scalar_metadata")["origin"].alias("origin"), F.col("m.scalar_metadata")["size"].alias("size"))


@query("f17_enchantment_traits", sql("ench", f"""
    SELECT p_partkey, {text_of('extra')} AS traits FROM ench""", WARES_SQL | _ENCHANTED))
def f17(t):
    return enchanted(t).select("p_partkey", joined(D.enchantment_traits(F.col("d"))).alias("traits"))


@query("f18_raw_features", """
    SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'block' END, 'item',
               CASE WHEN p_size % 3 = 0 THEN 'burnable' END, CASE WHEN p_size % 5 = 0 THEN 'solid' END,
               CASE WHEN p_type = 'PROMO' THEN 'tool:sword' END], lambda v: v IS NOT NULL), ' ') AS traits,
           lower(p_type) || '|' || lower(p_brand) || '|any|' || 'add_number' AS attribute_key,
           'material_max_stack_size=' || p_size AS metadata FROM part""")
def f18(t):
    size = F.col("p_size")
    raw = t.read("part").select(
        "p_partkey", (size % 2 == 0).alias("block"), F.lit(True).alias("item"), (size % 3 == 0).alias("burnable"),
        (size % 5 == 0).alias("solid"), F.when(F.col("p_type") == "PROMO", F.array(F.lit("tool:sword")))
        .otherwise(T.no_strings()).alias("memberships"), F.lower("p_type").alias("attribute"),
        F.lower("p_brand").alias("modifier"), F.lit("any").alias("slot_group"), F.lit("ADD_NUMBER").alias("op"), size)
    return D.raw_features(raw, ["block", "item", "burnable", "solid"]).select(
        "p_partkey", F.array_join("traits", " ").alias("traits"), "attribute_key",
        F.concat(F.lit("material_max_stack_size="), F.col("p_size").cast("string")).alias("metadata"))


@query("f19_indexed_key", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           CASE WHEN l_partkey % 1500 < 100 THEN printf('page.%03d', l_partkey % 1500)
                ELSE 'page.' || (l_partkey % 1500) END AS page_key FROM lineitem""")
def f19(t):
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        T.indexed_key(F.lit("page"), F.col("l_partkey") % 1500).alias("page_key"))


@query("f20_found_line", sql("squeries", """
    SELECT query_id, upper(query) || ' FOUND · ' || (query_id % 7) || ' · ' || (query_id % 13 + 1) || 'm' AS line
    FROM squeries"""))
def f20(t):
    return t.supplier_queries().select("query_id", T.found_line(
        F.concat(F.lit("  "), F.replace("query", F.lit(" "), F.lit("  "))), F.col("query_id") % 7,
        F.col("query_id") % 13 + F.lit(0.5)).alias("line"))
