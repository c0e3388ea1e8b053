"""Traits and tags derived from material names by a rule table.

A rule is (pattern, also, unless, traits, tags): it applies to the upper-cased
material without namespace when ``pattern`` and ``also`` are found and
``unless`` is not. Rules are independent; their order does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowfind.functions.descriptor import enchantment_traits
from stowfind.functions.text import no_strings

# Base materials in order of precedence, the first match counts.
BASE_MATERIALS = [
    ("NETHERITE", "netherite", ""),
    ("DIAMOND", "diamond", ""),
    ("IRON", "iron", ""),
    ("GOLD", "gold golden", ""),
    ("STONE", "stone", ""),
    ("WOOD", "wood wooden", "wood"),
    ("LEATHER", "leather", ""),
    ("CHAINMAIL", "chainmail", ""),
]

# Colour prefixes, wood families and mineral names.
COLOURS = ("white orange magenta light_blue yellow lime pink gray light_gray cyan purple blue "
           "brown green red black").split()
WOODS = "spruce birch jungle acacia mangrove cherry bamboo".split()
MINERALS = "diamond emerald gold iron copper netherite lapis redstone quartz amethyst".split()
HEAD_KINDS = "skeleton zombie creeper wither dragon piglin player".split()

# All other rules.
RULES = [
    # redstone parts
    ("REDSTONE", None, None, "redstone", ""),
    ("POWERED", None, None, "powered", ""),
    ("COMPARATOR", None, None, "comparator", ""),
    ("REPEATER", None, None, "repeater", ""),
    # block families
    ("GLASS", None, None, "glass", ""),
    ("GLASS", "PANE", None, "pane", ""),
    ("WOOL", None, None, "wool soft", ""),
    ("CONCRETE", None, None, "concrete", ""),
    ("CONCRETE", "POWDER", None, "powder", ""),
    ("TERRACOTTA", None, None, "terracotta clay", ""),
    ("TERRACOTTA", "GLAZED", None, "glazed", ""),
    ("CANDLE", None, None, "candle lightsource", ""),
    ("CARPET", None, None, "carpet flooring", ""),
    ("BED", None, "BEDROCK", "bed furniture", ""),
    ("BANNER", None, None, "banner decorative", ""),
    ("SHULKER", None, None, "shulker storage container", ""),
    ("OAK", None, "DARK_OAK", "oak wood", "wood"),
    ("DARK_OAK", None, None, "darkoak wood", "wood"),
    ("CRIMSON", None, None, "crimson netherstem", ""),
    ("WARPED", None, None, "warped netherstem", ""),
    ("STONE", None, "REDSTONE|GLOWSTONE|SANDSTONE", "stone", ""),
    ("COBBLESTONE", None, None, "cobblestone cobble", ""),
    ("DEEPSLATE", None, None, "deepslate", ""),
    ("BRICK", None, None, "brick", ""),
    ("SANDSTONE", None, None, "sandstone", ""),
    # minerals
    ("_ORE$|^ANCIENT_DEBRIS$", None, None, "ore mineral mineable", ""),
    ("^RAW_", None, None, "raw mineral smeltable", ""),
    ("_INGOT$", None, None, "ingot mineral metal refined", ""),
    ("_NUGGET$", None, None, "nugget mineral metal", ""),
    ("^(DIAMOND|EMERALD|AMETHYST_SHARD|LAPIS_LAZULI|PRISMARINE_SHARD|PRISMARINE_CRYSTALS|QUARTZ"
     "|NETHER_QUARTZ)$", None, None, "gem mineral precious", ""),
    ("COAL", None, "CHARCOAL", "coal mineral", ""),
    ("_BLOCK$", "DIAMOND|EMERALD|GOLD|IRON|COPPER|NETHERITE|LAPIS|REDSTONE|COAL|AMETHYST|QUARTZ|RAW_",
     None, "mineralblock storage", ""),
    # weapons
    ("_SWORD$", None, None, "weapon sword melee combat", ""),
    ("_AXE$", None, "PICKAXE", "weapon axe melee combat", ""),
    ("^BOW$", None, None, "weapon bow ranged projectile combat", ""),
    ("^CROSSBOW$", None, None, "weapon crossbow ranged projectile combat", ""),
    ("^TRIDENT$", None, None, "weapon trident melee ranged throwable combat", ""),
    ("^MACE$", None, None, "weapon mace melee combat heavyhitter", ""),
    ("ARROW", None, None, "ammo ammunition projectile combat", ""),
    ("^SPECTRAL_ARROW$", None, None, "spectral", ""),
    ("^TIPPED_ARROW$", None, None, "tipped potion", ""),
    ("^FIREWORK_ROCKET$", None, None, "ammo firework projectile elytra", ""),
    ("^(SNOWBALL|EGG)$", None, None, "weapon throwable projectile", ""),
    ("^ENDER_PEARL$", None, None, "throwable teleport projectile", ""),
    ("^WIND_CHARGE$", None, None, "weapon throwable projectile knockback", ""),
    ("^SHIELD$", None, None, "weapon shield defense combat blocking", ""),
    # tools
    ("_PICKAXE$", None, None, "tool pickaxe mining breaking", ""),
    ("_SHOVEL$", None, None, "tool shovel digging breaking", ""),
    ("_HOE$", None, None, "tool hoe farming tilling", ""),
    ("_AXE$", None, "PICKAXE", "tool axe woodcutting chopping breaking", ""),
    ("^SHEARS$", None, None, "tool shears shearing harvesting", ""),
    ("^FLINT_AND_STEEL$", None, None, "tool flintandsteel fire igniter", ""),
    ("^FISHING_ROD$", None, None, "tool fishingrod fishing catching", ""),
    ("^(CARROT|WARPED_FUNGUS)_ON_A_STICK$", None, None, "tool riding control", ""),
    ("^LEAD$", None, None, "tool lead leash mob", ""),
    ("^NAME_TAG$", None, None, "tool nametag naming mob", ""),
    ("^BRUSH$", None, None, "tool brush archaeology excavation", ""),
    ("^SPYGLASS$", None, None, "tool spyglass zoom scouting", ""),
    ("^(RECOVERY_)?COMPASS$", None, None, "tool compass navigation", ""),
    ("^RECOVERY_COMPASS$", None, None, "recovery death", ""),
    ("^CLOCK$", None, None, "tool clock time", ""),
    ("MAP", None, None, "tool map navigation", ""),
    ("^FILLED_MAP$", None, None, "filled", ""),
    ("BUCKET", None, None, "tool bucket container", ""),
    ("^WATER_BUCKET$", None, None, "water", ""),
    ("^LAVA_BUCKET$", None, None, "lava", ""),
    ("^MILK_BUCKET$", None, None, "milk", ""),
    ("^POWDER_SNOW_BUCKET$", None, None, "powdersnow", ""),
    ("FISH_BUCKET|^AXOLOTL_BUCKET$|^TADPOLE_BUCKET$", None, None, "mobbucket mob", ""),
    ("^BONE_MEAL$", None, None, "tool bonemeal farming growth", ""),
    ("^(WRITABLE|WRITTEN)_BOOK$", None, None, "tool book writing", ""),
    # armour
    ("_HELMET$", None, None, "armor helmet headgear head wearable", ""),
    ("^TURTLE_HELMET$", None, None, "turtle waterbreathing", ""),
    ("_CHESTPLATE$", None, None, "armor chestplate chest body wearable", ""),
    ("_LEGGINGS$", None, None, "armor leggings pants legs wearable", ""),
    ("_BOOTS$", None, None, "armor boots footwear feet wearable", ""),
    ("^ELYTRA$", None, None, "armor elytra wings chest wearable flying gliding", ""),
    ("_HORSE_ARMOR", None, None, "armor horsearmor horse mount pet", ""),
    ("_HORSE_ARMOR", "LEATHER", None, "leather", ""),
    ("^WOLF_ARMOR$", None, None, "armor wolfarmor wolf pet", ""),
    ("^LEATHER_", None, None, "leather dyeable", ""),
    ("^CHAINMAIL_", None, None, "chainmail chain", ""),
    ("_HEAD|_SKULL", None, None, "head headgear wearable decorative", ""),
    ("^CARVED_PUMPKIN$", None, None, "head headgear wearable pumpkin enderman", ""),
    # storage
    ("SHULKER_BOX", None, None, "shulkerbox storage container", ""),
    ("CHEST", None, None, "chest storage", ""),
    ("^(TRAPPED_)?CHEST$", None, None, "wood", "wood wooden planks"),
    ("BARREL", None, None, "barrel storage", ""),
    ("^BUNDLE$", None, None, "bundle storage container", ""),
]


def rule_table() -> list[tuple[str, str | None, str | None, list[str], list[str]]]:
    """All rules with the regular families filled in."""
    rows = []
    for i, (name, traits, tags) in enumerate(BASE_MATERIALS):
        earlier = "|".join(b[0] for b in BASE_MATERIALS[:i]) or None
        rows.append((name, None, earlier, traits, tags))
    rows += [(f"^{c.upper()}_", None, None, c, "") for c in COLOURS]
    rows += [(w.upper(), None, None, f"{w} wood", "wood") for w in WOODS]
    rows += [(m.upper(), None, None, f"{m} mineral", "") for m in MINERALS]
    rows += [("_HEAD|_SKULL", k.upper(), None, k, "") for k in HEAD_KINDS]
    rows += RULES
    return [(p, also, unless, traits.split(), tags.split()) for p, also, unless, traits, tags in rows]


def bare_material(material: Column) -> Column:
    return F.upper(F.regexp_replace(material, "^[^:]*:", ""))


def taxonomy(material: Column) -> tuple[Column, Column]:
    """(traits, tags) of a material key, sorted and distinct."""
    name = bare_material(material)
    traits, tags = [], []
    for pattern, also, unless, rule_traits, rule_tags in rule_table():
        hit = name.rlike(pattern)
        if also:
            hit = hit & name.rlike(also)
        if unless:
            hit = hit & ~name.rlike(unless)
        traits.append(F.when(hit, F.array(*[F.lit(t) for t in rule_traits])))
        if rule_tags:
            tags.append(F.when(hit, F.array(*[F.lit(t) for t in rule_tags])))

    def gather(parts: list[Column]) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*parts)))))

    return gather(traits), gather(tags)


def material_traits(materials: DataFrame, column: str = "material_key") -> DataFrame:
    """One row per distinct material with its traits and tags."""
    distinct = materials.select(column).distinct()
    traits, tags = taxonomy(F.col(column))
    return distinct.select(column, traits.alias("traits"), tags.alias("tags"))


def contribution(d: Column, traits: Column, tags: Column) -> tuple[Column, Column]:
    """Traits and tags a descriptor gains: those of its material and its enchantments."""
    return (F.array_sort(F.array_union(F.coalesce(traits, no_strings()), enchantment_traits(d))),
            F.coalesce(tags, no_strings()))
