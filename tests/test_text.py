import pytest
from helpers import descriptors, item
from pyspark.sql import functions as F

from stowfind.functions import descriptor as D
from stowfind.functions import taxonomy as X
from stowfind.functions import text as T
from stowfind.functions import vectors as V
from stowfind.plans.index import sparse_vectors
from stowfind.plans.search import sparse_scores


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text, tokens", [
    ("Oak_Log  #2!", ["oak", "log", "2"]), ("", []), (None, []), ("!!!", []), ("  ", []), ("café-au-lait", ["caf", "au", "lait"]),
])
def test_tokenize(spark, text, tokens):
    assert one(spark, T.tokenize(F.lit(text).cast("string"))) == tokens


@pytest.mark.parametrize("query, groups", [
    ("oak log", {(0, "oak", False), (1, "log", True), (1, "logs", False)}),
    ("food", {(0, "food", True), (0, "edible", False)}),
    ("plank", {(0, "plank", True), (0, "planks", False)}),
    ("!!!", set()),
    ("stone stone", {(0, "stone", False), (1, "stone", True)}),
])
def test_query_terms(spark, query, groups):
    rows = T.query_terms(spark.createDataFrame([(1, query)], "query_id long, query string")).collect()
    assert {(r["group_no"], r["term"], r["is_prefix"]) for r in rows} == groups
    assert len(rows) == len(groups)


def test_rank_fusion_values(spark):
    def score(a, b):
        return one(spark, V.rrf_display(60, F.lit(a).cast("int"), F.lit(b).cast("int")))

    assert score(1, 1) == 1.0
    assert score(1, None) == score(None, 1) == 0.5
    assert score(None, None) == 0.0
    with pytest.raises(ValueError):
        V.rrf_display(0, F.lit(1), F.lit(1))
    with pytest.raises(Exception, match="rank"):
        score(0, 1)


def vector(spark, d):
    rows = sparse_vectors(descriptors(spark, d).withColumnRenamed("d", "descriptor"), "id").collect()
    return {r["term"]: r["weight"] for r in rows}


def test_category_weights(spark):
    found = vector(spark, item("materialword", ["displayword"], ["loreword"], {"enchantword": 3}, {"attributeword": 1.0},
                               ["traitword"], {"keyword": "valueword"}, ["tagword"]))
    assert found == {"materialword": 8, "displayword": 8, "tagword": 6, "enchantword": 5, "attributeword": 5,
                     "traitword": 4, "keyword": 3, "valueword": 3, "loreword": 2}
    assert vector(spark, item("materialword", ["materialword materialword"])) == {"materialword": 16}


def cosine(spark, d, query):
    vectors = sparse_vectors(descriptors(spark, d).withColumnRenamed("d", "descriptor"), "id")
    asked = spark.createDataFrame([(1, query)], "query_id long, query string")
    row = sparse_scores(vectors, asked, "id").first()
    return row["cosine"] if row else 0.0


def test_realistic_pickaxe(spark):
    d = item("minecraft:diamond_pickaxe", enchantments={"minecraft:mending": 1}, traits=["item", "tool:pickaxe"], metadata={
        "material_max_stack_size": "1", "material_max_durability": "1561", "unbreakable": "false"})
    assert cosine(spark, d, "diamond") >= 0.30
    assert cosine(spark, d, "mending") >= 0.30
    assert cosine(spark, d, "---") == 0.0


def tagged(spark, material):
    rows = descriptors(spark, item(material))
    traits, tags = X.taxonomy(F.col("d.material_key"))
    return rows.select(traits.alias("traits"), tags.alias("tags")).first()


def furnished(spark, material):
    row = tagged(spark, material)
    return item(material, traits=[*row["traits"], "block", "item", "burnable", "solid"], tags=row["tags"], metadata={
        "material_max_stack_size": "64", "material_max_durability": "0"})


def test_wood_family(spark):
    gate, log, crimson = (furnished(spark, f"minecraft:{m}") for m in (
        "oak_fence_gate", "oak_log", "crimson_fence_gate"))
    assert cosine(spark, gate, "wood") >= 0.30
    assert cosine(spark, gate, "logs") < 0.30
    assert cosine(spark, log, "wood") >= 0.30
    assert cosine(spark, log, "logs") >= 0.30
    assert cosine(spark, crimson, "wood") < 0.30


@pytest.mark.parametrize("material", ["minecraft:chest", "minecraft:trapped_chest"])
def test_chest_family(spark, material):
    d = furnished(spark, material)
    assert {"wooden", "planks"} <= set(d[7])
    for query in ("wood", "plank", "planks"):
        assert cosine(spark, d, query) >= 0.30


@pytest.mark.parametrize("material, traits", [
    ("minecraft:diamond_sword", "weapon sword melee combat diamond"),
    ("minecraft:iron_pickaxe", "tool pickaxe mining iron"),
    ("minecraft:diamond_chestplate", "armor chestplate wearable diamond chest"),
    ("minecraft:redstone_ore", "ore mineral mineable redstone stone"),
    ("minecraft:chest", "chest storage wood"),
    ("minecraft:nether_star", ""),
    ("minecraft:bedrock", ""),
    ("light_blue_wool", "light_blue wool soft"),
    ("minecraft:tropical_fish_bucket", "tool bucket container mobbucket mob"),
    ("minecraft:leather_horse_armor", "leather armor horsearmor horse mount pet dyeable"),
])
def test_taxonomy(spark, material, traits):
    found = set(tagged(spark, material)["traits"])
    assert set(traits.split()) <= found
    if not traits:
        assert not found


def test_search_fields(spark):
    d = item("minecraft:oak_planks", ["Oak Planks"], ["A wooden board"], {"minecraft:mending": 1}, traits=["building"],
             tags=["planks"])
    fields = D.search_fields(F.col("d"))
    row = descriptors(spark, d).select(*[c.alias(n) for n, c in fields.items()]).first()
    assert row["material"] == ["minecraft", "oak", "planks"]
    assert row["lore"] == ["a", "wooden", "board"]
    assert {"building", "planks", "plank", "durability"} <= set(row["tags"])


def test_semantic_hash(spark):
    base, other = item("a", ["x"], enchantments={"p": 1, "q": 2}), item("a", ["y"])
    turned = item("a", ["x"], enchantments={"q": 2, "p": 1})
    rows = descriptors(spark, base, turned, other, item("b", ["x"])).select(D.semantic_hash(F.col("d")).alias("h")).collect()
    assert rows[0]["h"] == rows[1]["h"]
    assert len({r["h"] for r in rows}) == 3


def test_bounds_keep_code_points_and_first_value(spark):
    long = "\U0001F600" * 300
    d = item("m", [long, " ", "b", "a", "a"], traits=["t", "t", ""], metadata={"k" * 256 + "a": "first", "k" * 256 + "b": "second"},
             tags=[f"{i:04d}" for i in range(400)])
    row = descriptors(spark, d).select(D.bounded(F.col("d")).alias("d")).first()["d"]
    assert row["display_text"] == ["a", "a", "b", "\U0001F600" * 256]
    assert row["traits"] == ["t"]
    assert row["scalar_metadata"] == {"k" * 256: "first"}
    assert row["custom_tags"] == [f"{i:04d}" for i in range(256)]


def test_merge_keeps_base_values(spark):
    base, extra = item("m", ["x"], enchantments={"e": 1}, traits=["a"]), item("other", ["y"], enchantments={"e": 9, "f": 2}, traits=["a", "b"])
    pair = descriptors(spark, base).join(descriptors(spark, extra).withColumnRenamed("d", "x"), "id")
    row = pair.select(D.merge(F.col("d"), F.col("x")).alias("m")).first()["m"]
    assert row["material_key"] == "m" and row["display_text"] == ["x", "y"]
    assert row["enchantments"] == {"e": 1, "f": 2} and row["traits"] == ["a", "b"]


def test_names_and_lines(spark):
    assert one(spark, T.title_name(F.lit("minecraft:oak_log"))) == "Oak Log"
    assert one(spark, T.title_name(F.lit("odd:"))) == "Odd:"
    assert one(spark, T.indexed_key(F.lit("p"), F.lit(7))) == "p.007"
    assert one(spark, T.indexed_key(F.lit("p"), F.lit(1234))) == "p.1234"
    assert one(spark, T.found_line(F.lit(" oak  log "), F.lit(3), F.lit(2.5))) == "OAK LOG FOUND · 3 · 3m"
    assert one(spark, T.score_band(F.lit(0.7))) == "high"
    assert one(spark, T.score_text(F.lit(0.125))) == "0.13"


def test_dense_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(V.dense_cosine("a", "b")).collect()] == [-1.0, 0.0]
    with pytest.raises(Exception, match="dimension"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(V.dense_cosine("a", "b")).collect()
