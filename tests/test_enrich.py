from helpers import containers, item, items
from pyspark.sql import functions as F

from stowfind.functions.descriptor import descriptor
from stowfind.plans.enrich import enrich, material_rules
from stowfind.plans.index import SearchIndex
from stowfind.plans.search import hybrid_search
from stowfind.schema import Policy


def shouting(descriptors):
    d = F.col("descriptor")
    return descriptors.select("desc_id", descriptor(d["material_key"], tags=F.array(F.lit("loud")),
                                                    metadata=F.create_map(F.lit("k"), F.lit("new"))).alias("extra"))


def quiet(descriptors):
    return descriptors.where("false").select("desc_id", F.col("descriptor").alias("extra"))


def faulty(descriptors):
    return descriptors.select("missing")


def worse(descriptors):
    raise ValueError("no rules today")


def found(spark, contributors):
    rows = [(1, 1, "chest", 0, 1, item("minecraft:diamond_sword", metadata={"k": "old"})),
            (2, 2, "chest", 0, 1, item("minecraft:granite"))]
    cells = spark.createDataFrame([("w", 0, 0, True)], "world_id string, cell_x int, cell_z int, available boolean")
    index = SearchIndex.build(items(spark, rows), containers(spark, [(1, "w", 1, 64, 0), (2, "w", 2, 64, 0)]), cells,
                              contributors=contributors)
    queries = spark.createDataFrame(
        [(1, 1, "combat", "w", 0, 64, 0), (2, 1, "loud", "w", 0, 64, 0)],
        "query_id long, player_id long, query string, world_id string, ox int, oy int, oz int")
    got = hybrid_search(index, queries, Policy(min_score=0.01)).items
    return {(r["query_id"], r["item_id"]) for r in got.collect()}, index


def test_what_contributors_add_is_found_and_failures_stay_alone(spark, caplog):
    assert found(spark, None)[0] == set()
    got, index = found(spark, {"rules": material_rules, "shout": shouting, "quiet": quiet, "faulty": faulty, "worse": worse})
    assert got == {(1, 1), (2, 1), (2, 2)}
    assert {"faulty", "worse"} == {r.args[0] for r in caplog.records if r.name == "stowfind.plans.enrich"}
    sword = next(r["descriptor"] for r in index.descriptors.collect() if "sword" in r["descriptor"]["material_key"])
    assert sword["scalar_metadata"] == {"k": "old"} and {"weapon", "sword"} <= set(sword["traits"])
    assert index.descriptors.count() == 2


def test_repeated_contributions_and_no_contributors(spark):
    frame = spark.createDataFrame([(1, item("minecraft:bow"))], "desc_id long, descriptor struct<" + ",".join((
        "material_key:string", "display_text:array<string>", "lore:array<string>", "enchantments:map<string,int>",
        "attributes:map<string,double>", "traits:array<string>", "scalar_metadata:map<string,string>",
        "custom_tags:array<string>")) + ">")
    assert enrich(frame, {}) is frame
    twice = enrich(frame, {"a": lambda d: shouting(d).unionByName(shouting(d))}).collect()
    assert len(twice) == 1 and list(twice[0]["descriptor"]["custom_tags"]) == ["loud"]
