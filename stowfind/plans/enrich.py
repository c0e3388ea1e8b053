"""Contributions to descriptors when an index is built.

A contributor is a named function from (desc_id, descriptor) to (desc_id, extra): a frame of descriptor structs whose
parts are added. Contributors see the descriptors as they came and are merged in the order of their names, so a keyed
value of an earlier one stays. A contributor whose frame cannot be planned, or lacks the columns, is left out and
reported; one that repeats a descriptor adds each of its rows once.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowfind.functions.descriptor import descriptor, merge
from stowfind.functions.taxonomy import contribution, taxonomy

Contributor = Callable[[DataFrame], DataFrame]
log = logging.getLogger(__name__)


def material_rules(descriptors: DataFrame) -> DataFrame:
    """Traits and tags by the rule table of materials, and traits by enchantments."""
    d = F.col("descriptor")
    traits, tags = contribution(d, *taxonomy(d["material_key"]))
    return descriptors.select("desc_id", descriptor(d["material_key"], traits=traits, tags=tags).alias("extra"))


def _by_name(a: Column, b: Column) -> Column:
    def key(x):
        return F.struct(x["name"], x["order"])

    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def enrich(descriptors: DataFrame, contributors: Mapping[str, Contributor]) -> DataFrame:
    """``descriptors`` with what the contributors add; ids and all other columns stay."""
    plain = descriptors.select("desc_id", "descriptor")
    kind = plain.schema["descriptor"].dataType
    added = None
    for name in sorted(contributors):
        try:
            extra = contributors[name](plain).select(
                "desc_id", F.lit(name).alias("name"), F.col("extra").cast(kind).alias("extra")).where("extra is not null")
            extra.schema  # planned here, so that a faulty one fails alone
        except (PySparkException, ArithmeticError, LookupError, TypeError, ValueError) as failure:
            log.warning("contributor %s is left out: %s", name, failure)
            continue
        added = extra if added is None else added.unionByName(extra)
    if added is None:
        return descriptors
    # All that is added to a descriptor meets once, whatever the number of contributors. Maps have no order, so the
    # rows are sorted by name and text.
    gathered = added.withColumn("order", F.to_json("extra")).groupBy("desc_id").agg(F.array_sort(
        F.collect_list(F.struct("name", "order", "extra")), _by_name).alias("more"))
    whole = F.when(F.col("more").isNull(), F.col("descriptor")).otherwise(
        F.aggregate("more", F.col("descriptor").cast(kind), lambda d, x: merge(d, x["extra"]).cast(kind)))
    return (descriptors.join(gathered, "desc_id", "left").withColumn("descriptor", whole).select(*descriptors.columns))
