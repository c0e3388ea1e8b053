"""Row checks that split a table into good rows and quarantined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reasons``: names of the rules a row breaks (a NULL result breaks it)."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*broken)))


def split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    checked = validate(df, rules)
    return (checked.filter(F.size("reasons") == 0).drop("reasons"),
            checked.filter(F.size("reasons") > 0))


def item_rules() -> dict[str, Column]:
    d = F.col("descriptor")
    finite = F.forall(F.map_values(d["attributes"]), lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    return {
        "path": F.size("path") >= 1,
        "slot": F.forall("path", lambda s: s["slot"] >= 0),
        "label": F.forall("path", lambda s: s["label"].rlike(r"\S")),
        "amount": F.col("amount") > 0,
        "material": d["material_key"].rlike(r"\S"),
        "level": F.forall(F.map_values(d["enchantments"]), lambda v: v > 0),
        "attribute": finite,
    }


def sparse_vector_rules() -> dict[str, Column]:
    """For rows with ``terms`` (array of term, weight) and the stored ``norm``."""
    keys = F.transform("terms", lambda t: t["term"])
    total = F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["weight"] * t["weight"])
    return {
        "entries": F.size("terms") <= 16_384,
        "key": F.forall(keys, lambda k: k.rlike(r"\S") & (F.length(k) <= 256)),
        "duplicate": F.size(F.array_distinct(keys)) == F.size(keys),
        "weight": F.forall("terms", lambda t: (t["weight"] > 0) & (t["weight"] < float("inf"))),
        "norm": F.abs(F.sqrt(total) - F.col("norm")) <= 1e-9 * F.greatest(F.lit(1.0), F.col("norm")),
    }


def dense_vector_rules(vector: str, norm: str, dimensions: int) -> dict[str, Column]:
    v = F.col(vector)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return {
        "dimension": F.size(v) == dimensions,
        "finite": F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))),
        "norm": F.abs(F.sqrt(total) - F.col(norm)) <= 1e-6,
    }


def score_rule(score: str) -> dict[str, Column]:
    s = F.col(score)
    return {"score": ~F.isnan(s) & (s >= -1.0) & (s <= 1.0)}


def provider_rule(provider_id: str, version: int) -> dict[str, Column]:
    return {"provider": (F.col("provider_id") == provider_id) & (F.col("provider_version") == version)}


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Fail the job on the first row that breaks a rule."""
    checked = validate(df, rules)
    message = F.concat(F.lit("broken rules: "), F.array_join("reasons", ","))
    guard = F.when(F.size("reasons") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return checked.filter(guard).drop("reasons")


def same_count(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row with both counts and whether they agree."""
    counts = left.select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(F.lit(0).alias("l"), F.lit(1).alias("r")))
    return counts.agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows")).withColumn(
        "equal", F.col("left_rows") == F.col("right_rows"))
