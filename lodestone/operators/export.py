"""Nested export, statistics and search over the entity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def natural_value(x: Column) -> Column:
    """Text as JSON: a whole number, else a number, else text."""
    whole, number = x.try_cast("bigint"), x.try_cast("double")
    return F.coalesce(F.when(x.rlike(r"^-?\d+$"), whole.cast("string")), F.when(number.isNotNull() & ~F.isnan(number), number.cast("string")), F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2))


def sorted_lists(rows: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """(key, name): the rows of each key as a sorted list of structs. A window sorts rows once;
    an aggregate would sort them on both sides of the shuffle and pack a list for each in between."""
    each = Window.partitionBy(key).orderBy(*fields)
    out = rows.select(key, F.collect_list(F.struct(*fields)).over(each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(name), F.row_number().over(each).alias("__n"))
    return out.where(F.col("__n") == 1).drop("__n")


def nested_catalog(models: DataFrame, offerings: DataFrame, prices: DataFrame) -> DataFrame:
    """One row a model: its offerings, each with its prices, as one JSON text; sorted, so
    that equal tables give equal texts."""
    by_offer = sorted_lists(prices.select("offering_id", "category", "tier", "unit", F.col("amount").cast("string").alias("amount"), "conditions"), "offering_id", ["category", "tier", "unit", "amount", "conditions"], "prices")
    joined = offerings.join(by_offer, offerings.id == by_offer.offering_id, "left")
    offers = joined.select("model_id", "id", "provider_id", "kind", "mode", F.coalesce("prices", F.array().cast(by_offer.schema["prices"].dataType)).alias("prices"))
    by_model = sorted_lists(offers, "model_id", ["id", "provider_id", "kind", "mode", "prices"], "offerings")
    out = models.join(by_model, models.id == by_model.model_id, "left")
    return out.select("id", "name", F.to_json(F.struct("id", "name", "source_id", F.coalesce("offerings", F.array().cast(by_model.schema["offerings"].dataType)).alias("offerings"))).alias("json"))


def organization_degrees(organizations: DataFrame, models: DataFrame, offerings: DataFrame) -> DataFrame:
    """(id, name, models, offerings): what each organization develops and hosts."""
    made = models.groupBy(F.col("developer_id").alias("id")).agg(F.count(F.lit(1)).alias("models"))
    hosted = offerings.groupBy(F.col("provider_id").alias("id")).agg(F.count(F.lit(1)).alias("offerings"))
    out = organizations.join(made, "id", "left").join(hosted, "id", "left")
    return out.select("id", "name", F.coalesce("models", F.lit(0)).alias("models"), F.coalesce("offerings", F.lit(0)).alias("offerings")).orderBy(F.lower("name"), "id")


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of every table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def search(models: DataFrame, text: str = "", developer: str | None = None, limit: int = 150) -> DataFrame:
    """Models whose name, id, family or developer contains the text, in any case."""
    fields = F.lower(F.concat_ws(" ", "name", "source_id", "family_name", "developer_id"))
    out = models.where(F.contains(fields, F.lit(text.lower())))
    if developer is not None:
        out = out.where(F.col("developer_id") == developer)
    return out.orderBy(F.lower("name"), "source_id").limit(limit)


def facets(models: DataFrame, column: str) -> DataFrame:
    return models.select(column).distinct().orderBy(column)
