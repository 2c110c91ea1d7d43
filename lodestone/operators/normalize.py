"""Normalisation: exploded prices, observations, deduplication, catalog records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.functions.scalars import DISCOUNT, amount, blank_to_null, decimal_text, discount_of, discounted, iri, per_million, stable_id, too_large

# Price categories counted in tokens, and the units of the others.
TOKEN_CATEGORIES = ["prompt", "completion", "input_cache_read", "input_cache_write", "input_cache_write_1h"]
OTHER_UNITS = {"request": "request", "image": "image", "web_search": "search", "internal_reasoning": "unknown"}
# Developer and family of the providers' prefixes.
DEVELOPERS = {
    "openai": ("OpenAI", "GPT"), "anthropic": ("Anthropic", "Claude"), "google": ("Google", "Gemini"), "meta-llama": ("Meta", "Llama"),
    "qwen": ("Alibaba", "Qwen"), "minimax": ("MiniMax", "MiniMax"), "z-ai": ("Z.AI", "GLM"), "mistralai": ("Mistral AI", "Mistral"),
    "x-ai": ("xAI", "Grok"), "deepseek": ("DeepSeek", "DeepSeek"), "moonshotai": ("Moonshot AI", "Kimi"), "cohere": ("Cohere", "Command"),
}


def dedupe_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that comes last; an aggregate, so hot keys combine map-side."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("__row"))
    return out.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def dedupe_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that comes first."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("__row"))
    return out.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def latest_per_fact(observations: DataFrame) -> DataFrame:
    """The latest observation of every subject and predicate."""
    w = Window.partitionBy("subject_id", "predicate").orderBy(F.col("observed_at").desc_nulls_last(), F.col("id"))
    return observations.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def price_unit(category: Column) -> Column:
    out = F.when(category.isin(TOKEN_CATEGORIES), "million_tokens")
    for name, unit in OTHER_UNITS.items():
        out = out.when(category == name, unit)
    return out.otherwise("unknown")


def explode_prices(offers: DataFrame, pricing: str = "pricing", per_million_already: bool = False) -> DataFrame:
    """One row a numeric rate of each offering (offering_id, document_id, observed_at).

    `pricing` is JSON text: rates by category, an optional discount and a list of overrides.
    Null, blank, non-numeric, infinite and negative rates give no row, zero does. Token
    rates are converted to a million tokens. An override's rates are rows of tier
    `override`; it has the base discount unless it brings its own, and its other fields are
    kept as conditions. A discount that is over 1 or no finite number is an error, and so is
    a rate of more than ten integer digits: neither is lost.
    """
    keep = [F.col(c) for c in ("offering_id", "document_id", "observed_at") if c in offers.columns]
    base = offers.select(*keep, F.from_json(pricing, "map<string,string>").alias("m"))
    off = discount_of(F.element_at("m", "discount"))
    overrides = F.from_json(F.element_at("m", "overrides"), "array<map<string,string>>")
    has = F.size(F.coalesce(overrides, F.array().cast("array<map<string,string>>"))) > 0
    notes = F.nullif(F.concat_ws("; ", F.when(F.coalesce(off, F.lit(0)) != 0, F.concat(F.lit("Discount "), decimal_text(off), F.lit(" is applied."))), F.when(has, F.lit("Base rates; overrides apply."))), F.lit(""))
    rates = lambda m: F.map_filter(m, lambda k, _: ~k.isin("discount", "overrides"))
    first = base.select(*keep, off.alias("discount"), notes.alias("conditions"), F.lit("base").alias("tier"), F.lit(None).cast("bigint").alias("min_prompt_tokens"), F.explode(rates(F.col("m"))).alias("category", "raw_amount"))
    over = base.select(*keep, off.alias("base_discount"), F.explode(overrides).alias("m"))
    known = F.map_filter("m", lambda k, _: k.isin(TOKEN_CATEGORIES + list(OTHER_UNITS)))
    extra = F.map_filter("m", lambda k, _: ~k.isin([*TOKEN_CATEGORIES, *OTHER_UNITS, "overrides"]))
    second = over.select(
        *keep, F.coalesce(discount_of(F.element_at("m", "discount")), F.col("base_discount")).alias("discount"),
        F.concat(F.lit("Override: "), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(extra))))).alias("conditions"), F.lit("override").alias("tier"),
        F.element_at("m", "min_prompt_tokens").try_cast("bigint").alias("min_prompt_tokens"), F.explode(known).alias("category", "raw_amount"),
    )
    rows = first.unionByName(second).withColumn("unit", price_unit(F.col("category")))
    value = F.when(too_large("raw_amount"), F.raise_error(F.lit("a rate has more than ten integer digits")).cast("decimal(28,18)")).otherwise(amount("raw_amount"))
    wide = value.cast("decimal(34,18)")
    scaled = wide if per_million_already else F.when(F.col("unit") == "million_tokens", per_million(value)).otherwise(wide)
    rows = rows.where(value.isNotNull()).withColumn("amount", discounted(scaled, F.col("discount")))
    rows = rows.withColumn("currency", F.lit("USD")).withColumn("discount", F.coalesce("discount", F.lit(0).cast(DISCOUNT)))
    identity = ["offering_id", "category", "amount", "unit", "conditions", "tier", "min_prompt_tokens"] + (["document_id"] if "document_id" in rows.columns else [])
    return rows.withColumn("id", F.concat(F.lit("price/"), stable_id(*identity))).dropDuplicates(["id"])



def unpivot_facts(df: DataFrame, subject: str, document: str, observed_at: str, fields: dict[str, str], resources: frozenset[str] = frozenset()) -> DataFrame:
    """Columns as observations: one row a non-blank value. `fields`: column -> predicate."""
    facts = F.array(*[F.struct(F.lit(p).alias("predicate"), blank_to_null(F.col(c).cast("string")).alias("value"), F.lit("resource" if p in resources else "literal").alias("value_kind")) for c, p in fields.items()])
    out = df.select(F.col(subject).alias("subject_id"), F.col(document).alias("document_id"), F.col(observed_at).alias("observed_at"), F.explode(facts).alias("f"))
    out = out.select("subject_id", "f.predicate", "f.value", "f.value_kind", "document_id", "observed_at").where(F.col("value").isNotNull())
    return out.withColumn("id", F.concat(F.lit("observation/"), stable_id("subject_id", "predicate", "value", "document_id"))).dropDuplicates(["id"])


def model_prefix(slug: Column) -> Column:
    """First part of a slug, without leading tildes."""
    return F.split_part(F.regexp_replace(slug, "^~+", ""), F.lit("/"), F.lit(1))


def developer_of(slug: Column) -> Column:
    """Developer by the slug's prefix; an unknown prefix is its own developer."""
    prefix = model_prefix(slug)
    table = F.create_map(*[F.lit(x) for k, (d, _) in DEVELOPERS.items() for x in (k, d)])
    return F.coalesce(F.try_element_at(table, prefix), prefix)


def family_of(slug: Column) -> Column:
    """Family by the slug's prefix; of two developers some names are families of their own."""
    prefix, rest = model_prefix(slug), F.regexp_replace(slug, "^[^/]*/", "")
    table = F.create_map(*[F.lit(x) for k, (_, f) in DEVELOPERS.items() for x in (k, f)])
    return F.when((prefix == "google") & F.contains(rest, F.lit("gemma")), "Gemma").when((prefix == "openai") & rest.rlike("^(o1|o3|o4)"), "OpenAI o-series").otherwise(F.coalesce(F.try_element_at(table, prefix), prefix))


def service_mode(slug: Column) -> Column:
    return F.when(F.contains(slug, F.lit(":batch")), "batch").when(F.contains(slug, F.lit(":free")), "free").otherwise("standard")


CATALOG_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("created", T.StringType()),
    T.StructField("context_length", T.LongType()), T.StructField("supported_parameters", T.ArrayType(T.StringType())), T.StructField("pricing", T.StringType()),
    T.StructField("architecture", T.StructType([T.StructField("input_modalities", T.ArrayType(T.StringType())), T.StructField("output_modalities", T.ArrayType(T.StringType()))])),
    T.StructField("benchmarks", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))), T.StructField("hugging_face_id", T.StringType()),
])


def catalog_models(catalog: DataFrame) -> DataFrame:
    """Models of catalog rows; a slug that comes again keeps its last row (column `seq`)."""
    rows = dedupe_last(catalog, ["id"], "seq") if "seq" in catalog.columns else catalog
    slug = F.col("id")
    return rows.select(
        iri("model", slug).alias("id"), slug.alias("source_id"), "name", blank_to_null("description").alias("description"), iri("family", F.concat_ws(":", model_prefix(slug), family_of(slug))).alias("family_id"), family_of(slug).alias("family_name"),
        iri("organization", F.concat(F.lit("developer:"), model_prefix(slug))).alias("developer_id"), developer_of(slug).alias("developer_name"), F.timestamp_seconds(F.col("created").try_cast("bigint")).alias("catalog_created"), "hugging_face_id",
    )


def catalog_modalities(catalog: DataFrame) -> DataFrame:
    """(model_id, predicate, name) of every input and output modality and parameter."""
    parts = [("architecture.input_modalities", "inputModality"), ("architecture.output_modalities", "outputModality"), ("supported_parameters", "supportsCapability")]
    out = [catalog.select(iri("model", "id").alias("model_id"), F.lit(p).alias("predicate"), F.explode(c).alias("name")) for c, p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).distinct()


def catalog_benchmarks(catalog: DataFrame) -> DataFrame:
    """(model_id, benchmark, score) of the scores embedded in catalog rows; zero is a score."""
    rows = catalog.select(iri("model", "id").alias("model_id"), F.explode("benchmarks").alias("owner", "metrics"))
    rows = rows.select("model_id", "owner", F.explode("metrics").alias("metric", "score"))
    return rows.select("model_id", F.concat_ws(":", "owner", "metric").alias("benchmark"), amount("score").alias("score")).where(F.col("score").isNotNull())


#: What tells two endpoints of a model under one tag apart.
CONFIGURATION = ("name", "quantization", "context_length", "max_prompt_tokens", "max_completion_tokens")


def endpoint_offerings(endpoints: DataFrame) -> DataFrame:
    """Offerings of endpoint records (slug, name, tag, provider_name, supported_parameters,
    and those of CONFIGURATION that there are): equal tag and configuration of a model are
    one offering. Without a tag or a name, a digest of the whole record stands for the tag."""
    parts = [F.col(c) for c in CONFIGURATION if c in endpoints.columns]
    config = stable_id(*parts, F.to_json(F.array_sort(F.coalesce("supported_parameters", F.array().cast("array<string>")))))
    whole = F.sha2(F.to_json(F.struct(*[c for c in sorted(endpoints.columns) if c != "slug"])), 256)
    tag = F.coalesce(blank_to_null("tag"), blank_to_null("name"), whole)
    key = F.concat_ws(":", F.lit("endpoint"), "slug", tag, config)
    provider = F.coalesce(blank_to_null("provider_name"), F.lit("Unknown provider"))
    out = endpoints.select(iri("offering", key).alias("id"), iri("model", "slug").alias("model_id"), iri("organization", F.concat(F.lit("host:"), provider)).alias("provider_id"), provider.alias("provider_name"), F.coalesce("name", tag).alias("name"), F.lit("endpoint").alias("kind"), service_mode(F.col("slug")).alias("mode"), "context_length", F.col("tag").alias("endpoint_tag"), "quantization")
    return out.dropDuplicates(["id"])


def exact_mapping(rows: DataFrame, label: str, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose label a curated table (label, source_id) maps, and the unmatched rest.
    Names are never guessed."""
    return rows.join(mapping, rows[label] == mapping["label"]).drop("label"), rows.join(mapping, rows[label] == mapping["label"], "left_anti")


def accepted_facts(facts: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts (source_url, source_sha256) whose source the manifest (url, sha256) knows with
    the same checksum, and the rest with a reason."""
    known = manifest.select(F.col("url").alias("source_url"), F.col("sha256").alias("__sha"))
    both = facts.join(known, "source_url", "left")
    ok = F.coalesce(F.col("__sha") == F.col("source_sha256"), F.lit(False))
    return both.where(ok).drop("__sha"), both.where(~ok).withColumn("reason", F.when(F.col("__sha").isNull(), "unknown source").otherwise("checksum differs")).drop("__sha")
