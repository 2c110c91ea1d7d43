"""Entity tables and their mapping to a graph.

`silver_graph` maps the thirteen-table layout (models, families, ..., external_links) to
entities. `star_tables` lays the star-schema test tables out as those tables, so that every
query and check of the engine runs on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.scalars import blank_to_null, stable_id
from lodestone.plans.graph import DCTERMS, OWL, PROV, RDFS, SCHEMA, VOCAB, Entity, EntityGraph

LABEL, SAME_AS, SOURCE, URL = RDFS + "label", OWL + "sameAs", PROV + "wasDerivedFrom", SCHEMA + "url"
V = lambda *names: {VOCAB + a: b for a, b in (n.split(":") for n in names)}

# The vocabulary's local names, with the column each is read from.
SINGLE = {
    "models": V("sourceId:source_id", "description:description", "belongsToFamily:family_id", "developedBy:developer_id", "catalogCreated:catalog_created", "canonicalSlug:canonical_slug", "knowledgeCutoff:knowledge_cutoff", "expirationDate:expiration_date") | {LABEL: "name"},
    "families": V("developedBy:developer_id") | {LABEL: "name"},
    "organizations": {LABEL: "name"},
    "offerings": V("offersModel:model_id", "hostedBy:provider_id", "offeringKind:kind", "serviceMode:mode", "contextLength:context_length", "maxOutputTokens:max_output_tokens", "serviceStatus:status", "endpointTag:endpoint_tag", "quantization:quantization", "observedAt:observed_at") | {LABEL: "name", SOURCE: "document_id"},
    "prices": V("priceCategory:category", "priceAmount:amount", "currency:currency", "priceUnit:unit", "rawAmount:raw_amount", "discount:discount", "conditions:conditions", "priceTier:tier", "minPromptTokens:min_prompt_tokens", "observedAt:observed_at") | {SOURCE: "document_id"},
    "capabilities": {LABEL: "name"},
    "modalities": {LABEL: "name"},
    "observations": V("aboutEntity:subject_id", "observedProperty:predicate", "literalValue:literal_value", "resourceValue:resource_value", "observedAt:observed_at") | {SOURCE: "document_id"},
    "benchmarks": V("evaluator:evaluator", "benchmarkVersion:version") | {LABEL: "name"},
    "evaluations": V("evaluatedModel:model_id", "onBenchmark:benchmark_id", "score:score", "scoreUnit:unit", "evaluationConfig:config", "attribution:attribution", "observedAt:evaluated_at") | {SOURCE: "document_id"},
    "documents": V("sourceKind:kind", "sha256:sha256", "snapshotFile:snapshot_file", "observedAt:retrieved_at") | {LABEL: "name", URL: "url"},
    "external_links": V("linkSubject:subject", "linkTarget:target", "description:reason", "sha256:sha256", "snapshotFile:snapshot_file", "observedAt:retrieved_at") | {SOURCE: "source_url"},
}
CLASSES = {
    "models": "AIModel", "families": "ModelFamily", "organizations": "Organization", "offerings": "ModelOffering", "prices": "PriceSpecification",
    "capabilities": "Capability", "modalities": "Modality", "observations": "FactObservation", "benchmarks": "Benchmark", "evaluations": "Evaluation",
    "documents": "SourceDocument", "external_links": "ExternalLink",
}
RESOURCES = frozenset({VOCAB + x for x in "belongsToFamily developedBy offersModel hostedBy hasPrice aboutEntity observedProperty resourceValue evaluatedModel onBenchmark linkSubject linkTarget supportsCapability inputModality outputModality hasRepository relatedDocumentation".split()} | {SOURCE, URL, SAME_AS})
#: The kind of entity that values of these predicates are.
TARGETS = {VOCAB + p: {kind} for p, kind in (x.split(":") for x in "belongsToFamily:families developedBy:organizations offersModel:models hostedBy:organizations hasPrice:prices evaluatedModel:models onBenchmark:benchmarks supportsCapability:capabilities inputModality:modalities outputModality:modalities".split())}
#: Organizations that are platforms: typed as a service and never as an organization.
SERVICE = SCHEMA + "Service"


def _pairs(df: DataFrame, s: str, o: str) -> DataFrame:
    return df.select(F.col(s).alias("s"), F.col(o).alias("o")).where(F.col("s").isNotNull() & F.col("o").isNotNull()).distinct()


def silver_graph(tables: dict[str, DataFrame]) -> EntityGraph:
    """The graph of the given tables; tables and columns that are absent have no triples.

    A resource-valued or literal observation also gives the direct triple (subject,
    predicate, value); links give owl:sameAs. An offering's prices are found by the prices'
    own column for it.
    """
    out = []
    multi: dict[str, dict[str, DataFrame]] = {}
    if "prices" in tables:
        multi["offerings"] = {VOCAB + "hasPrice": _pairs(tables["prices"], "offering_id", "id")}
    if "observations" in tables:
        facts = tables["observations"]
        for kind, names in (("models", ("supportsCapability", "inputModality", "outputModality", "hasRepository", "relatedDocumentation", "parameterCount", "license", "libraryName", "pipelineTag")), ("offerings", ("supportsCapability",))):
            for name in names:
                column = "resource_value" if VOCAB + name in RESOURCES else "literal_value"
                mine = facts.where((F.col("predicate") == VOCAB + name) & (F.col("subject_kind") == kind))
                multi.setdefault(kind, {})[VOCAB + name] = _pairs(mine, "subject_id", column)
    if "external_links" in tables:
        multi["organizations"] = {SAME_AS: _pairs(tables["external_links"], "subject", "target")}
    for name, single in SINGLE.items():
        if name not in tables:
            continue
        df = tables[name]
        has = {p: c for p, c in single.items() if c in df.columns}
        cls = VOCAB + CLASSES[name]
        platform = "is_service" if "is_service" in df.columns else None
        if platform:
            df = df.withColumn("__class", F.when(F.col(platform), F.lit(SERVICE)).otherwise(F.lit(cls)))
        out.append(Entity(name, (cls, SERVICE) if platform else (cls,), df, "id", has, multi.get(name, {}), RESOURCES, "__class" if platform else None, {VOCAB + "hasPrice": "offering_id"} if name == "prices" and "offering_id" in df.columns else {}))
    return EntityGraph(out, TARGETS)


# How the star schema's flags are read as categories of the catalog.
PRICE_CATEGORY = {"N": "prompt", "A": "completion", "R": "input_cache_read"}
PRICE_TIER = {"O": "base", "F": "override"}
DOCUMENT_KIND = {"O": "official", "F": "model_card", "P": "catalog"}
FACT = {"click": "contextLength", "view": "maxOutputTokens", "purchase": "knowledgeCutoff", "signup": "license", "error": "hasRepository"}


def _mapped(c: str, values: dict[str, str]):
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(c))


def _id(kind: str, *cols: str):
    return F.concat(F.lit(kind + "/"), F.concat_ws("-", *[F.col(c).cast("string") for c in cols]))


def star_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Entity tables over the star schema: parts are models, suppliers host them, line items
    are prices, orders are source documents, events are observations, labels evaluations."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    part, line = t("part"), t("lineitem")
    models = part.select(
        _id("model", "p_partkey").alias("id"), F.concat(F.lower("p_type"), F.lit("/"), "p_partkey").alias("source_id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"),
        _id("family", "p_brand").alias("family_id"), F.col("p_brand").alias("family_name"), _id("maker", "p_size").alias("developer_id"),
    )
    families = part.select(_id("family", "p_brand").alias("id"), F.col("p_brand").alias("name")).distinct()
    makers = part.select(_id("maker", "p_size").alias("id"), F.concat(F.lit("Maker "), "p_size").alias("name"), F.lit(False).alias("is_service")).distinct()
    hosts = t("supplier").select(_id("host", "s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 4 == 0).alias("is_service"))
    key = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    offerings = (
        line.select("l_partkey", "l_suppkey").distinct()
        .select(
            _id("offering", "l_partkey", "l_suppkey").alias("id"), _id("model", "l_partkey").alias("model_id"), _id("host", "l_suppkey").alias("provider_id"),
            F.when(F.col("l_partkey") % 3 == 0, "direct").when(F.col("l_partkey") % 3 == 1, "catalog").otherwise("endpoint").alias("kind"),
            F.when(F.col("l_suppkey") % 5 == 0, "batch").otherwise("standard").alias("mode"), ((F.col("l_partkey") % 200) * 1000).alias("context_length"),
            F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("tag-"), F.col("l_suppkey"))).alias("endpoint_tag"),
        )
    )
    raw, off = F.col("l_extendedprice").cast("decimal(15,2)"), F.col("l_discount").cast("decimal(15,2)")
    prices = line.select(
        F.concat(F.lit("price/"), stable_id(*[F.col(c).cast("decimal(15,2)") if c == "l_extendedprice" else c for c in key])).alias("id"),
        _id("offering", "l_partkey", "l_suppkey").alias("offering_id"), _mapped("l_returnflag", PRICE_CATEGORY).alias("category"), (raw * (1 - off)).cast("decimal(18,4)").alias("amount"),
        F.lit("USD").alias("currency"), F.lit("million_tokens").alias("unit"), raw.alias("raw_amount"), off.alias("discount"),
        F.when(off > 0, F.concat(F.lit("discount "), off.cast("string"))).alias("conditions"), _mapped("l_linestatus", PRICE_TIER).alias("tier"),
        _id("document", "l_orderkey").alias("document_id"), F.col("l_shipdate").alias("observed_at"),
    )
    documents = t("orders").select(
        _id("document", "o_orderkey").alias("id"), F.concat(F.lit("https://source.example/"), F.col("o_orderkey").cast("string")).alias("url"), _mapped("o_orderstatus", DOCUMENT_KIND).alias("kind"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"), F.col("o_orderdate").alias("retrieved_at"),
    )
    resource = F.col("event_type") == "error"
    value = F.get_json_object("props", "$.k")
    observations = t("events").select(
        _id("observation", "event_id").alias("id"), _id("model", "user_id").alias("subject_id"), F.lit("models").alias("subject_kind"),
        F.concat(F.lit(VOCAB), _mapped("event_type", FACT)).alias("predicate"), F.when(~resource, value).alias("literal_value"),
        F.when(resource, F.concat(F.lit("https://hub.example/"), value)).alias("resource_value"), _id("document", "event_id").alias("document_id"), F.col("ts").alias("observed_at"),
    )
    capabilities = spark.createDataFrame([("capability/tools", "tools"), ("capability/json", "json")], "id string, name string")
    capable = part.where(F.col("p_size") <= 25).select(
        F.concat(F.lit("observation/cap-"), F.col("p_partkey").cast("string")).alias("id"), _id("model", "p_partkey").alias("subject_id"), F.lit("models").alias("subject_kind"), F.lit(VOCAB + "supportsCapability").alias("predicate"),
        F.lit(None).cast("string").alias("literal_value"), F.when(F.col("p_size") % 2 == 0, "capability/tools").otherwise("capability/json").alias("resource_value"),
        F.lit("document/0").alias("document_id"), F.lit(None).cast("timestamp_ntz").alias("observed_at"),
    )
    benchmarks = spark.createDataFrame([("benchmark/quality", "quality", "labels"), ("benchmark/toxic", "toxic", "labels")], "id string, name string, evaluator string")
    scores = t("labels").select("doc_id", F.expr("stack(2, 'quality', quality, 'toxic', toxic) as (metric, score)")).where(F.col("score").isNotNull())
    evaluations = scores.select(
        _id("evaluation", "doc_id", "metric").alias("id"), _id("model", "doc_id").alias("model_id"), _id("benchmark", "metric").alias("benchmark_id"), "score", F.lit("label").alias("unit"),
        F.concat(F.lit('{"metric": "'), F.col("metric"), F.lit('"}')).alias("config"), F.lit("labels table").alias("attribution"), _id("document", "doc_id").alias("document_id"),
    )
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    links = t("pages").select(
        _id("link", "page_id").alias("id"), F.concat(F.lit("host/"), (F.col("page_id") % 10).cast("string")).alias("subject"), F.concat(F.lit("https://"), host).alias("target"),
        F.lit("page names the host").alias("reason"), F.col("url").alias("source_url"), F.sha2("html", 256).alias("sha256"),
    )
    return {
        "models": models, "families": families, "organizations": makers.unionByName(hosts), "offerings": offerings, "prices": prices, "documents": documents,
        "observations": observations.unionByName(capable), "capabilities": capabilities, "benchmarks": benchmarks, "evaluations": evaluations, "external_links": links,
    }


def read_silver(spark: SparkSession, directory: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Entity tables from a folder of CSV files: every column text, empty means null."""
    from lodestone.sources.readers import read_csv_text

    out = {}
    for name in names or list(SINGLE):
        df = read_csv_text(spark, f"{directory}/{name}.csv")
        df = df.select(*[blank_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns])
        if name == "observations" and "value_kind" in df.columns:
            df = df.withColumns({
                "literal_value": F.when(F.col("value_kind") == "literal", F.col("value")),
                "resource_value": F.when(F.col("value_kind") == "resource", F.col("value")),
                "predicate": F.concat(F.lit(VOCAB), "predicate"),
                "subject_kind": F.when(F.col("subject_id").contains("/offering/"), "offerings").otherwise("models"),
            })
        out[name] = df
    return out


__all__ = ["DCTERMS", "read_silver", "silver_graph", "star_tables"]
