"""Registered queries over the star-schema tables, and the SQL DuckDB answers them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from lodestone.plans.compiler import query
from lodestone.plans.graph import EntityGraph
from lodestone.plans.silver import silver_graph, star_tables

PREFIXES = """
PREFIX v: <urn:lodestone:vocab#>
PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
PREFIX owl: <http://www.w3.org/2002/07/owl#>
PREFIX prov: <http://www.w3.org/ns/prov#>
PREFIX schema: <https://schema.org/>
"""

Query = Callable[[SparkSession, str], DataFrame]


def star_graph(spark: SparkSession, sf_dir: str) -> EntityGraph:
    return silver_graph(star_tables(spark, sf_dir))


def _graph_query(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(star_graph(spark, sf_dir), PREFIXES + text)
        # exact inside the plan; other engines hand decimals over as doubles
        return df.withColumns({f.name: F.col(f.name).cast("double") for f in df.schema if isinstance(f.dataType, DecimalType)})

    return run


#: The entity tables in SQL, shared by the twins below.
TABLES = """
models AS (SELECT 'model/' || p_partkey AS id, lower(p_type) || '/' || p_partkey AS source_id, p_name AS name, p_type AS description, 'family/' || p_brand AS family_id, p_brand AS family_name, 'maker/' || p_size AS developer_id, 'Maker ' || p_size AS developer, p_partkey, p_size FROM part),
orgs AS (SELECT DISTINCT 'maker/' || p_size AS id, 'Maker ' || p_size AS name, 'urn:lodestone:vocab#Organization' AS cls FROM part UNION ALL SELECT 'host/' || s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN 'https://schema.org/Service' ELSE 'urn:lodestone:vocab#Organization' END FROM supplier),
offers AS (SELECT DISTINCT 'offering/' || l_partkey || '-' || l_suppkey AS id, 'model/' || l_partkey AS model_id, 'host/' || l_suppkey AS provider_id, CASE l_partkey % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'catalog' ELSE 'endpoint' END AS kind, CASE WHEN l_suppkey % 5 = 0 THEN 'batch' ELSE 'standard' END AS mode, (l_partkey % 200) * 1000 AS context_length, CASE WHEN l_partkey % 2 = 0 THEN 'tag-' || l_suppkey END AS endpoint_tag FROM lineitem),
priced AS (SELECT 'offering/' || l_partkey || '-' || l_suppkey AS offering_id, CASE l_returnflag WHEN 'N' THEN 'prompt' WHEN 'A' THEN 'completion' WHEN 'R' THEN 'input_cache_read' END AS category, (l_extendedprice::DECIMAL(15,2) * (1 - l_discount::DECIMAL(15,2)))::DECIMAL(18,4) AS amount, CASE WHEN l_discount::DECIMAL(15,2) > 0 THEN 'discount ' || l_discount::DECIMAL(15,2) END AS conditions, CASE l_linestatus WHEN 'O' THEN 'base' ELSE 'override' END AS tier, 'document/' || l_orderkey AS document_id, l_shipdate AS observed_at FROM lineitem),
docs AS (SELECT 'document/' || o_orderkey AS id, 'https://source.example/' || o_orderkey AS url, CASE o_orderstatus WHEN 'O' THEN 'official' WHEN 'F' THEN 'model_card' WHEN 'P' THEN 'catalog' END AS kind FROM orders),
facts AS (SELECT 'observation/' || event_id AS id, 'model/' || user_id AS subject_id, 'urn:lodestone:vocab#' || CASE event_type WHEN 'click' THEN 'contextLength' WHEN 'view' THEN 'maxOutputTokens' WHEN 'purchase' THEN 'knowledgeCutoff' WHEN 'signup' THEN 'license' WHEN 'error' THEN 'hasRepository' END AS predicate, CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS literal_value, CASE WHEN event_type = 'error' THEN 'https://hub.example/' || json_extract_string(props, '$.k') END AS resource_value, 'document/' || event_id AS document_id, ts AS observed_at FROM events),
capable AS (SELECT 'model/' || p_partkey AS s, CASE WHEN p_size % 2 = 0 THEN 'tools' ELSE 'json' END AS label FROM part WHERE p_size <= 25),
evals AS (SELECT 'evaluation/' || doc_id || '-' || metric AS id, 'model/' || doc_id AS model_id, metric, score, 'label' AS unit, '{"metric": "' || metric || '"}' AS config, 'labels table' AS attribution, 'document/' || doc_id AS document_id FROM (SELECT doc_id, 'quality' AS metric, quality AS score FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) WHERE score IS NOT NULL),
links AS (SELECT 'link/' || page_id AS id, 'host/' || (page_id % 10) AS subject, 'https://' || regexp_extract(url, '^https?://([^/?#]+)', 1) AS target, 'page names the host' AS reason, url AS source_url, sha256(html) AS sha256 FROM pages)
"""

GRAPH: dict[str, tuple[str, str]] = {}  # name -> query text, SQL after the tables

GRAPH["coverage"] = (
    """SELECT ?developer (COUNT(DISTINCT ?m) AS ?models) WHERE { ?m a v:AIModel ; v:developedBy ?d . ?d rdfs:label ?developer } GROUP BY ?developer ORDER BY DESC(?models) ?developer""",
    "SELECT o.name AS developer, count(DISTINCT m.id) AS models FROM models m JOIN orgs o ON m.developer_id = o.id GROUP BY 1",
)
GRAPH["family_members"] = (
    """SELECT ?model ?name ?modelId WHERE { ?f rdfs:label "Brand#2" . ?model v:belongsToFamily ?f ; a v:AIModel ; v:sourceId ?modelId ; rdfs:label ?name } ORDER BY ?name ?modelId""",
    "SELECT id AS model, name, source_id AS modelId FROM models WHERE family_name = 'Brand#2'",
)
GRAPH["label_semi_join"] = (
    """SELECT DISTINCT ?modelId ?name WHERE { ?c rdfs:label "tools" . ?m v:supportsCapability ?c ; v:sourceId ?modelId ; rdfs:label ?name ; a v:AIModel } ORDER BY ?modelId""",
    "SELECT DISTINCT source_id AS modelId, name FROM models JOIN capable ON s = id WHERE label = 'tools'",
)
GRAPH["evaluation_star"] = (
    """SELECT ?modelId ?benchmark ?score ?unit ?config ?attribution ?source WHERE {
      ?doc schema:url ?source . ?b rdfs:label ?benchmark . ?m v:sourceId ?modelId .
      ?e v:evaluatedModel ?m ; v:onBenchmark ?b ; v:score ?score ; v:scoreUnit ?unit ; v:evaluationConfig ?config ; v:attribution ?attribution ; prov:wasDerivedFrom ?doc ; a v:Evaluation
    } ORDER BY ?benchmark DESC(?score) ?modelId""",
    "SELECT source_id AS modelId, metric AS benchmark, score, unit, config, attribution, url AS source FROM evals e JOIN models m ON m.id = e.model_id JOIN docs d ON d.id = e.document_id",
)
GRAPH["cheap_topk"] = (
    """SELECT ?modelId ?provider ?mode ?inputPrice ?context ?conditions WHERE {
      ?c rdfs:label "tools" . ?m v:supportsCapability ?c ; v:sourceId ?modelId .
      ?o v:offersModel ?m ; v:contextLength ?context ; v:serviceMode ?mode ; v:hostedBy ?h ; v:hasPrice ?p . ?h rdfs:label ?provider .
      ?p v:priceTier "base" ; v:priceUnit "million_tokens" ; v:currency "USD" ; v:priceCategory "prompt" ; v:priceAmount ?inputPrice .
      OPTIONAL { ?p v:conditions ?conditions }
      FILTER(?context >= 100000 && ?mode = "standard" && ?inputPrice < 20000)
    } ORDER BY ?inputPrice ?modelId ?provider ?conditions LIMIT 50""",
    "SELECT source_id AS modelId, g.name AS provider, mode, amount::DOUBLE AS inputPrice, context_length AS context, conditions FROM offers o JOIN models m ON m.id = o.model_id JOIN orgs g ON g.id = o.provider_id JOIN priced p ON p.offering_id = o.id JOIN capable c ON c.s = m.id WHERE c.label = 'tools' AND tier = 'base' AND category = 'prompt' AND context_length >= 100000 AND mode = 'standard' AND amount < 20000 ORDER BY amount, 1, 2, conditions NULLS FIRST LIMIT 50",
)
GRAPH["direct_vs_router"] = (
    """SELECT ?modelId ?category ?kind ?provider ?usd ?conditions ?source WHERE {
      ?m v:sourceId ?modelId . ?h rdfs:label ?provider . ?d schema:url ?source .
      ?o v:offersModel ?m ; v:hostedBy ?h ; v:offeringKind ?kind ; v:serviceMode ?mode ; v:hasPrice ?p .
      ?p v:priceCategory ?category ; v:priceAmount ?usd ; v:priceTier "base" ; v:priceUnit ?unit ; prov:wasDerivedFrom ?d .
      OPTIONAL { ?p v:conditions ?conditions }
      FILTER(?kind IN ("direct", "catalog")) FILTER(?unit = "million_tokens" && ?mode = "standard")
    } ORDER BY ?modelId ?category ?kind""",
    "SELECT source_id AS modelId, category, o.kind, g.name AS provider, amount::DOUBLE AS usd, conditions, url AS source FROM offers o JOIN models m ON m.id = o.model_id JOIN orgs g ON g.id = o.provider_id JOIN priced p ON p.offering_id = o.id JOIN docs d ON d.id = p.document_id WHERE o.kind IN ('direct', 'catalog') AND mode = 'standard' AND tier = 'base'",
)
GRAPH["contains_lower_prices"] = (
    """SELECT ?modelId ?provider ?endpointTag ?kind ?mode ?category ?usd ?conditions ?source ?observedAt WHERE {
      ?m a v:AIModel ; v:sourceId ?modelId . FILTER(CONTAINS(LCASE(?modelId), "promo"))
      ?o v:offersModel ?m ; v:hasPrice ?p ; v:hostedBy ?h ; v:serviceMode ?mode ; v:offeringKind ?kind . ?h rdfs:label ?provider .
      ?p v:priceCategory ?category ; v:priceAmount ?usd ; v:currency ?currency ; v:priceUnit ?unit ; v:observedAt ?observedAt ; prov:wasDerivedFrom ?d . ?d schema:url ?source .
      OPTIONAL { ?o v:endpointTag ?endpointTag } OPTIONAL { ?p v:conditions ?conditions }
      FILTER(?category IN ("prompt", "completion")) FILTER(?currency = "USD" && ?unit = "million_tokens")
    } ORDER BY ?modelId ?kind ?provider ?mode ?category""",
    "SELECT source_id AS modelId, g.name AS provider, endpoint_tag AS endpointTag, o.kind, mode, category, amount::DOUBLE AS usd, conditions, url AS source, p.observed_at AS observedAt FROM offers o JOIN models m ON m.id = o.model_id JOIN orgs g ON g.id = o.provider_id JOIN priced p ON p.offering_id = o.id JOIN docs d ON d.id = p.document_id WHERE contains(lower(source_id), 'promo') AND category IN ('prompt', 'completion')",
)
GRAPH["conflicting_observations"] = (
    """SELECT ?entity ?property (COUNT(DISTINCT ?x) AS ?n) (GROUP_CONCAT(DISTINCT STR(?x); separator=" | ") AS ?found) (GROUP_CONCAT(DISTINCT STR(?source); separator=" | ") AS ?sources) WHERE {
      ?entity a v:AIModel . ?d schema:url ?source .
      ?obs v:observedProperty ?property ; v:aboutEntity ?entity ; v:literalValue ?x ; prov:wasDerivedFrom ?d .
      FILTER(?property IN (v:knowledgeCutoff, v:contextLength, v:maxOutputTokens))
    } GROUP BY ?entity ?property HAVING(COUNT(DISTINCT ?x) > 1) ORDER BY ?entity ?property""",
    "SELECT subject_id AS entity, predicate AS property, count(DISTINCT literal_value) AS n, string_agg(DISTINCT literal_value, ' | ' ORDER BY literal_value) AS found, string_agg(DISTINCT url, ' | ' ORDER BY url) AS sources FROM facts f JOIN models m ON m.id = f.subject_id JOIN docs d ON d.id = f.document_id WHERE predicate IN ('urn:lodestone:vocab#knowledgeCutoff', 'urn:lodestone:vocab#contextLength', 'urn:lodestone:vocab#maxOutputTokens') GROUP BY 1, 2 HAVING count(DISTINCT literal_value) > 1",
)
GRAPH["external_links"] = (
    """SELECT ?subject ?target ?evidence ?source WHERE { ?l v:linkTarget ?target ; v:linkSubject ?subject ; v:description ?evidence ; prov:wasDerivedFrom ?source ; a v:ExternalLink } ORDER BY ?subject ?target""",
    "SELECT subject, target, reason AS evidence, source_url AS source FROM links",
)
GRAPH["linked_providers"] = (
    """SELECT DISTINCT ?provider ?providerType ?identity ?reason ?source ?checkedAt WHERE {
      ?o v:hostedBy ?h . ?h a ?providerType ; owl:sameAs ?identity ; rdfs:label ?provider .
      ?l a v:ExternalLink ; v:linkTarget ?identity ; v:linkSubject ?h ; v:description ?reason ; prov:wasDerivedFrom ?source .
      OPTIONAL { ?l v:sha256 ?checkedAt }
    } ORDER BY ?provider ?identity""",
    "SELECT DISTINCT g.name AS provider, cls AS providerType, target AS identity, reason, source_url AS source, sha256 AS checkedAt FROM links l JOIN orgs g ON g.id = l.subject WHERE EXISTS (FROM offers o WHERE o.provider_id = g.id)",
)
GRAPH["entity_details_path"] = (
    """SELECT ?entity ?property ?value ?source ?observedAt WHERE {
      ?m v:sourceId "economy/0" . ?entity v:offersModel? ?m .
      ?obs v:aboutEntity ?entity ; v:observedProperty ?property ; v:observedAt ?observedAt ; prov:wasDerivedFrom ?d .
      OPTIONAL { ?obs v:literalValue ?a } OPTIONAL { ?obs v:resourceValue ?b } BIND(COALESCE(?a, ?b) AS ?value)
      ?d schema:url ?source
    } ORDER BY ?entity ?property ?source""",
    "SELECT subject_id AS entity, predicate AS property, coalesce(literal_value, resource_value) AS value, url AS source, observed_at AS observedAt FROM facts f JOIN models m ON m.id = f.subject_id JOIN docs d ON d.id = f.document_id WHERE source_id = 'economy/0'",
)
GRAPH["subselect_join"] = (
    """SELECT ?name ?repository ?source ?observedAt WHERE {
      { SELECT ?m ?repository ?d ?observedAt WHERE { ?obs v:aboutEntity ?m ; v:observedProperty v:hasRepository ; v:resourceValue ?repository ; v:observedAt ?observedAt ; prov:wasDerivedFrom ?d } }
      ?m rdfs:label ?name ; v:hasRepository ?repository . ?d v:sourceKind "model_card" ; schema:url ?source
    } ORDER BY ?name""",
    "SELECT m.name, resource_value AS repository, url AS source, observed_at AS observedAt FROM facts f JOIN models m ON m.id = f.subject_id JOIN docs d ON d.id = f.document_id WHERE resource_value IS NOT NULL AND d.kind = 'model_card'",
)
GRAPH["official_facts"] = (
    """SELECT ?modelId ?property ?value ?source WHERE {
      ?m v:sourceId ?modelId . ?d v:sourceKind ?kind ; schema:url ?source .
      ?obs v:aboutEntity ?m ; v:observedProperty ?property ; v:literalValue ?value ; prov:wasDerivedFrom ?d . FILTER(?kind IN ("model_card", "official"))
    } ORDER BY ?modelId ?property""",
    "SELECT source_id AS modelId, predicate AS property, literal_value AS value, url AS source FROM facts f JOIN models m ON m.id = f.subject_id JOIN docs d ON d.id = f.document_id WHERE literal_value IS NOT NULL AND d.kind IN ('official', 'model_card')",
)
GRAPH["values_predicates"] = (
    """SELECT ?modelId ?property ?value ?source WHERE {
      ?m v:sourceId ?modelId . ?obs v:aboutEntity ?m ; v:observedProperty ?property ; v:literalValue ?value ; prov:wasDerivedFrom ?d .
      VALUES ?property { v:license v:knowledgeCutoff } ?d schema:url ?source
    } ORDER BY ?modelId ?property""",
    "SELECT source_id AS modelId, predicate AS property, literal_value AS value, url AS source FROM facts f JOIN models m ON m.id = f.subject_id JOIN docs d ON d.id = f.document_id WHERE predicate IN ('urn:lodestone:vocab#license', 'urn:lodestone:vocab#knowledgeCutoff')",
)
GRAPH["prefix_identities"] = (
    """SELECT ?name ?identity ?reason ?source ?sum WHERE {
      ?org a v:Organization ; owl:sameAs ?identity ; rdfs:label ?name . FILTER(STRSTARTS(STR(?identity), "https://blog."))
      ?l a v:ExternalLink ; v:linkSubject ?org ; v:linkTarget ?identity ; v:description ?reason ; prov:wasDerivedFrom ?source . OPTIONAL { ?l v:sha256 ?sum }
    } ORDER BY ?name""",
    "SELECT g.name, target AS identity, reason, source_url AS source, sha256 AS sum FROM links l JOIN orgs g ON g.id = l.subject WHERE cls LIKE '%Organization' AND starts_with(target, 'https://blog.')",
)
GRAPH["not_exists"] = (
    """SELECT ?modelId WHERE { ?m a v:AIModel ; v:sourceId ?modelId . FILTER NOT EXISTS { ?o v:offersModel ?m ; v:serviceMode "batch" } }""",
    "SELECT source_id AS modelId FROM models m WHERE NOT EXISTS (FROM offers o WHERE o.model_id = m.id AND mode = 'batch')",
)
GRAPH["everything_about"] = (
    """SELECT DISTINCT ?section ?entity ?property ?value WHERE {
      ?m a v:AIModel ; v:sourceId "economy/0" .
      { BIND("1_model" AS ?section) BIND(?m AS ?entity) ?m ?property ?raw }
      UNION { BIND("2_offering" AS ?section) ?o v:offersModel ?m ; ?property ?raw . BIND(?o AS ?entity) }
      UNION { BIND("4_fact" AS ?section) { BIND(?m AS ?entity) } UNION { ?entity v:offersModel ?m }
        ?f a v:FactObservation ; v:aboutEntity ?entity ; v:observedProperty ?property . OPTIONAL { ?f v:literalValue ?a } OPTIONAL { ?f v:resourceValue ?b } BIND(COALESCE(?a, ?b) AS ?raw) }
      OPTIONAL { ?raw rdfs:label ?label } BIND(COALESCE(STR(?label), STR(?raw)) AS ?value)
    } ORDER BY ?section ?entity ?property ?value""",
    "",
)
PREDICATES = "urn:lodestone:vocab#"


def queries() -> dict[str, Query]:
    return {name: _graph_query(text) for name, (text, _) in GRAPH.items()}


def oracle_sql() -> dict[str, str]:
    return {name: f"WITH {TABLES.strip()} {sql}" for name, (_, sql) in GRAPH.items() if sql}
