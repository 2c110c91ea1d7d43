"""Registered queries of single operators over the star-schema tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.scalars import collapse_space, decimal_text, last_segment, percent_encode
from lodestone.operators import export, html, linking, normalize, reason, shapes
from lodestone.plans.compiler import query
from lodestone.plans.graph import RDFS, VOCAB
from lodestone.plans.silver import DOCUMENT_KIND, silver_graph, star_tables
from lodestone.queries import TABLES
from lodestone.sources.sinks import ntriples_lines


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def effective_price(spark: SparkSession, d: str) -> DataFrame:
    """Exact effective price by supplier and status."""
    raw, off = F.col("l_extendedprice").cast("decimal(15,2)"), F.col("l_discount").cast("decimal(15,2)")
    return _t(spark, d, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.sum((raw * (1 - off)).cast("decimal(18,4)")).cast("double").alias("total"))


def price_exploder(spark: SparkSession, d: str) -> DataFrame:
    """Rates of generated price lists: conversion, discount, overrides, values that are no rate."""
    part = _t(spark, d, "part")
    pricing = F.to_json(F.struct(
        F.format_string("0.0000%d", "p_size").alias("prompt"), F.lit("").alias("completion"), F.when(F.col("p_size") > 25, "0").otherwise("-1").alias("request"),
        F.when(F.col("p_partkey") % 2 == 0, "0.25").alias("discount"),
        F.when(F.col("p_partkey") % 5 == 0, F.array(F.struct(F.lit("0.004").alias("prompt"), F.lit("1000").alias("min_prompt_tokens")))).alias("overrides"),
    ))
    rows = normalize.explode_prices(part.select(F.col("p_partkey").alias("offering_id"), pricing.alias("pricing")))
    return rows.select("offering_id", "category", "unit", "tier", "min_prompt_tokens", F.col("amount").cast("double").alias("amount"), decimal_text(F.col("amount")).alias("amount_text"))


def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    return normalize.dedupe_last(_t(spark, d, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", F.md5("text").alias("digest"))


def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return normalize.dedupe_first(_t(spark, d, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", F.md5("text").alias("digest"))


def iri_encode(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", percent_encode("url").alias("encoded"), last_segment("url").alias("last_part"))


def sha256_docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


def unpivot_labels(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "labels").select("doc_id", F.expr("stack(2, 'quality', quality, 'toxic', toxic) as (metric, score)")).where(F.col("score").isNotNull())


def page_title(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", html.page_title("html").alias("title"))


def page_visible_text(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", F.md5(html.visible_text("html")).alias("digest"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", F.explode(html.page_links("html")).alias("href"))


def space_collapse(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select("item_id", F.md5(collapse_space("text")).alias("digest"))


def unmatched_documents(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


def pair_set_diff(spark: SparkSession, d: str) -> DataFrame:
    line = _t(spark, d, "lineitem")
    side = lambda s: line.where(F.col("l_linestatus") == s).select("l_partkey", "l_suppkey")
    return linking.pair_difference(side("O"), side("F"))


def link_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Pages as identity candidates: each failed check is a reason."""
    url = F.col("url")
    checks = {"scheme": url.startswith("https://"), "site": F.regexp_extract("url", "^https?://([^/?#]+)", 1).endswith("example.net"), "path": F.contains(url, F.lit("/en/"))}
    out = linking.decided(_t(spark, d, "pages"), checks)
    return out.select("page_id", F.array_join("reasons", ",").alias("reasons"), "accepted")


def dangling_fk(spark: SparkSession, d: str) -> DataFrame:
    return shapes.dangling(_t(spark, d, "orders"), "o_orderkey", _t(spark, d, "lineitem"), "l_orderkey").select("o_orderkey")


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return shapes.duplicate_ids(_t(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


def count_parity(spark: SparkSession, d: str) -> DataFrame:
    tables = {k: v for k, v in star_tables(spark, d).items() if k in ("models", "families", "offerings", "external_links")}
    classes = {"models": VOCAB + "AIModel", "families": VOCAB + "ModelFamily", "offerings": VOCAB + "ModelOffering", "external_links": VOCAB + "ExternalLink"}
    return shapes.count_parity(tables, silver_graph(tables).triples(), classes)


def _document_shape() -> shapes.Shape:
    u = "https://schema.org/url"
    return shapes.Shape(target_classes=[VOCAB + "SourceDocument"], node_kind="iri", properties=[
        shapes.Property(u, min_count=1, max_count=1, node_kind="iri", pattern="^https://source.example/[0-9]*[02468]$"),
        shapes.Property(VOCAB + "sourceKind", min_count=1, values=list(DOCUMENT_KIND.values())[:2]),
        shapes.Property(VOCAB + "sha256", max_count=0),
    ])


def shape_report(spark: SparkSession, d: str) -> DataFrame:
    """Violations of a shape over the source documents, by constraint."""
    tables = star_tables(spark, d)
    checker = shapes.Checker(silver_graph({"documents": tables["documents"]}).triples())
    return shapes.conforms(checker.check(_document_shape()))


def shape_max_count(spark: SparkSession, d: str) -> DataFrame:
    """Models with more than one repository, as violations."""
    tables = star_tables(spark, d)
    checker = shapes.Checker(silver_graph({k: tables[k] for k in ("models", "observations")}).triples())
    shape = shapes.Shape(target_classes=[VOCAB + "AIModel"], properties=[shapes.Property(VOCAB + "hasRepository", max_count=1)])
    return checker.check(shape).select("focus_node", F.col("value").cast("bigint").alias("n"))


def shape_xone(spark: SparkSession, d: str) -> DataFrame:
    """Observations of the graph that have both or neither kind of value: none, and with the
    kinds required to be literal, those of resources."""
    tables = star_tables(spark, d)
    checker = shapes.Checker(silver_graph({"observations": tables["observations"].where(F.col("observed_at").isNotNull())}).triples())
    lit, res = VOCAB + "literalValue", VOCAB + "resourceValue"
    shape = shapes.Shape(target_classes=[VOCAB + "FactObservation"], exactly_one=[
        [shapes.Property(lit, min_count=1, max_count=1, pattern="^[0-4]"), shapes.Property(res, max_count=0)], [shapes.Property(res, min_count=1, max_count=1), shapes.Property(lit, max_count=0)],
    ])
    return checker.check(shape).select("focus_node", "constraint")


def subclass_closure(spark: SparkSession, d: str) -> DataFrame:
    """Supplier, nation, region as a hierarchy of two steps."""
    s = _t(spark, d, "supplier").select(F.concat(F.lit("supplier/"), "s_suppkey").alias("sub"), F.concat(F.lit("nation/"), "s_nationkey").alias("super"))
    n = _t(spark, d, "nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("sub"), F.concat(F.lit("region/"), "n_regionkey").alias("super"))
    return reason.subclass_closure(s.unionByName(n))


def range_inference(spark: SparkSession, d: str) -> DataFrame:
    """Types inferred from a domain and a range over line items, with a subclass above."""
    edges = _t(spark, d, "lineitem").select(F.concat(F.lit("part/"), "l_partkey").alias("s"), F.lit("suppliedBy").alias("p"), F.concat(F.lit("supplier/"), "l_suppkey").alias("o"), F.lit("iri").alias("o_kind"))
    schema = {
        "domain": spark.createDataFrame([("suppliedBy", "Part")], "p string, cls string"), "range": spark.createDataFrame([("suppliedBy", "Supplier")], "p string, cls string"),
        "subclass": spark.createDataFrame([("Supplier", "Agent")], "sub string, super string"),
    }
    return reason.infer_types(edges, schema).select("s", "cls")


def disjoint_violations(spark: SparkSession, d: str) -> DataFrame:
    """Documents labelled both good and toxic, where those classes exclude each other."""
    labels = _t(spark, d, "labels")
    types = labels.where("quality = 1").select(F.col("doc_id").alias("s"), F.lit("Good").alias("cls")).unionByName(labels.where("toxic = 1").select(F.col("doc_id").alias("s"), F.lit("Toxic").alias("cls")))
    return reason.disjoint_violations(types, spark.createDataFrame([("Good", "Toxic")], "a string, b string"))


def nested_catalog(spark: SparkSession, d: str) -> DataFrame:
    t = star_tables(spark, d)
    return export.nested_catalog(t["models"], t["offerings"], t["prices"])


def org_degrees(spark: SparkSession, d: str) -> DataFrame:
    t = star_tables(spark, d)
    return export.organization_degrees(t["organizations"], t["models"], t["offerings"])


def search_facet(spark: SparkSession, d: str) -> DataFrame:
    return export.search(star_tables(spark, d)["models"], "RING", "maker/7").select("id", "name", "source_id")


def stats(spark: SparkSession, d: str) -> DataFrame:
    return export.statistics(star_tables(spark, d))


def latest_fact(spark: SparkSession, d: str) -> DataFrame:
    facts = star_tables(spark, d)["observations"].where(F.col("observed_at").isNotNull())
    return normalize.latest_per_fact(facts).select("subject_id", "predicate", "id")


def triple_counts(spark: SparkSession, d: str) -> DataFrame:
    """Triples of the graph by predicate, the type triples among them."""
    return silver_graph({k: v for k, v in star_tables(spark, d).items() if k in ("models", "documents", "evaluations")}).triples().groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def ntriples_export(spark: SparkSession, d: str) -> DataFrame:
    """N-Triples lines of the external links' targets."""
    links = silver_graph({"external_links": star_tables(spark, d)["external_links"]}).triples().where(F.col("p") == VOCAB + "linkTarget")
    return ntriples_lines(links).withColumnRenamed("value", "line")


def grouping_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


def grouping_cube(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"))


def conditional_sums(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums under conditions, by status, in one pass."""
    late, quantity = F.col("l_linestatus") == "F", F.col("l_quantity").cast("bigint")
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(late).alias("n_final"), F.sum(F.when(late, quantity).otherwise(0)).alias("final_quantity"), F.count_if(F.col("l_discount") > 0).alias("n_discounted"))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' and customers' nations: intersection and differences."""
    a, b = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")), _t(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    tagged = {"both": a.intersect(b), "suppliers": a.exceptAll(b).distinct(), "customers": b.subtract(a)}
    out = [df.withColumn("side", F.lit(k)) for k, df in tagged.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def limited_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """The rows a limited enrichment takes first: flagged ones, then the largest, then by id."""
    docs = _t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return docs.orderBy((F.col("lang") == "de").desc_nulls_last(), F.col("n_chars").desc_nulls_last(), "doc_id").limit(100)


_REVERSED = f"""SELECT ?o ?kind WHERE {{ ?m ^<{VOCAB}offersModel> ?o . ?m <{VOCAB}sourceId> ?sid . OPTIONAL {{ ?o <{VOCAB}serviceMode> ?mode . BIND(?mode AS ?kind) }}
  MINUS {{ ?o <{VOCAB}serviceMode> "batch" }} FILTER(CONTAINS(?sid, "/7")) }}"""


def inverse_path_minus(spark: SparkSession, d: str) -> DataFrame:
    """An inverse path, a BIND inside OPTIONAL, and MINUS, by the query language."""
    return query(silver_graph({k: v for k, v in star_tables(spark, d).items() if k in ("models", "offerings")}), _REVERSED)


_EITHER = f"""PREFIX rdfs: <{RDFS}> SELECT ?x ?label WHERE {{ {{ ?x a <{VOCAB}AIModel> ; rdfs:label ?label }} UNION {{ ?x a <{VOCAB}ModelFamily> ; rdfs:label ?label }} FILTER(CONTAINS(LCASE(?label), "1")) }}"""


def either_kind(spark: SparkSession, d: str) -> DataFrame:
    """UNION of two kinds of subject."""
    return query(silver_graph({k: v for k, v in star_tables(spark, d).items() if k in ("models", "families")}), _EITHER)


def html_tables(spark: SparkSession, d: str) -> DataFrame:
    """Cells of tables built from the nations, through the table function."""
    row = F.concat(F.lit("<tr><td> "), "n_name", F.lit("</td><td>$"), F.col("n_nationkey").cast("string"), F.lit(".5</td></tr>"))
    page = _t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))
    pages = page.select("n_regionkey", F.concat(F.lit("<table><tr><th>Name</th><th>Price</th></tr>"), "rows", F.lit("</table>")).alias("html"))
    rows = html.html_tables(pages, "n_regionkey", "html")
    return html.price_facts(rows, "n_regionkey", ["Name", "Price"], "Name", {"Price": "prompt"})


QUERIES = {f.__name__: f for f in (
    effective_price, price_exploder, dedupe_last, dedupe_first, iri_encode, sha256_docs, json_props, unpivot_labels, page_title, page_visible_text, page_links, space_collapse,
    unmatched_documents, pair_set_diff, link_reasons, dangling_fk, duplicate_ids, count_parity, shape_report, shape_max_count, shape_xone, subclass_closure, range_inference,
    disjoint_violations, nested_catalog, org_degrees, search_facet, stats, latest_fact, triple_counts, ntriples_export, grouping_rollup, html_tables, grouping_cube, conditional_sums, set_operations, limited_enrichment, inverse_path_minus, either_kind,
)}

_W = f"WITH {TABLES.strip()} "
V = VOCAB
ORACLES = {
    "effective_price": "SELECT l_suppkey, l_linestatus, sum((l_extendedprice::DECIMAL(15,2) * (1 - l_discount::DECIMAL(15,2)))::DECIMAL(18,4))::DOUBLE AS total FROM lineitem GROUP BY ALL",
    "dedupe_last": "SELECT conv_id, max(turn) AS turn, md5(arg_max(text, turn)) AS digest FROM conversations GROUP BY conv_id",
    "dedupe_first": "SELECT conv_id, min(turn) AS turn, md5(arg_min(text, turn)) AS digest FROM conversations GROUP BY conv_id",
    "iri_encode": "SELECT page_id, url_encode(url) AS encoded, regexp_extract(url, '[^/#]*$') AS last_part FROM pages",
    "sha256_docs": "SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY 1",
    "json_props": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events",
    "unpivot_labels": "SELECT doc_id, 'quality' AS metric, quality AS score FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic', toxic FROM labels WHERE toxic IS NOT NULL",
    "page_title": "SELECT page_id, regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'si') AS title FROM pages",
    "page_visible_text": r"SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'gsi'), '<[^>]*>', ' ', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&apos;', chr(39)), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&'), '\s+', ' ', 'g'))) AS digest FROM pages",
    "page_links": """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""",
    "space_collapse": r"SELECT item_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM benchmark",
    "unmatched_documents": "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)",
    "pair_set_diff": "WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O'), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F') SELECT *, 'left' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'right' FROM (FROM b EXCEPT FROM a)",
    "link_reasons": "SELECT page_id, concat_ws(',', CASE WHEN NOT starts_with(url, 'https://') THEN 'scheme' END, CASE WHEN NOT ends_with(regexp_extract(url, '^https?://([^/?#]+)', 1), 'example.net') THEN 'site' END, CASE WHEN NOT contains(url, '/en/') THEN 'path' END) AS reasons, starts_with(url, 'https://') AND ends_with(regexp_extract(url, '^https?://([^/?#]+)', 1), 'example.net') AND contains(url, '/en/') AS accepted FROM pages",
    "dangling_fk": "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey",
    "duplicate_ids": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "count_parity": _W + "SELECT 'models' AS name, count(*) AS rows, count(*) AS subjects FROM models UNION ALL SELECT 'families', count(DISTINCT family_id), count(DISTINCT family_id) FROM models UNION ALL SELECT 'offerings', count(*), count(*) FROM offers UNION ALL SELECT 'external_links', count(*), count(*) FROM links",
    "shape_report": _W + "SELECT 'pattern' AS \"constraint\", 'https://schema.org/url' AS path, count(*) AS n FROM docs WHERE NOT regexp_matches(url, '[02468]$') UNION ALL SELECT 'in', 'urn:lodestone:vocab#sourceKind', count(*) FROM docs WHERE kind NOT IN ('official', 'model_card') UNION ALL SELECT 'maxCount', 'urn:lodestone:vocab#sha256', count(*) FROM docs",
    "shape_max_count": _W + "SELECT subject_id AS focus_node, count(DISTINCT resource_value) AS n FROM facts JOIN models m ON m.id = subject_id WHERE resource_value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT resource_value) > 1",
    "shape_xone": _W + "SELECT id AS focus_node, 'xone' AS \"constraint\" FROM facts WHERE literal_value IS NOT NULL AND NOT regexp_matches(literal_value, '^[0-4]')",
    "subclass_closure": "WITH RECURSIVE e AS (SELECT 'supplier/' || s_suppkey AS sub, 'nation/' || s_nationkey AS super FROM supplier UNION SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation), r AS (SELECT * FROM e UNION SELECT r.sub, e.super FROM r JOIN e ON r.super = e.sub) SELECT * FROM r",
    "range_inference": "SELECT DISTINCT 'part/' || l_partkey AS s, 'Part' AS cls FROM lineitem UNION ALL SELECT DISTINCT 'supplier/' || l_suppkey, unnest(['Supplier', 'Agent']) FROM lineitem",
    "disjoint_violations": "SELECT doc_id AS s, 'Good' AS a, 'Toxic' AS b FROM labels WHERE quality = 1 AND toxic = 1",
    "org_degrees": _W + "SELECT id, name, (SELECT count(*) FROM models WHERE developer_id = o.id) AS models, (SELECT count(*) FROM offers WHERE provider_id = o.id) AS offerings FROM orgs o",
    "search_facet": _W + "SELECT id, name, source_id FROM models WHERE developer_id = 'maker/7' AND contains(lower(name || ' ' || source_id || ' ' || family_name || ' ' || developer_id), 'ring') ORDER BY lower(name), source_id LIMIT 150",
    "stats": _W + "SELECT 'models' AS name, count(*) AS rows FROM models UNION ALL SELECT 'families', count(DISTINCT family_id) FROM models UNION ALL SELECT 'organizations', count(*) FROM orgs UNION ALL SELECT 'offerings', count(*) FROM offers UNION ALL SELECT 'prices', count(*) FROM priced UNION ALL SELECT 'documents', count(*) FROM docs UNION ALL SELECT 'observations', (SELECT count(*) FROM facts) + (SELECT count(*) FROM capable) UNION ALL SELECT 'capabilities', 2 UNION ALL SELECT 'benchmarks', 2 UNION ALL SELECT 'evaluations', count(*) FROM evals UNION ALL SELECT 'external_links', count(*) FROM links",
    "triple_counts": _W + "SELECT p, n FROM (SELECT unnest([{'p': 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'n': (SELECT count(*) FROM models) + (SELECT count(*) FROM docs) + (SELECT count(*) FROM evals)}, {'p': 'http://www.w3.org/2000/01/rdf-schema#label', 'n': (SELECT count(*) FROM models)}, {'p': 'https://schema.org/url', 'n': (SELECT count(*) FROM docs)}, {'p': 'http://www.w3.org/ns/prov#wasDerivedFrom', 'n': (SELECT count(*) FROM evals)}], recursive := true)) UNION ALL SELECT 'urn:lodestone:vocab#' || unnest(['sourceId', 'description', 'belongsToFamily', 'developedBy']), (SELECT count(*) FROM models) UNION ALL SELECT 'urn:lodestone:vocab#' || unnest(['sourceKind', 'sha256', 'observedAt']), (SELECT count(*) FROM docs) UNION ALL SELECT 'urn:lodestone:vocab#' || unnest(['evaluatedModel', 'onBenchmark', 'score', 'scoreUnit', 'evaluationConfig', 'attribution']), (SELECT count(*) FROM evals)",
    "latest_fact": _W + "SELECT subject_id, predicate, id FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY observed_at DESC, id) AS n FROM facts) WHERE n = 1",
    "ntriples_export": _W + f"SELECT '<' || id || '> <{V}linkTarget> <' || target || '> .' AS line FROM links",
    "grouping_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "grouping_cube": "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "conditional_sums": "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS n_final, coalesce(sum(l_quantity::BIGINT) FILTER (l_linestatus = 'F'), 0)::BIGINT AS final_quantity, count(*) FILTER (l_discount > 0) AS n_discounted FROM lineitem GROUP BY l_returnflag",
    "set_operations": "WITH a AS (SELECT DISTINCT s_nationkey AS nation FROM supplier), b AS (SELECT DISTINCT c_nationkey AS nation FROM customer), ea AS (SELECT DISTINCT nation FROM (SELECT s_nationkey AS nation FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer)) SELECT nation, 'both' AS side FROM a WHERE nation IN (FROM b) UNION ALL SELECT nation, 'suppliers' FROM ea UNION ALL SELECT nation, 'customers' FROM b WHERE nation NOT IN (FROM a)",
    "limited_enrichment": "SELECT doc_id, lang, n_chars FROM documents ORDER BY (lang = 'de') DESC NULLS LAST, n_chars DESC NULLS LAST, doc_id LIMIT 100",
    "inverse_path_minus": _W + "SELECT o.id AS o, mode AS kind FROM offers o JOIN models m ON m.id = o.model_id WHERE contains(source_id, '/7') AND mode <> 'batch'",
    "either_kind": _W + "SELECT id AS x, name AS label FROM models WHERE contains(lower(name), '1') UNION ALL SELECT DISTINCT family_id, family_name FROM models WHERE contains(lower(family_name), '1')",
    "html_tables": "SELECT n_regionkey, n_name AS name, 'prompt' AS category, n_nationkey || '.5' AS raw_amount FROM nation",
    "price_exploder": """WITH p AS (SELECT p_partkey AS offering_id, ('0.0000' || p_size)::DECIMAL(24,18) AS rate, p_size, CASE WHEN p_partkey % 2 = 0 THEN 0.25 ELSE 0 END AS off, p_partkey % 5 = 0 AS has FROM part),
        r AS (SELECT offering_id, 'prompt' AS category, 'million_tokens' AS unit, 'base' AS tier, NULL::BIGINT AS min_prompt_tokens, (rate * 1000000)::DECIMAL(28,14) * (1 - off) AS amount FROM p
        UNION ALL SELECT offering_id, 'request', 'request', 'base', NULL, 0 FROM p WHERE p_size > 25
        UNION ALL SELECT offering_id, 'prompt', 'million_tokens', 'override', 1000, 4000 * (1 - off) FROM p WHERE has)
        SELECT offering_id, category, unit, tier, min_prompt_tokens, amount::DOUBLE AS amount, regexp_replace(regexp_replace(amount::VARCHAR, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS amount_text FROM r""",
}

