"""Behaviours of the catalog engine on tiny tables."""

import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.operators import export, html, linking, normalize, reason, shapes
from lodestone.plans.compiler import query
from lodestone.plans.graph import TripleGraph, VOCAB
from lodestone.plans.silver import silver_graph
from lodestone.plans.sparql import QuerySyntaxError, parse
from lodestone.sources import readers, sinks

X = "http://x/"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def prices(spark, pricing, **kw):
    df = spark.createDataFrame([("o", json.dumps(pricing))], "offering_id string, pricing string")
    out = normalize.explode_prices(df, **kw).withColumn("text", scalars.decimal_text("amount"))
    return sorted((r["category"], r["text"], r["unit"], r["tier"]) for r in out.collect())


@pytest.mark.parametrize(("pricing", "want"), [
    ({"prompt": "0", "completion": None}, [("prompt", "0", "million_tokens", "base")]),
    ({"prompt": "0.000000123456789", "request": "0.01"}, [("prompt", "0.123456789", "million_tokens", "base"), ("request", "0.01", "request", "base")]),
    ({"prompt": "x", "completion": "-1", "image": "NaN", "web_search": ""}, []),
    ({"prompt": "0.000005", "discount": 0.2}, [("prompt", "4", "million_tokens", "base")]),
    ({"prompt": "0.000005", "discount": 1}, [("prompt", "0", "million_tokens", "base")]),
    ({"prompt": "0.000005", "discount": None}, [("prompt", "5", "million_tokens", "base")]),
    ({"prompt": "0.000005", "discount": -0.2}, [("prompt", "6", "million_tokens", "base")]),
    ({"prompt": "0.000002", "overrides": [{"min_prompt_tokens": 272000, "prompt": "0.000004"}]}, [("prompt", "2", "million_tokens", "base"), ("prompt", "4", "million_tokens", "override")]),
    ({"audio": "3"}, [("audio", "3", "unknown", "base")]),
    ({"prompt": "0.000001", "discount": 0.12345}, [("prompt", "0.87655", "million_tokens", "base")]),
    ({"request": "0.000000000000001234", "image": "1500000"}, [("image", "1500000", "image", "base"), ("request", "0.000000000000001234", "request", "base")]),
    ({"prompt": "1500000"}, [("prompt", "1500000000000", "million_tokens", "base")]),
])
def test_prices(spark, pricing, want):
    assert prices(spark, pricing) == want


def test_discount_over_one_is_an_error(spark):
    with pytest.raises(Exception, match="discount is over 1"):
        prices(spark, {"prompt": "1", "discount": 1.2})


@pytest.mark.parametrize(("pricing", "said"), [({"prompt": "1", "discount": "NaN"}, "finite"), ({"prompt": "1", "discount": "x"}, "finite"), ({"prompt": "12345678901"}, "ten integer digits")])
def test_amounts_are_not_lost(spark, pricing, said):
    with pytest.raises(Exception, match=said):
        prices(spark, pricing)


def test_families_and_endpoints(spark):
    slugs = spark.createDataFrame([("google/code-gemma-2",), ("google/gemini-2",), ("openai/gpt-5",)], "id string")
    assert [r[0] for r in slugs.select(normalize.family_of(F.col("id"))).collect()] == ["Gemma", "Gemini", "GPT"]
    schema = "slug string, name string, tag string, provider_name string, quantization string, context_length long, max_prompt_tokens long, max_completion_tokens long, supported_parameters array<string>"
    rows = [("a/b", "N", "t", "P", "fp8", 10, 5, 5, ["x", "y"]), ("a/b", "N", "t", "P", "fp8", 10, 6, 5, ["x", "y"]), ("a/b", "N", "t", "P", "fp8", 10, 5, 5, ["y", "x"]), ("a/b", None, None, None, None, 1, None, None, None), ("a/b", None, "", None, None, 2, None, None, None)]
    out = normalize.endpoint_offerings(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 4 and {r["provider_name"] for r in out} == {"P", "Unknown provider"}


def test_sites(spark):
    df = spark.createDataFrame([("https://www.co.test/prod/", True), ("https://co.test/prod/x", True), ("https://co.test/product-x", False), ("ftp://co.test/prod", False), ("https://co.test", False), (None, False)], "url string, want boolean")
    rows = df.select("want", scalars.official_site("url", F.lit("https://co.test/prod")).alias("got"), scalars.official_site("url", F.lit("https://CO.test/")).alias("host")).collect()
    assert all(r["want"] == r["got"] for r in rows) and [r["host"] for r in rows] == [True, True, True, False, True, False]


def test_institutions(spark):
    schema = "organization_id string, organization_name string, local_id string, local_name string, openalex_id string, display_name string, ror string, type string, homepage_domains array<string>, wikidata string, entity struct<id string, display_name string, ror string, homepage_url string, type string, ids struct<openalex string, ror string, wikidata string>>"
    entity = ("A1", "Co", "r", "https://www.co.test/x", "company", ("A1", "r", "https://www.wikidata.org/entity/Q1"))
    rows = [("o", "Co", "o", "Co", "A1", "Co", "r", "company", ["co.test"], "Q1", entity), ("p", "Co 2", "o", "Co", "A1", "Co", "r", "company", ["co.test"], "Q2", entity)]
    assert [r["reasons"] for r in linking.verify_institutions(spark.createDataFrame(rows, schema)).collect()] == [[], ["local id", "local name", "wikidata"]]


def test_price_of_a_million_is_not_scaled_again(spark):
    assert prices(spark, {"prompt": "5"}, per_million_already=True) == [("prompt", "5", "million_tokens", "base")]


def test_scalars(spark):
    df = spark.createDataFrame([("a b*~/é", "https://www.Azure.microsoft.com/openai/x")], "k string, u string")
    row = df.select(
        scalars.percent_encode("k").alias("k"), scalars.url_host("u").alias("h"), scalars.same_site("u", F.lit("azure.microsoft.com"), F.lit("/openai")).alias("s"), scalars.same_site("u", F.lit("microsoft.com")).alias("n"),
        scalars.same_site(F.lit("https://azure.microsoft.com.evil.test/"), F.lit("azure.microsoft.com")).alias("spoof"),
        scalars.dollars(F.lit("$3.50 $2")).alias("two"), scalars.dollars(F.lit("$3.50 $2"), True).alias("last"), scalars.dollars(F.lit("Free")).alias("free"),
        scalars.sorted_json(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))).alias("j"), scalars.epoch_text(F.lit("1770219050")).alias("t"), scalars.epoch_text(F.lit("x")).alias("bad"),
    ).first()
    assert (row.k, row.h, row.s, row.n, row.spoof) == ("a%20b%2A~%2F%C3%A9", "www.azure.microsoft.com", True, False, False)
    assert (row.two, row["last"], row.free, row.j, row.bad) == (None, "2", "0", '{"a":2,"b":1}', None)
    assert row.t == datetime.datetime(2026, 2, 4, 15, 30, 50)


def test_catalog_rows(spark):
    rows = [
        (1, "openai/o3-mini", "1770219050", "{}"), (2, "google/gemma-3", "x", "{}"), (3, "~anthropic/claude:batch", None, "{}"), (4, "new/thing", None, "{}"), (5, "new/thing", "7", "{}"),
    ]
    cat = spark.createDataFrame(rows, "seq int, id string, created string, j string").select("seq", "id", "created", F.col("id").alias("name"), F.lit("").alias("description"), F.lit(None).cast("string").alias("hugging_face_id"))
    got = {r["source_id"]: r for r in normalize.catalog_models(cat).collect()}
    assert len(got) == 4
    assert {k: (r["developer_name"], r["family_name"]) for k, r in got.items()} == {"openai/o3-mini": ("OpenAI", "OpenAI o-series"), "google/gemma-3": ("Google", "Gemma"), "~anthropic/claude:batch": ("Anthropic", "Claude"), "new/thing": ("new", "new")}
    assert got["openai/o3-mini"]["catalog_created"] and not got["google/gemma-3"]["catalog_created"] and got["new/thing"]["catalog_created"] and got["new/thing"]["description"] is None
    assert spark.range(1).select(normalize.service_mode(F.lit("a:batch"))).first()[0] == "batch"


def test_scores_and_endpoints(spark):
    cat = spark.createDataFrame([("m", {"arena": {"elo": "0", "x": None}})], "id string, benchmarks map<string,map<string,string>>")
    assert [(r["benchmark"], r["score"]) for r in normalize.catalog_benchmarks(cat).collect()] == [("arena:elo", Decimal(0))]
    ends = [("m", "n", "t", "Azure", ["a", "b"], 1, None), ("m", "n", "t", "Azure", ["b", "a"], 1, None), ("m", "n", "t", "Azure", ["a"], 1, None)]
    df = spark.createDataFrame(ends, "slug string, name string, tag string, provider_name string, supported_parameters array<string>, context_length long, quantization string")
    assert normalize.endpoint_offerings(df).count() == 2


def test_dedupe(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "z"), ("b", 1, "q")], "k string, seq int, v string")
    assert sorted(map(tuple, normalize.dedupe_last(df, ["k"], "seq").collect())) == [("a", 3, None), ("b", 1, "q")]
    assert sorted(map(tuple, normalize.dedupe_first(df, ["k"], "seq").collect())) == [("a", 1, "x"), ("b", 1, "q")]


def test_unpivot_skips_blank(spark):
    df = spark.createDataFrame([("m", "d", "t", "", "5", None)], "id string, doc string, at string, a string, b string, c string")
    out = normalize.unpivot_facts(df, "id", "doc", "at", {"a": "pa", "b": "pb", "c": "pc"})
    assert [(r["predicate"], r["value"]) for r in out.collect()] == [("pb", "5")]


def test_html_tables(spark):
    page = "<p>x</p><table><tr><th>Model</th><th>In</th></tr><tr><td>a\n b</td><td>$1.5</td></tr><tr><td>n<table><tr><td>inner</td></tr></table></td><td>Free</td></tr><tr><td>only</td></tr></table>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<p>")], "id int, html string")
    rows = html.html_tables(pages, "id", "html")
    assert sorted((r["name"], r["raw_amount"]) for r in html.price_facts(rows, "id", ["Model", "In"], "Model", {"In": "prompt"}).collect()) == [("a b", "1.5"), ("n", "0")]
    assert [r["id"] for r in html.missing_schema(pages, rows, "id").orderBy("id").collect()] == [2, 3]
    assert pages.where("id = 1").select(html.token_limits(F.lit("1,050,000 context window 128,000 max output tokens"))).first()[0].asDict() == {"context_length": 1050000, "max_output_tokens": 128000}


def test_linking(spark):
    base = ("l1", "Co", "organization", [("l1", "Co")], "Q1", ["Co Inc"], "organization", ["Q43229"], ["https://co.test"])
    item = ("Q1", ["Co"], ["Co Inc"], [("Q43229", "normal")], [("https://www.co.test/", "normal")])
    other = ("Q1", ["Other"], None, [("Q43229", "deprecated")], [("https://evil.test", "normal")])
    rows = [(*base, item), (*base, other), ("l1", "Renamed", "service", *base[3:], item)]
    schema = "local_id string, local_name string, local_kind string, locals array<struct<id string, name string>>, qid string, names array<string>, entity_kind string, instance_of array<string>, websites array<string>, entity struct<id string, labels array<string>, aliases array<string>, p31 array<struct<value string, rank string>>, p856 array<struct<value string, rank string>>>"
    got = [r["reasons"] for r in linking.verify_items(spark.createDataFrame(rows, schema)).collect()]
    assert got == [[], ["name", "instance", "website"], ["local", "kind"]]
    manifest = spark.createDataFrame([("a", "x"), ("../b", "x"), ("c", "x")], "file string, sha256 string").withColumn("sha256", F.when(F.col("file") == "a", F.sha2(F.lit(b"1"), 256)).otherwise("x"))
    blobs = spark.createDataFrame([("a", b"1"), ("c", b"tampered")], "file string, content binary")
    assert {r["file"]: r["accepted"] for r in linking.replay_evidence(manifest, blobs).collect()} == {"a": True, "../b": False, "c": False}


TURTLE = """@prefix x: <http://x/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
x:m a x:Model ; rdfs:label "Model \\"M\\"" ; x:price 5.0, 7 ; x:by x:co . x:co a x:Org ; rdfs:label "Co"@en . # comment
x:Org rdfs:subClassOf x:Agent . x:Agent rdfs:subClassOf x:Thing . x:by rdfs:domain x:Model ; rdfs:range x:Org . x:host rdfs:range [ owl:unionOf ( x:Org x:Service ) ] .
x:Model owl:disjointWith x:Org . x:co owl:sameAs x:co2 . x:z x:host x:plat .
"""


@pytest.fixture
def graph(spark, tmp_path):
    (tmp_path / "g.ttl").write_text(TURTLE)
    return readers.read_graph(spark, [str(tmp_path / "g.ttl")])


def test_graph_files(spark, graph, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_graph(spark, [str(tmp_path / "none.nt")])
    sinks.write_ntriples(graph, str(tmp_path / "g.nt"))
    sinks.append_graph(graph, str(tmp_path / "g.nt"))  # appended twice, read once
    again = readers.read_graph(spark, [str(tmp_path / "g.nt")])
    assert linking.pair_difference(graph.select("s", "p", "o"), again.select("s", "p", "o")).count() == 0
    assert {r["value"] for r in sinks.turtle_lines(graph).collect()} and sinks.rdf_xml_lines(graph).count() == graph.count()


def test_queries_over_triples(graph):
    g = TripleGraph(graph)
    p = {"x": X, "rdfs": "http://www.w3.org/2000/01/rdf-schema#"}
    one = lambda q: [tuple(r) for r in query(g, q, p).collect()]
    assert one("SELECT ?v { ?m a x:Model ; x:price ?v FILTER(?v < 6) }") == [("5.0",)]
    assert one('SELECT ?l { ?m x:by/rdfs:label ?l ; rdfs:label "Model \\"M\\"" }') == [("Co",)]
    assert sorted(one("SELECT ?e { ?e x:by? x:co }")) == [(X + "co",), (X + "m",)]
    assert one("SELECT ?m ?n { ?m x:by ?o OPTIONAL { ?m x:none ?n } }") == [(X + "m", None)]
    assert one("SELECT (COUNT(*) AS ?n) (SUM(?v) AS ?s) { ?m x:price ?v }") == [(2, Decimal(12))]
    assert one("ASK { ?m a x:Model . FILTER EXISTS { ?m x:by ?o } }") == [(True,)]
    assert one("SELECT ?p { x:m ?p x:co }") == [(X + "by",)]
    assert sorted(one("SELECT DISTINCT ?x { { ?x a x:Model } UNION { ?x a x:Org } }")) == [(X + "co",), (X + "m",)]
    assert sinks.csv_text(query(g, "ASK { ?m a x:Model }", p)) == "answer\ntrue\n"
    for bad in ("SELECT ?x { ?x a y:Z }", "SELECT ?x { ?x }", "SELECT ?x {"):
        with pytest.raises((QuerySyntaxError, IndexError)):
            parse(bad)
    with pytest.raises(ValueError, match="cross join"):
        one("SELECT * { ?a x:by ?b . ?c x:price ?d }")


def test_reasoning(spark, graph):
    closed = reason.owl_closure(graph)
    types = {(r["s"].removeprefix(X), r["o"].removeprefix(X)) for r in closed.where(F.col("p") == TYPE).collect()}
    assert {("co", "Thing"), ("co2", "Agent"), ("m", "Model")} <= types
    assert not {("plat", "Org"), ("plat", "Service")} & types  # a union infers no member
    schema = reason.schema_of(graph)
    mixed = spark.createDataFrame([(X + "m", X + "Model"), (X + "m", X + "Org")], "s string, cls string")
    assert reason.disjoint_violations(mixed, schema["disjoint"]).count() == 1


def test_shapes_find_each_fault(spark, graph):
    shape = shapes.Shape(target_classes=[X + "Model"], node_kind="iri", properties=[
        shapes.Property("http://www.w3.org/2000/01/rdf-schema#label", min_count=1, min_length=1, datatype=shapes.XSD + "string"), shapes.Property(X + "by", min_count=1, max_count=1, cls=X + "Agent", not_class=X + "Model"),
        shapes.Property(X + "price", min_inclusive=0),
    ])
    subclasses = reason.schema_of(graph)["subclass"]
    check = lambda extra: {r["constraint"] for r in shapes.Checker(graph.unionByName(spark.createDataFrame(extra, readers.TRIPLE)), subclasses).check(shape).collect()}
    iri = lambda s, p, o: (s, p, o, "iri", None)
    assert check([iri("n", "q", "r")]) == set()
    assert check([iri(X + "n", TYPE, X + "Model")]) == {"minCount"}
    assert check([iri(X + "m", X + "by", X + "m")]) == {"maxCount", "class", "not"}
    assert check([(X + "m", X + "price", "five", "literal", shapes.XSD + "decimal")]) == {"minInclusive"}
    assert check([(X + "m", "http://www.w3.org/2000/01/rdf-schema#label", "", "literal", shapes.XSD + "integer")]) == {"datatype", "minLength"}


@pytest.mark.parametrize("kind", ["counts", "values", "exactly_one"])
def test_shape_tasks_are_bounded_by_rows(spark, monkeypatch, kind):
    """Rows of one task: of nodes that all break a rule, whose keys shrink to little when shuffled."""
    monkeypatch.setattr(shapes, "TASK_ROWS", 1000, raising=False)
    node = F.concat(F.lit("n/"), "id")
    rows = spark.range(20000).select(node.alias("s"), F.inline(F.expr(f"array(struct('{TYPE}' as p, '{X}C' as o, 'iri' as o_kind), struct('{X}q' as p, 'v' as o, 'literal' as o_kind))")))
    rule = {"counts": shapes.Property(X + "q", max_count=0), "values": shapes.Property(X + "q", pattern="^w")}.get(kind)
    shape = shapes.Shape(target_classes=[X + "C"], properties=[rule]) if rule else shapes.Shape(target_classes=[X + "C"], exactly_one=[[shapes.Property(X + "q", pattern="^w")], [shapes.Property(X + "q", max_count=0)]])
    found = shapes.Checker(rows).check(shape).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in found) == 20000 and max(r["count"] for r in found) < 2000


def test_shapes_count_different_values_of_targets(spark):
    """Values count once though given twice, a target counts once, and other nodes don't."""
    lit = lambda s, p, o: (s, p, o, "literal", None)
    is_a = lambda s: (s, TYPE, X + "C", "iri", None)
    rows = spark.createDataFrame([is_a("a"), is_a("a"), lit("a", "q", "1"), lit("a", "q", "1"), is_a("b"), lit("b", "q", "1"), lit("b", "q", "2"), is_a("c"), lit("d", "q", "1"), lit("d", "q", "2")], readers.TRIPLE)
    shape = shapes.Shape(target_classes=[X + "C"], properties=[shapes.Property("q", min_count=1, max_count=1, pattern="^1", values=["1"])])
    found = sorted((r["focus_node"], r["constraint"], r["value"]) for r in shapes.Checker(rows).check(shape).collect())
    assert found == [("b", "in", "2"), ("b", "maxCount", "2"), ("b", "pattern", "2"), ("c", "minCount", "0")]


def test_nested_catalog_sorts_each_list_once(spark):
    """Lists are sorted with nulls first, equal rows stay, and no aggregate packs partial lists."""
    models = spark.createDataFrame([("m", "M", "s"), ("n", "N", "t")], "id string, name string, source_id string")
    offers = spark.createDataFrame([("o2", "m", "h", "k", None), ("o1", "m", "h", "k", "x"), ("o1", "m", "h", "k", None)], "id string, model_id string, provider_id string, kind string, mode string")
    prices = spark.createDataFrame([("o1", "b", "t", "u", 10, None), ("o1", "b", "t", "u", 9, "c"), ("o1", None, "t", "u", 1, None), ("o1", "b", "t", "u", 9, "c"), (None, "b", "t", "u", 9, "c")], "offering_id string, category string, tier string, unit string, amount int, conditions string")
    out = export.nested_catalog(models, offers, prices)
    got = {r["id"]: json.loads(r["json"])["offerings"] for r in out.collect()}
    assert got["n"] == [] and [(o["id"], o.get("mode"), len(o["prices"])) for o in got["m"]] == [("o1", None, 4), ("o1", "x", 4), ("o2", None, 0)]
    assert [(p.get("category"), p["amount"], p.get("conditions")) for p in got["m"][0]["prices"]] == [(None, "1", None), ("b", "10", None), ("b", "9", "c"), ("b", "9", "c")]
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_paged_source():
    pages = {"http://c.test/m": {"data": [{"id": "a"}], "links": {"next": "http://c.test/m?p=2"}}, "http://c.test/m?p=2": {"data": [{"id": "a"}, {"id": "b"}]}}
    fetch = lambda u: json.dumps(pages[u]).encode()
    assert [r["id"] for _, _, rows in readers.catalog_pages("http://c.test/m", fetch, json.loads) for r in rows] == ["a", "a", "b"]
    for bad in ({"data": []}, {"data": {}}, None, {"data": [{"name": "x"}]}, {"data": [{"id": "a"}], "links": {"next": "http://evil.test/m"}}, {"data": [{"id": "a"}], "links": {"next": "http://c.test/m"}}):
        with pytest.raises(ValueError):
            list(readers.catalog_pages("http://c.test/m", lambda u, b=bad: json.dumps(b).encode(), json.loads))
    assert readers.endpoint_url("http://c.test", "a/b:free") == "http://c.test/a/b%3Afree/endpoints"
    tries = []

    def flaky(url):
        tries.append(url)
        if len(tries) < 3:
            raise OSError
        return b"ok"

    waits = []
    assert readers.with_retry(flaky, pause=waits.append)("u") == b"ok" and waits == [1.0, 2.0]


def test_blobs_and_snapshots(spark, tmp_path):
    docs = spark.createDataFrame([("u", "page", b"1"), ("v", "page", b"1")], "url string, kind string, content binary")
    assert sinks.write_blobs(docs, str(tmp_path / "b")).count() == 2 and spark.read.parquet(str(tmp_path / "b")).count() == 1
    sinks.write_snapshot(docs, str(tmp_path), "s", "abc")
    sinks.write_snapshot(docs.limit(0), str(tmp_path), "s", "abc")  # a digest's content never changes
    assert sinks.read_snapshot(spark, str(tmp_path), "s").count() == 2
    assert sinks.dataset_metadata(docs, "T").count() == 6


def test_silver_round_trip(spark, tmp_path):
    models = spark.createDataFrame([("m", "a/b", "N", ""), ("n", "c", 'q"u,o', "f")], "id string, source_id string, name string, family_id string")
    sinks.write_csv_table(models, str(tmp_path / "models.csv"))
    from lodestone.plans.silver import read_silver

    g = silver_graph(read_silver(spark, str(tmp_path), ["models"]))
    assert [tuple(r) for r in query(g, "PREFIX other: <http://elsewhere/> SELECT ?n ?f { ?m a other:AIModel ; other:sourceId ?i ; <http://www.w3.org/2000/01/rdf-schema#label> ?n OPTIONAL { ?m other:belongsToFamily ?f } } ORDER BY ?n").collect()] == [("N", None), ('q"u,o', "f")]
    assert g.triples().where(F.col("p") == VOCAB + "belongsToFamily").count() == 1


def test_natural_values(spark):
    df = spark.createDataFrame([("5",), ("5.50",), ("x\"y",), ("NaN",)], "v string")
    assert [r[0] for r in df.select(export.natural_value(F.col("v"))).collect()] == ["5", "5.5", '"x\\"y"', '"NaN"']


def test_streaming(spark, tmp_path):
    from lodestone.streaming.ingest import snapshot_stream, upsert_latest

    rows = [(1, datetime.datetime(2026, 1, 1), "a"), (1, datetime.datetime(2026, 1, 1), "a"), (2, datetime.datetime(2026, 1, 1), "b")]
    df = spark.createDataFrame(rows, "id int, at timestamp, v string")
    df.write.parquet(str(tmp_path / "in"))
    stream = snapshot_stream(spark, str(tmp_path / "in"), df.schema, "at", ["id"])
    q = upsert_latest(stream, str(tmp_path / "out"), ["id"], "at", str(tmp_path / "cp"))
    q.awaitTermination(120)
    last = max((tmp_path / "out").glob("version=*"), key=lambda p: int(p.name.split("=")[1]))
    assert spark.read.parquet(str(last)).count() == 2


def test_command_line(spark, tmp_path, capsys):
    from lodestone import ask

    graph, text = tmp_path / "g.nt", tmp_path / "q.rq"
    graph.write_text(f'<{X}a> <{X}p> "v" .\n<{X}a> <http://www.w3.org/2002/07/owl#sameAs> <{X}b> .\n<{X}c> <{X}p> "w" .\n<{X}c> <{X}q> "x" .\n')
    text.write_text(f"SELECT ?s ?v WHERE {{ ?s <{X}p> ?v MINUS {{ ?s <{X}q> ?x }} MINUS {{ ?other <{X}q> ?y }} }} ORDER BY ?s")
    assert ask.main([str(text), "--graph", str(graph)]) == 0
    assert capsys.readouterr().out == f"s,v\n{X}a,v\n"
    assert ask.answer(spark, text.read_text(), [str(graph)], reason=True) == f"s,v\n{X}a,v\n{X}b,v\n"


def test_retry_and_pages():
    class Status(OSError):
        def __init__(self, code):
            self.code = code

    def failing(code, calls):
        def fetch(url):
            calls.append(url)
            raise Status(code)

        return fetch

    for code, times in ((404, 1), (429, 3), (503, 3), (None, 3)):
        calls = []
        with pytest.raises(OSError):
            readers.with_retry(failing(code, calls), pause=lambda s: None)("u")
        assert len(calls) == times
    pages = {"http://h/c": {"data": [{"id": 1}], "links": {"next": "?page=2"}}, "http://h/c?page=2": {"data": [{"id": 2}]}}
    assert [r["id"] for _, _, rows in readers.catalog_pages("http://h/c", lambda u: u.encode(), lambda b: pages[b.decode()]) for r in rows] == [1, 2]


def test_reverse_edges_need_no_join(spark, sf_dir):
    """Prices are found by their offering's column: no identifier of a price is computed."""
    from lodestone.queries import queries

    plan = queries()["cheap_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "sha2(" not in plan and plan.count("l_extendedprice") > 0
