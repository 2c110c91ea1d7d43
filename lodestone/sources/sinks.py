"""Writers: CSV tables, content-addressed blobs, snapshots with a pointer, RDF, JSON reports."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.graph import DCTERMS, SCHEMA, VOCAB

DCAT = "http://www.w3.org/ns/dcat#"


def write_csv_table(df: DataFrame, path: str) -> None:
    """CSV with sorted columns and a header; missing values are empty."""
    df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in sorted(df.columns)]).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def csv_text(df: DataFrame) -> str:
    """Rows as CSV text: unbound is empty, truth is true or false. For answers a person reads:
    rows stream through the driver one by one."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    for row in df.toLocalIterator():
        writer.writerow(["" if x is None else str(x).lower() if isinstance(x, bool) else x for x in row])
    return out.getvalue()


def write_blobs(docs: DataFrame, path: str) -> DataFrame:
    """(url, kind, content, ...) stored under the content's digest; returns the manifest.
    Equal contents are stored once."""
    named = docs.withColumn("sha256", F.sha2("content", 256)).withColumn("file", F.concat("kind", F.lit("-"), "sha256"))
    named.select("file", "sha256", "content").dropDuplicates(["file"]).write.mode("append").parquet(path)
    return named.drop("content")


def write_snapshot(df: DataFrame, root: str, name: str, digest: str) -> str:
    """Writes a snapshot under its digest, which never changes again, and only then the
    pointer to it."""
    spark = df.sparkSession
    place = f"{root}/{name}/snapshot={digest}"
    df.write.mode("ignore").parquet(place)
    spark.createDataFrame([(name, digest, place)], "name string, digest string, path string").coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}/pointer")
    return place


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(spark.read.parquet(f"{root}/{name}/pointer").first()["path"])


def _escaped(x: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """Triples (s, p, o, o_kind, optionally o_dtype) as lines of N-Triples."""
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    dtype = F.col("o_dtype") if "o_dtype" in triples.columns else F.lit(None).cast("string")
    plain = dtype.isNull() | dtype.endswith("#string")
    literal = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), F.when(plain, "").otherwise(F.concat(F.lit("^^<"), dtype, F.lit(">"))))
    return triples.select(F.concat(node("s"), F.lit(" <"), "p", F.lit("> "), F.when(F.col("o_kind") == "literal", literal).otherwise(node("o")), F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str, mode: str = "overwrite") -> None:
    ntriples_lines(triples).write.mode(mode).text(path)


def append_graph(triples: DataFrame, path: str) -> None:
    """Adds triples to a stored graph and removes none; readers drop repeats."""
    write_ntriples(triples, path, "append")


def turtle_lines(triples: DataFrame) -> DataFrame:
    """One Turtle statement a subject, its predicates in order."""
    line = ntriples_lines(triples).select(F.split("value", " ", 3).alias("x")).select(F.col("x")[0].alias("s"), F.concat(F.col("x")[1], F.lit(" "), F.regexp_replace(F.col("x")[2], r" \.$", "")).alias("po"))
    return line.groupBy("s").agg(F.array_sort(F.collect_set("po")).alias("po")).select(F.concat("s", F.lit(" "), F.array_join("po", " ;\n    "), F.lit(" .")).alias("value"))


def rdf_xml_lines(triples: DataFrame) -> DataFrame:
    """One rdf:Description element a triple; the predicate's namespace is declared on it."""
    text = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    space, local = F.regexp_extract("p", r"^(.*[#/])([^#/]+)$", 1), F.regexp_extract("p", r"^(.*[#/])([^#/]+)$", 2)
    head = F.concat(F.lit('<rdf:Description rdf:about="'), text("s"), F.lit('"><n:'), local, F.lit(' xmlns:n="'), space, F.lit('"'))
    body = F.when(F.col("o_kind") == "literal", F.concat(F.lit(">"), text("o"), F.lit("</n:"), local, F.lit(">"))).otherwise(F.concat(F.lit(' rdf:resource="'), text("o"), F.lit('"/>')))
    return triples.select(F.concat(head, body, F.lit("</rdf:Description>")).alias("value"))


def json_report(df: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def dataset_metadata(documents: DataFrame, title: str, iri: str = "urn:lodestone:dataset") -> DataFrame:
    """Description of the dataset as triples, with a source for every distinct document URL."""
    spark = documents.sparkSession
    fixed = [(iri, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", DCAT + "Dataset", "iri"), (iri, DCTERMS + "title", title, "literal"), (iri, DCAT + "theme", VOCAB + "AIModel", "iri"), (iri, SCHEMA + "isAccessibleForFree", "true", "literal")]
    sources = documents.where(F.col("url").isNotNull()).select("url").distinct().select(F.lit(iri).alias("s"), F.lit(DCTERMS + "source").alias("p"), F.col("url").alias("o"), F.lit("iri").alias("o_kind"))
    return spark.createDataFrame(fixed, "s string, p string, o string, o_kind string").unionByName(sources)
