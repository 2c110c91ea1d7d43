"""Readers: JSON documents, all-text CSV, N-Triples, Turtle, HTML, paged catalogs."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from urllib.parse import quote, urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPLE = "s string, p string, o string, o_kind string, o_dtype string"


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """One row a JSON document, by a declared schema, or as VARIANT where none is given."""
    if schema is not None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.try_parse_json("value").alias("doc"))


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column text; quotes are doubled and may hold line ends."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, sha256, bytes, content)."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), "content")


_NT = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[\w-]+)?)\s*\.\s*(?:#.*)?$'


def _unescaped(x):
    for a, b in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"'), ("\\\\", "\\")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples, a line a triple, split like any text: s, p, o, o_kind, o_dtype, each triple
    once. Lines that are no triple, comments and blanks are left out."""
    line = F.col("value")
    parts = spark.read.text(path).where(line.rlike(_NT)).select(*[F.regexp_extract(line, _NT, i).alias(c) for i, c in ((1, "s"), (2, "p"), (3, "o"))])
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "^<", ""), ">$", "")
    literal = F.col("o").startswith('"')
    body = _unescaped(F.regexp_extract("o", r'(?s)^"((?:[^"\\]|\\.)*)"', 1))
    dtype = F.regexp_extract("o", r"\^\^<([^>]*)>$", 1)
    out = parts.select(
        bare(F.col("s")).alias("s"), "p", F.when(literal, body).otherwise(bare(F.col("o"))).alias("o"),
        F.when(literal, "literal").when(F.col("o").startswith("_:"), "blank").otherwise("iri").alias("o_kind"),
        F.when(literal, F.coalesce(F.nullif(dtype, F.lit("")), F.lit("http://www.w3.org/2001/XMLSchema#string"))).alias("o_dtype"),
    )
    return out.dropDuplicates()


_TTL = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^>]*>)|(?P<string>\"\"\"(?:[^\\]|\\.)*?\"\"\"|"(?:[^"\\\n]|\\.)*")
    |(?P<at>@[A-Za-z][\w-]*)|(?P<dtype>\^\^)|(?P<blank>_:\w+)|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
    |(?P<name>[A-Za-z_][\w-]*:[\w.-]*[\w-]|[A-Za-z_][\w-]*:|:[\w-]+)|(?P<word>true|false|a\b)|(?P<op>[.;,\[\]()])""",
    re.X,
)
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def parse_turtle(text: str) -> list[tuple[str, str, str, str, str | None]]:
    """Triples of a Turtle document (small ones: ontologies, shapes, fixtures)."""
    tokens, at = [], 0
    while at < len(text):
        m = _TTL.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at : at + 20]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    prefixes: dict[str, str] = {}
    out: list[tuple[str, str, str, str, str | None]] = []
    pos, blanks = 0, 0

    def fresh() -> str:
        nonlocal blanks
        blanks += 1
        return f"_:b{blanks}"

    def term() -> tuple[str, str, str | None]:
        nonlocal pos
        kind, t = tokens[pos]
        pos += 1
        if kind == "iri":
            return t[1:-1], "iri", None
        if kind == "name":
            prefix, _, local = t.partition(":")
            return prefixes[prefix] + local, "iri", None
        if kind == "blank":
            return t, "blank", None
        if kind == "word":
            return (RDF + "type", "iri", None) if t == "a" else (t, "literal", XSD + "boolean")
        if kind == "number":
            return t, "literal", XSD + ("double" if "e" in t.lower() else "decimal" if "." in t else "integer")
        if kind == "string":
            body = t[3:-3] if t.startswith('"""') else t[1:-1]
            value = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body)
            dtype = XSD + "string"
            if pos < len(tokens) and tokens[pos][0] == "dtype":
                pos += 1
                dtype = term()[0]
            elif pos < len(tokens) and tokens[pos][0] == "at":
                pos += 1
                dtype = RDF + "langString"
            return value, "literal", dtype
        if t == "[":
            node = fresh()
            if tokens[pos][1] != "]":
                properties(node)
            pos += 1
            return node, "blank", None
        if t == "(":
            items = []
            while tokens[pos][1] != ")":
                items.append(term())
            pos += 1
            rest = (RDF + "nil", "iri", None)
            for item in reversed(items):
                node = fresh()
                out.append((node, RDF + "first", *item))
                out.append((node, RDF + "rest", *rest))
                rest = (node, "blank", None)
            return rest
        raise ValueError(f"unexpected {t!r}")

    def properties(s: str) -> None:
        nonlocal pos
        while True:
            p = term()[0]
            while True:
                out.append((s, p, *term()))
                if tokens[pos][1] != ",":
                    break
                pos += 1
            if tokens[pos][1] != ";":
                return
            while tokens[pos][1] == ";":
                pos += 1
            if tokens[pos][1] in (".", "]"):
                return

    while pos < len(tokens):
        if tokens[pos][1] in ("@prefix", "@base"):
            prefixes[tokens[pos + 1][1].rstrip(":")] = tokens[pos + 2][1][1:-1]
            pos += 4
            continue
        s = term()[0]
        if tokens[pos][1] != ".":
            properties(s)
        pos += 1
    return out


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """A Turtle file parsed on the driver: ontologies and shapes are a few hundred lines."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(parse_turtle(text), TRIPLE).dropDuplicates()


def read_graph(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several files as one set of triples; a missing one is an error."""
    jvm = spark.sparkContext._jvm
    out = None
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            raise FileNotFoundError(path)
        df = read_ntriples(spark, path) if path.endswith(".nt") else read_turtle(spark, path)
        out = df if out is None else out.unionByName(df)
    return out.dropDuplicates()


# Paged and fanned-out catalogs: the fetcher is passed in, so tests need no network.


#: Status codes after which a fetch is repeated.
RETRIED = (429, 500, 502, 503, 504)


def with_retry(fetch: Callable[[str], bytes], attempts: int = 3, pause: Callable[[float], None] = time.sleep) -> Callable[[str], bytes]:
    """Repeats a fetch that fails for the moment, waiting 1 s, then 2 s: network errors, and of
    errors with a status (`code`) those of RETRIED; others, such as 404, are final."""

    def run(url: str) -> bytes:
        for k in range(attempts):
            try:
                return fetch(url)
            except OSError as error:
                if k + 1 == attempts or getattr(error, "code", None) not in (None, *RETRIED):
                    raise
                pause(2.0**k)
        raise AssertionError

    return run


def catalog_pages(start: str, fetch: Callable[[str], bytes], load: Callable[[bytes], dict]) -> Iterator[tuple[str, bytes, list[dict]]]:
    """(url, bytes, rows) of each page, following `links.next` within the start's scheme,
    host and path. A page seen before, a foreign page, an empty list or a row without an id
    is an error."""
    home, url, seen = urlsplit(start), start, set()
    while url:
        at = urlsplit(url)
        if (at.scheme, at.netloc, at.path) != (home.scheme, home.netloc, home.path) or url in seen:
            raise ValueError(f"page outside the catalog or seen before: {url}")
        seen.add(url)
        raw = fetch(url)
        page = load(raw)
        rows = page.get("data") if isinstance(page, dict) else None
        if not isinstance(rows, list) or not rows or any(not isinstance(r, dict) or not r.get("id") for r in rows):
            raise ValueError(f"no list of rows with ids: {url}")
        yield url, raw, rows
        follow = (page.get("links") or {}).get("next")
        url = urljoin(url, follow) if follow else None


def endpoint_url(base: str, slug: str) -> str:
    """URL of a model's endpoints: the slug encoded but for its slash, nothing climbing up."""
    if ".." in slug.split("/") or not slug.strip("/"):
        raise ValueError(f"unsafe id: {slug}")
    return f"{base}/{quote(slug, safe='/')}/endpoints"


def fan_out(urls: DataFrame, fetch: Callable[[str], bytes], tasks: int = 12) -> DataFrame:
    """Fetches a column `url` in parallel tasks: url, content, sha256, error (null if none)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for url in pdf["url"]:
                try:
                    rows.append((url, fetch(url), None))
                except (OSError, ValueError) as e:  # one failure is a warning, not the end
                    rows.append((url, None, str(e)))
            yield pd.DataFrame(rows, columns=["url", "content", "error"])

    got = urls.select("url").repartition(tasks).mapInPandas(run, "url string, content binary, error string")
    return got.withColumn("sha256", F.sha2("content", 256))
