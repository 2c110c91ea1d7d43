"""Graphs as views over tables: nothing is loaded, patterns become scans.

An EntityGraph maps wide tables to subjects and predicates; several patterns on one
subject become one scan of one table (single-valued predicates) plus joins for the
multi-valued ones. A TripleGraph holds plain (s, p, o) rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans.sparql import RDF_TYPE

RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
PROV = "http://www.w3.org/ns/prov#"
SCHEMA = "https://schema.org/"
XSD = "http://www.w3.org/2001/XMLSchema#"
DCTERMS = "http://purl.org/dc/terms/"
VOCAB = "urn:lodestone:vocab#"


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def local_name(iri: str) -> str:
    return iri.replace("#", "/").rsplit("/", 1)[-1]


def _as(df: DataFrame, s, o: str, s_name: str, o_name: str) -> DataFrame:
    return df.select(F.col(s).alias(s_name), F.col(o).alias(o_name))


#: Before a predicate: the pattern is read from its object, whose table has the subject as a column.
OWNED_BY = "owned-by:"


def datatype_of(t: T.DataType) -> str:
    """The literal datatype that values of a column have."""
    kinds = [(T.StringType, "string"), (T.BooleanType, "boolean"), (T.IntegralType, "integer"), (T.DecimalType, "decimal"), (T.FractionalType, "double"), (T.DateType, "date"), ((T.TimestampType, T.TimestampNTZType), "dateTime")]
    return XSD + next((name for kind, name in kinds if isinstance(t, kind)), "string")


@dataclass
class Entity:
    """One kind of subject.

    frame has the key column and a column for each single-valued predicate (at most one
    value a subject). multi maps predicates to frames (s, o) of any number of values.
    literal names the predicates whose values are literals, for triple output.
    """

    name: str
    classes: tuple[str, ...]
    frame: DataFrame
    key: str
    single: dict[str, str] = field(default_factory=dict)
    multi: dict[str, DataFrame] = field(default_factory=dict)
    resources: frozenset[str] = frozenset()
    class_column: str | None = None  # a column naming the class, if rows differ
    owner: dict[str, str] = field(default_factory=dict)  # predicate that points here from another kind -> the column of that subject

    def has(self, p: str) -> bool:
        return p == RDF_TYPE or p in self.single or p in self.multi or p.removeprefix(OWNED_BY) in self.owner and p.startswith(OWNED_BY)


class EntityGraph:
    def __init__(self, entities: list[Entity], targets: dict[str, set[str]] | None = None):
        self.entities = {e.name: e for e in entities}
        self._targets = targets or {}
        known = {p for e in entities for p in (*e.single, *e.multi)} | {c for e in entities for c in e.classes}
        self._local = {local_name(x): x for x in sorted(known)}
        self._known = known | {RDF_TYPE}
        self._owners = {p for e in entities for p in e.owner}

    def owned(self, iri: str) -> str | None:
        """The predicate to look for at the object's own table instead, if there is one: a
        reverse edge then is a column of one scan and not a join."""
        p = self.resolve(iri)
        return OWNED_BY + p if p in self._owners else None

    def resolve(self, iri: str) -> str:
        """A term of the graph by its IRI or, under another namespace, by its local name."""
        return iri if iri in self._known or iri.startswith(OWNED_BY) else self._local.get(local_name(iri), iri)

    def target(self, iri: str) -> set[str] | None:
        """Kinds that the values of a predicate are of, if that is known."""
        return self._targets.get(self.resolve(iri))

    def star(self, subject: str, wanted: list[tuple[str, str]], domain: set[str] | None = None, maybe: list[tuple[str, str]] | None = None) -> tuple[DataFrame | None, set[str]]:
        """All patterns (predicate, column name) on one subject: rows with the columns
        `subject` and each name, and the kinds of subject that can match. One scan a kind.
        Of `maybe`, those that are columns of every kind are read along and may be null."""
        wanted = [(self.resolve(p), name) for p, name in wanted]
        kinds = [e for e in self.entities.values() if (domain is None or e.name in domain) and all(e.has(p) for p, _ in wanted)]
        extra = [(q, name) for q, name in ((self.resolve(p), name) for p, name in maybe or []) if all(q in e.single for e in kinds)]
        return (union_all(self._aligned([self._star(e, subject, wanted, extra) for e in kinds])) if kinds else None), {e.name for e in kinds}

    @staticmethod
    def _aligned(frames: list[DataFrame]) -> list[DataFrame]:
        """Columns whose type differs between kinds become text."""
        if len(frames) < 2:
            return frames
        mixed = [c for c in frames[0].columns if len({f.schema[c].dataType for f in frames}) > 1]
        return [f.withColumns({c: F.col(c).cast("string") for c in mixed}) if mixed else f for f in frames]

    def _star(self, e: Entity, subject: str, wanted: list[tuple[str, str]], maybe: list[tuple[str, str]]) -> DataFrame:
        columns: list[Column] = [F.col(e.key).alias(subject), *(F.col(e.single[p]).alias(name) for p, name in maybe)]
        joined, checks = [], []
        for p, name in wanted:
            if p == RDF_TYPE:
                if e.class_column:
                    columns.append(F.col(e.class_column).alias(name))
                else:
                    columns.append(F.explode(F.array(*map(F.lit, e.classes))).alias(name) if len(e.classes) > 1 else F.lit(e.classes[0]).alias(name))
            elif p in e.single or p.startswith(OWNED_BY):
                columns.append(F.col(e.single[p] if p in e.single else e.owner[p.removeprefix(OWNED_BY)]).alias(name))
                checks.append(name)
            else:
                joined.append((p, name))
        df = e.frame.select(*columns)
        for name in checks:
            df = df.where(F.col(name).isNotNull())
        for p, name in joined:
            df = df.join(_as(e.multi[p], "s", "o", subject, name), subject)
        return df

    def scan(self, p: str) -> DataFrame:
        df, _ = self.star("s", [(p, "o")])
        if df is None:
            raise ValueError(f"no such predicate: {p}")
        return df

    def triples(self, domain: set[str] | None = None) -> DataFrame:
        """(s, p, o as text, o_kind: iri or literal, o_dtype of literals) of the whole graph:
        one narrow branch a predicate, with the predicate a constant, so a filter on it prunes
        the others."""
        out = []

        def kind(e: Entity, p: str, frame: DataFrame, c: str) -> list[Column]:
            dtype = None if p in e.resources else datatype_of(frame.schema[c].dataType)
            return [F.lit("iri" if p in e.resources else "literal").alias("o_kind"), F.lit(dtype).cast("string").alias("o_dtype")]

        for e in self.entities.values():
            if domain is not None and e.name not in domain:
                continue
            cls = F.col(e.class_column) if e.class_column else F.explode(F.array(*map(F.lit, e.classes)))
            out.append(e.frame.select(F.col(e.key).alias("s"), F.lit(RDF_TYPE).alias("p"), cls.alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dtype")))
            for p, c in e.single.items():
                out.append(e.frame.where(F.col(c).isNotNull()).select(F.col(e.key).alias("s"), F.lit(p).alias("p"), F.col(c).cast("string").alias("o"), *kind(e, p, e.frame, c)))
            for p, f in e.multi.items():
                out.append(f.where(F.col("o").isNotNull()).select("s", F.lit(p).alias("p"), F.col("o").cast("string").alias("o"), *kind(e, p, f, "o")))
        return union_all(out)


class TripleGraph:
    """Rows (s, p, o, o_kind), each once; o as text."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def resolve(self, iri: str) -> str:
        return iri

    def owned(self, iri: str) -> str | None:
        return None

    def target(self, iri: str) -> set[str] | None:
        return None

    def star(self, subject: str, wanted: list[tuple[str, str]], domain: set[str] | None = None, maybe: list[tuple[str, str]] | None = None) -> tuple[DataFrame | None, set[str]]:
        df = None
        for p, name in wanted:
            one = _as(self.rows.where(F.col("p") == p), "s", "o", subject, name)
            df = one if df is None else df.join(one, subject)
        return df, set()

    def scan(self, p: str) -> DataFrame:
        return self.rows.where(F.col("p") == p).select("s", "o")

    def triples(self, domain: set[str] | None = None) -> DataFrame:
        return self.rows
