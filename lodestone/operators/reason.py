"""Rule-based inference to a fixpoint: subclass, domain, range, disjointness, sameAs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.graph import OWL, RDFS
from lodestone.plans.sparql import RDF_TYPE

SUBCLASS, DOMAIN, RANGE, DISJOINT, SAME = RDFS + "subClassOf", RDFS + "domain", RDFS + "range", OWL + "disjointWith", OWL + "sameAs"


def _kept(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the shared folder, which outlives lost executors. Only
    a local session without the setting takes a folder of its own."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return df.checkpoint(eager=True)


def subclass_closure(subclasses: DataFrame) -> DataFrame:
    """(sub, super) for every chain of one step or more. Doubling: chains of length up to
    2^k after k rounds."""
    reach = _kept(subclasses.select("sub", "super").where(F.col("sub") != F.col("super")).distinct())
    n = reach.count()
    while True:
        more = reach.alias("a").join(reach.alias("b"), F.col("a.super") == F.col("b.sub")).select(F.col("a.sub").alias("sub"), F.col("b.super").alias("super"))
        reach = _kept(reach.unionByName(more).distinct())
        now = reach.count()
        if now == n:
            return reach
        n = now


def schema_of(triples: DataFrame) -> dict[str, DataFrame]:
    pick = lambda p, a, b: triples.where((F.col("p") == p) & (F.col("o_kind") == "iri")).select(F.col("s").alias(a), F.col("o").alias(b)).distinct()
    return {"subclass": pick(SUBCLASS, "sub", "super"), "domain": pick(DOMAIN, "p", "cls"), "range": pick(RANGE, "p", "cls"), "disjoint": pick(DISJOINT, "a", "b")}


def same_as_closure(triples: DataFrame) -> DataFrame:
    """(a, b) of equal individuals: symmetric and transitive, without a = a."""
    pairs = triples.where(F.col("p") == SAME).select(F.col("s").alias("sub"), F.col("o").alias("super"))
    both = pairs.unionByName(pairs.select(F.col("super").alias("sub"), F.col("sub").alias("super")))
    return subclass_closure(both).where(F.col("sub") != F.col("super")).select(F.col("sub").alias("a"), F.col("super").alias("b"))


def infer_types(triples: DataFrame, schema: dict[str, DataFrame]) -> DataFrame:
    """(s, cls) asserted and inferred from domains, ranges, subclasses. A range that is a
    union (a blank node) infers no member class. One pass suffices: the subclass closure is
    taken first, and types give no new edges."""
    asserted = triples.where(F.col("p") == RDF_TYPE).select("s", F.col("o").alias("cls"))
    by_domain = triples.join(schema["domain"], "p").select("s", "cls")
    by_range = triples.where(F.col("o_kind") != "literal").join(schema["range"], "p").select(F.col("o").alias("s"), "cls")
    direct = asserted.unionByName(by_domain).unionByName(by_range).distinct()
    up = subclass_closure(schema["subclass"])
    return direct.unionByName(direct.join(up, direct.cls == up["sub"]).select("s", F.col("super").alias("cls"))).distinct()


def disjoint_violations(types: DataFrame, disjoint: DataFrame) -> DataFrame:
    """(s, a, b): individuals in two classes that exclude each other."""
    a, b = types.select("s", F.col("cls").alias("a")), types.select("s", F.col("cls").alias("b"))
    return a.join(disjoint, "a").join(b, ["s", "b"]).select("s", "a", "b").distinct()


def owl_closure(triples: DataFrame) -> DataFrame:
    """Triples with every inferred type and, for equal individuals, every replaced subject
    and object (to a fixpoint: replacement may meet new domains)."""
    schema = schema_of(triples)
    columns = ["s", "p", "o", "o_kind"]
    known = _kept(triples.select(*columns).distinct())
    same = _kept(same_as_closure(known))
    n = known.count()
    while True:
        types = infer_types(known, schema).select("s", F.lit(RDF_TYPE).alias("p"), F.col("cls").alias("o"), F.lit("iri").alias("o_kind"))
        subject = known.join(same, known.s == same.a).select(F.col("b").alias("s"), "p", "o", "o_kind")
        object_ = known.where(F.col("o_kind") == "iri").join(same, F.col("o") == F.col("a")).select("s", "p", F.col("b").alias("o"), "o_kind")
        known = _kept(known.unionByName(types).unionByName(subject).unionByName(object_).distinct())
        now = known.count()
        if now == n:
            return known
        n = now
