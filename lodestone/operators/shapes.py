"""Constraint checks over triples: each gives its violations, and all have one schema.

A graph is checked as asserted, without inference but for subclasses. Every check is a
join or an aggregate over (s, p, o, o_kind, o_dtype) rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.reason import subclass_closure
from lodestone.plans.sparql import RDF_TYPE

XSD = "http://www.w3.org/2001/XMLSchema#"
REPORT = ["focus_node", "path", "value", "constraint", "message"]
#: Types whose text must parse, and as what.
LEXICAL = {XSD + "decimal": "decimal(38,18)", XSD + "integer": "decimal(38,0)", XSD + "dateTime": "timestamp", XSD + "boolean": "boolean", XSD + "double": "double"}
#: Rows a task where rows meet by their focus node. Shuffled bytes don't bound them: keys in order shrink to a few bytes.
TASK_ROWS = 300_000


@dataclass
class Property:
    path: str
    inverse: bool = False
    min_count: int | None = None
    max_count: int | None = None
    datatype: str | None = None
    cls: str | None = None
    any_class: list[str] = field(default_factory=list)  # one of these
    not_class: str | None = None
    node_kind: str | None = None  # iri or literal
    min_inclusive: float | None = None
    max_inclusive: float | None = None
    min_length: int | None = None
    pattern: str | None = None
    values: list[str] | None = None


@dataclass
class Shape:
    target_classes: list[str] = field(default_factory=list)
    target_subjects_of: list[str] = field(default_factory=list)
    node_kind: str | None = None
    properties: list[Property] = field(default_factory=list)
    exactly_one: list[list[Property]] = field(default_factory=list)  # xone over groups of properties


class Checker:
    """Runs shapes over one graph. subclasses: (sub, super) rows."""

    def __init__(self, triples: DataFrame, subclasses: DataFrame | None = None):
        self.t = triples if "o_dtype" in triples.columns else triples.withColumn("o_dtype", F.lit(None).cast("string"))
        types = self.t.where(F.col("p") == RDF_TYPE).select("s", F.col("o").alias("cls"))
        if subclasses is not None:
            up = subclass_closure(subclasses)
            types = types.unionByName(types.join(up, types.cls == up["sub"]).select("s", F.col("super").alias("cls")))
        self.types = types  # a row may be there twice

    def targets(self, shape: Shape) -> DataFrame:
        """(focus), each of them once or more."""
        out = []
        if shape.target_classes:
            out.append(self.types.where(F.col("cls").isin(shape.target_classes)).select(F.col("s").alias("focus")))
        if shape.target_subjects_of:
            out.append(self.t.where(F.col("p").isin(shape.target_subjects_of)).select(F.col("s").alias("focus")))
        return reduce(DataFrame.unionByName, out)

    def tasks(self, shape: Shape) -> int:
        """How many tasks the rows of a shape are dealt to, by the number of its most frequent predicate's rows."""
        paths = {p.path for p in (*shape.properties, *(p for group in shape.exactly_one for p in group))} | {*shape.target_subjects_of} | ({RDF_TYPE} if shape.target_classes else set())
        rows = max((r["count"] for r in self.t.where(F.col("p").isin(sorted(paths))).groupBy("p").count().collect()), default=0)
        return max(1, math.ceil(rows / TASK_ROWS), min(self.t.sparkSession.sparkContext.defaultParallelism, 10 * rows // TASK_ROWS))

    def values(self, p: Property) -> DataFrame:
        rows = self.t.where(F.col("p") == p.path)
        if p.inverse:
            return rows.select(F.col("o").alias("focus"), F.col("s").alias("value"), F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("dtype"))
        return rows.select(F.col("s").alias("focus"), F.col("o").alias("value"), F.col("o_kind").alias("kind"), F.col("o_dtype").alias("dtype"))

    @staticmethod
    def report(df: DataFrame, path: str, constraint: str, message: str) -> DataFrame:
        value = F.col("value") if "value" in df.columns else F.lit(None)
        return df.select(F.col("focus").alias("focus_node"), F.lit(path).alias("path"), value.cast("string").alias("value"), F.lit(constraint).alias("constraint"), F.lit(message).alias("message"))

    @staticmethod
    def reports(df: DataFrame, path: str, rules: list[tuple[str, Column, str]]) -> DataFrame:
        """The same for several rules (constraint, what is wrong, message) in one pass: a row for each that a row breaks."""
        broken = F.array_compact(F.array(*[F.when(wrong, F.struct(F.lit(c).alias("constraint"), F.lit(m).alias("message"))) for c, wrong, m in rules]))
        return df.select(F.col("focus").alias("focus_node"), F.lit(path).alias("path"), F.col("value").cast("string").alias("value"), F.inline(broken))

    @staticmethod
    def among(rows: DataFrame, targets: DataFrame, tasks: int) -> DataFrame:
        """Rows whose focus is a target. A semi join would be moved before the repartition."""
        return rows.repartition(tasks, "focus").join(targets.repartition(tasks, "focus").distinct().hint("merge"), "focus")

    def has_class(self, values: DataFrame, classes: list[str], how: str) -> DataFrame:
        members = self.types.where(F.col("cls").isin(classes)).select(F.col("s").alias("value")).distinct()
        return values.join(members, "value", how)

    def counts(self, targets: DataFrame, p: Property, tasks: int) -> DataFrame:
        """(focus, value: how many different values) of each target. Targets and values meet in
        one aggregate by focus, without a join."""
        none = F.lit(None).cast("string")
        held = self.values(p).where(F.col("focus").isNotNull()).select("focus", "value", "kind", F.lit(False).alias("target"))
        rows = targets.select("focus", none.alias("value"), none.alias("kind"), F.lit(True).alias("target")).unionByName(held).repartition(tasks, "focus")
        each = rows.groupBy("focus", "value", "kind").agg(F.bool_or("target").alias("target"))
        n = F.count(F.when(F.col("kind").isNotNull(), F.col("value")))
        return each.groupBy("focus").agg(F.bool_or("target").alias("target"), n.alias("value")).where("target").drop("target")

    def property(self, targets: DataFrame, p: Property, tasks: int) -> list[DataFrame]:
        name = ("^" if p.inverse else "") + p.path
        out = []
        limits: list[tuple[str, Column, str]] = []
        if p.min_count is not None:
            limits.append(("minCount", F.col("value") < p.min_count, f"fewer than {p.min_count} values"))
        if p.max_count is not None:
            limits.append(("maxCount", F.col("value") > p.max_count, f"more than {p.max_count} values"))
        if limits:
            out.append(self.reports(self.counts(targets, p, tasks), name, limits))
        bad: list[tuple[str, Column, str]] = []
        if p.node_kind:
            bad.append(("nodeKind", F.col("kind") != p.node_kind, f"is no {p.node_kind}"))
        if p.datatype:
            parsed = F.col("value").try_cast(LEXICAL[p.datatype]).isNull() if p.datatype in LEXICAL else F.lit(False)
            bad.append(("datatype", (F.col("kind") != "literal") | ~F.coalesce(F.col("dtype") == p.datatype, F.lit(False)) | parsed, f"is no {p.datatype}"))
        number = F.col("value").try_cast("decimal(38,18)")
        if p.min_inclusive is not None:
            bad.append(("minInclusive", number.isNull() | (number < p.min_inclusive), f"is under {p.min_inclusive}"))
        if p.max_inclusive is not None:
            bad.append(("maxInclusive", number.isNull() | (number > p.max_inclusive), f"is over {p.max_inclusive}"))
        if p.min_length is not None:
            bad.append(("minLength", F.length("value") < p.min_length, f"is shorter than {p.min_length}"))
        if p.pattern is not None:
            bad.append(("pattern", ~F.col("value").rlike(p.pattern), f"doesn't match {p.pattern}"))
        if p.values is not None:
            bad.append(("in", ~F.col("value").isin(p.values), "is not in the list"))
        if bad:  # what breaks no rule isn't shuffled
            wrong = self.values(p).where(reduce(Column.__or__, [x for _, x, _ in bad]))
            out.append(self.reports(self.among(wrong, targets, tasks), name, bad))
        if p.cls or p.any_class or p.not_class:
            found = self.among(self.values(p), targets, tasks)
            if p.cls:
                out.append(self.report(self.has_class(found, [p.cls], "left_anti"), name, "class", f"is no {p.cls}"))
            if p.any_class:
                out.append(self.report(self.has_class(found, p.any_class, "left_anti"), name, "or", "is of none of the classes"))
            if p.not_class:
                out.append(self.report(self.has_class(found, [p.not_class], "left_semi"), name, "not", f"is a {p.not_class}"))
        return out

    def check(self, shape: Shape) -> DataFrame:
        """Violations of a shape: focus_node, path, value, constraint, message."""
        targets, tasks = self.targets(shape), self.tasks(shape)
        out = []
        if shape.node_kind == "iri":
            out.append(self.report(targets.where(F.col("focus").startswith("_:")).distinct(), "", "nodeKind", "is no iri"))
        for p in shape.properties:
            out += self.property(targets, p, tasks)
        if shape.exactly_one:
            marks = [targets.select("focus", F.lit(-1).alias("group"))]
            for i, group in enumerate(shape.exactly_one):
                marks += [x.where(F.col("focus_node").isNotNull()).select(F.col("focus_node").alias("focus"), F.lit(i).alias("group")) for p in group for x in self.property(targets, p, tasks)]
            groups = range(len(shape.exactly_one))
            flags = reduce(DataFrame.unionByName, marks).repartition(tasks, "focus").groupBy("focus").agg(*[F.bool_or(F.col("group") == i).alias(f"bad{i}") for i in groups])
            holding = sum((F.when(F.col(f"bad{i}"), 0).otherwise(1) for i in groups), F.lit(0))
            out.append(self.report(flags.where(holding != 1), "", "xone", "not exactly one alternative holds"))
        return reduce(DataFrame.unionByName, out) if out else self.report(targets.where(F.lit(False)), "", "", "")

    def asserted(self, subject: str, target: str, edge: str) -> DataFrame:
        """Nodes whose (subject, target) pair lacks the edge: a left anti join each way."""
        pairs = self.values(Property(subject)).select(F.col("focus"), F.col("value").alias("a")).join(self.values(Property(target)).select("focus", "value"), "focus")
        edges = self.t.where(F.col("p") == edge).select(F.col("s").alias("a"), F.col("o").alias("value"))
        return self.report(pairs.join(edges, ["a", "value"], "left_anti"), edge, "sparql", "the link is not asserted")

    def evidenced(self, subject: str, target: str, edge: str) -> DataFrame:
        """Edges that no (subject, target) record supports."""
        pairs = self.values(Property(subject)).select("focus", F.col("value").alias("a")).join(self.values(Property(target)).select("focus", F.col("value").alias("value")), "focus").select("a", "value")
        edges = self.t.where(F.col("p") == edge).select(F.col("s").alias("a"), F.col("o").alias("value"))
        return self.report(edges.join(pairs, ["a", "value"], "left_anti").withColumn("focus", F.col("a")), edge, "sparql", "the link has no evidence")


def conforms(violations: DataFrame) -> DataFrame:
    """(constraint, path, n) of a report, in order; empty means that the graph conforms."""
    return violations.groupBy("constraint", "path").agg(F.count(F.lit(1)).alias("n")).orderBy("constraint", "path")


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent; a null key refers to nothing."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def duplicate_ids(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def count_parity(tables: dict[str, DataFrame], triples: DataFrame, classes: dict[str, str]) -> DataFrame:
    """(name, rows, subjects) of each table against the subjects of its class; equal if all is well."""
    rows = [df.agg(F.lit(name).alias("name"), F.count_distinct("id").alias("rows")) for name, df in tables.items()]
    named = F.create_map(*[F.lit(x) for k, v in classes.items() for x in (v, k)])
    subjects = triples.where((F.col("p") == RDF_TYPE) & F.col("o").isin(list(classes.values()))).groupBy(F.element_at(named, F.col("o")).alias("name")).agg(F.count_distinct("s").alias("subjects"))
    return reduce(DataFrame.unionByName, rows).join(subjects, "name", "left").select("name", "rows", F.coalesce("subjects", F.lit(0)).alias("subjects"))
