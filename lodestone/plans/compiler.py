"""From query algebra to DataFrames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans.graph import EntityGraph, TripleGraph
from lodestone.plans.sparql import AGGREGATES, RDF_TYPE, Call, Group, Iri, Literal, Path, Query, Triple, Var, parse

NUMBER = "decimal(38,12)"


class Compiler:
    """Compiles one query over a graph. Kinds of subjects seen so far narrow later scans."""

    def __init__(self, graph: EntityGraph | TripleGraph):
        self.graph = graph
        self.fresh = 0

    def name(self, stem: str) -> str:
        self.fresh += 1
        return f"__{stem}{self.fresh}"

    # joins
    @staticmethod
    def join(a: DataFrame | None, b: DataFrame, how: str = "inner") -> DataFrame:
        if a is None:
            return b
        shared = [c for c in a.columns if c in b.columns]
        if not shared:
            raise ValueError("patterns without a common variable: a cross join is not offered")
        for c in shared:  # terms of different types are compared as text
            if a.schema[c].dataType != b.schema[c].dataType:
                a, b = a.withColumn(c, F.col(c).cast("string")), b.withColumn(c, F.col(c).cast("string"))
        return a.join(b, shared, how)

    # patterns
    def term(self, t: Any) -> Any:
        return self.graph.resolve(t.value) if isinstance(t, Iri) else t.value

    def constant(self, df: DataFrame, column: str, t: Any) -> DataFrame:
        value = self.term(t)
        c = F.col(column)
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return df.where(c.try_cast(NUMBER) == F.lit(str(value)).cast(NUMBER))
        return df.where(c.cast("string") == F.lit(str(value)))

    def bgp(self, triples: list[Triple], df: DataFrame | None, domain: dict[str, set[str]], maybe: list[Triple] | None = None) -> DataFrame:
        """Solutions of all patterns; `maybe`: optional ones that may be read along."""
        stars: dict[Any, list[Triple]] = {}
        others = []
        for t in triples:  # what a value must be narrows the scans of its own patterns
            kinds = self.graph.target(t.p.value) if isinstance(t.p, Iri) and isinstance(t.o, Var) else None
            if kinds:
                domain[t.o.name] = domain.get(t.o.name, kinds) & kinds
        for t in triples:
            back = self.graph.owned(t.p.value) if isinstance(t.p, Iri) and isinstance(t.o, Var) else None
            if back:
                stars.setdefault(t.o, []).append(Triple(t.o, Iri(back), t.s))
            elif isinstance(t.p, Iri):
                stars.setdefault(t.s, []).append(t)
            else:
                others.append(t)
        frames = [self.star(s, ts, domain, [t for t in maybe or [] if t.s == s]) for s, ts in stars.items()] + [self.odd(t, domain) for t in others]
        # take next what shares a variable, so that no product arises
        while frames:
            k = 0 if df is None else next((i for i, f in enumerate(frames) if set(f.columns) & set(df.columns)), 0)
            df = self.join(df, frames.pop(k))
        return df

    def star(self, s: Any, triples: list[Triple], domain: dict[str, set[str]], maybe: list[Triple]) -> DataFrame:
        subject = s.name if isinstance(s, Var) else self.name("s")
        names, wanted, fixed, equal = [], [], [], []
        for t in triples:
            p = self.graph.resolve(t.p.value)
            if isinstance(t.o, Var) and t.o.name not in names and t.o.name != subject:
                name = t.o.name
            else:
                name = self.name("o")
                (equal.append((name, t.o.name)) if isinstance(t.o, Var) else fixed.append((name, t.o)))
            names.append(name)
            wanted.append((p, name))
        before = domain.get(subject)
        # a constant class narrows the kinds of subject before anything is scanned
        if isinstance(self.graph, EntityGraph):
            for (p, name), t in zip(wanted, triples, strict=True):
                if p == RDF_TYPE and isinstance(t.o, Iri):
                    cls = self.term(t.o)
                    fits = {e.name for e in self.graph.entities.values() if cls in e.classes}
                    before = fits if before is None else before & fits
        df, kinds = self.graph.star(subject, wanted, before, [(t.p.value, t.o.name) for t in maybe])
        if df is None:  # no kind has them all: each pattern by itself
            df = None
            for p, name in wanted:
                one = self.graph.scan(p).select(F.col("s").alias(subject), F.col("o").alias(name))
                df = self.join(df, one)
        elif kinds:
            domain[subject] = kinds
        for name, o in fixed:
            df = self.constant(df, name, o)
        for name, other in equal:
            df = df.where(F.col(name) == F.col(other))
        if not isinstance(s, Var):
            df = self.constant(df, subject, s).drop(subject)
        return df.drop(*[n for n in names if n.startswith("__")])

    def odd(self, t: Triple, domain: dict[str, set[str]]) -> DataFrame:
        """A pattern with a variable predicate or a path."""
        if isinstance(t.p, Var):
            rows = self.graph.triples(domain.get(t.s.name) if isinstance(t.s, Var) else None)
            rows = rows.select("s", "p", "o")
        else:
            rows = self.path(t.p)
        keep = []
        for c, x in (("s", t.s), ("p", t.p), ("o", t.o)):
            if c not in rows.columns:
                continue
            if isinstance(x, Var):
                keep.append(F.col(c).alias(x.name))
            else:
                rows = self.constant(rows, c, x)
        return rows.select(*keep)

    def path(self, p: Any) -> DataFrame:
        """(s, o) pairs of a path, a set for `?`."""
        if isinstance(p, Iri):
            return self.graph.scan(self.graph.resolve(p.value))
        if p.op == "^":
            return self.path(p.parts[0]).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if p.op == "|":
            out = [self.path(x) for x in p.parts]
            return out[0].unionByName(out[1]) if len(out) == 2 else self.path(Path("|", [p.parts[0], Path("|", p.parts[1:])]))
        if p.op == "/":
            a = self.path(p.parts[0])
            for x in p.parts[1:]:
                a = a.select("s", F.col("o").alias("m")).join(self.path(x).select(F.col("s").alias("m"), "o"), "m").select("s", "o")
            return a
        step = self.path(p.parts[0])  # `?`: no step or one
        ends = step.select(F.col("o").alias("s")).unionByName(step.select("s"))
        return step.select("s", "o").unionByName(ends.select("s", F.col("s").alias("o"))).distinct()

    @staticmethod
    def single(part: Any) -> bool:
        """Whether a part is OPTIONAL with one pattern between two variables."""
        inner = part[1].parts if isinstance(part, tuple) and part[0] == "optional" else []
        if len(inner) != 1 or not isinstance(inner[0], list) or len(inner[0]) != 1:
            return False
        t = inner[0][0]
        return isinstance(t.s, Var) and isinstance(t.p, Iri) and isinstance(t.o, Var) and t.s != t.o

    def read_along(self, parts: list[Any], k: int, df: DataFrame | None) -> list[Triple]:
        """Optional patterns right after the patterns at `k` whose value no other part before
        or among them binds: on a single-valued predicate they are a nullable column of the
        subject's own scan instead of a join."""
        bound = {x.name for t in parts[k] for x in (t.s, t.p, t.o) if isinstance(x, Var)} | set(df.columns if df is not None else [])
        out = []
        for part in parts[k + 1 :]:
            if isinstance(part, tuple) and part[0] == "filter":
                continue
            if not self.single(part):
                break
            t = part[1].parts[0][0]
            if t.o.name in bound or not self.graph.resolve(t.p.value) or self.graph.owned(t.p.value):
                break
            bound.add(t.o.name)
            out.append(t)
        return out

    def group(self, g: Group, df: DataFrame | None = None, domain: dict[str, set[str]] | None = None) -> DataFrame:
        """Solutions of a group that extend `df`. A branch sees the variables bound before it."""
        domain = {} if domain is None else domain
        filters = []
        for k, part in enumerate(g.parts):
            if isinstance(part, list):
                df = self.bgp(part, df, domain, self.read_along(g.parts, k, df))
                continue
            kind = part[0]
            if kind == "filter":
                filters.append(part[1])
            elif kind == "optional":
                if self.single(part) and df is not None and part[1].parts[0][0].o.name in df.columns:
                    continue  # read along with its subject
                right = self.group(part[1], None, dict(domain))
                df = right if df is None else self.join(df, right, "left")
            elif kind == "minus":
                gone = self.group(part[1])
                if df is not None and set(df.columns) & set(gone.columns):  # without a common variable nothing goes
                    df = self.join(df, gone, "left_anti")
            elif kind == "union":
                branches = [self.group(b, df, dict(domain)) for b in part[1]]
                out = branches[0]
                for b in branches[1:]:
                    for c in set(out.columns) & set(b.columns):
                        if out.schema[c].dataType != b.schema[c].dataType:
                            out, b = out.withColumn(c, F.col(c).cast("string")), b.withColumn(c, F.col(c).cast("string"))
                    out = out.unionByName(b, allowMissingColumns=True)
                df = out
            elif kind == "group":
                df = self.join(df, self.group(part[1], None, dict(domain)))
            elif kind == "bind":
                df = df.withColumn(part[1].name, self.expression(part[2], df))
                if isinstance(part[2], Var) and part[2].name in domain:
                    domain[part[1].name] = domain[part[2].name]
            elif kind == "values":
                values = [self.term(t) for t in part[2]]
                if df is None or part[1].name not in df.columns:
                    raise ValueError("VALUES needs a pattern with its variable before it")
                df = df.where(F.col(part[1].name).isin(values))
            elif kind == "select":
                df = self.join(df, self.select(part[1]))
        for e in filters:
            if isinstance(e, Call) and e.name in ("EXISTS", "NOT EXISTS"):
                df = self.join(df, self.group(e.args[0]), "left_semi" if e.name == "EXISTS" else "left_anti")
            else:
                df = df.where(self.expression(e, df))
        return df

    # expressions
    def expression(self, e: Any, df: DataFrame) -> Column:
        if isinstance(e, Var):
            return F.col(e.name) if e.name in df.columns else F.lit(None).cast("string")
        if isinstance(e, (Iri, Literal)):
            return F.lit(self.term(e))
        name, args = e.name, e.args
        if name in ("=", "!=", "<", ">", "<=", ">="):
            return self.compare(name, args[0], args[1], df)
        if name == "IN":
            x = self.expression(args[0], df)
            if all(isinstance(a, (Iri, Literal)) and not isinstance(self.term(a), (int, float)) for a in args[1:]):
                return x.cast("string").isin([self.term(a) for a in args[1:]])
            out = self.compare("=", args[0], args[1], df)
            for a in args[2:]:
                out = out | self.compare("=", args[0], a, df)
            return out
        a = [self.expression(x, df) for x in args]
        text = lambda i=0: a[i].cast("string")
        number = lambda i: a[i].try_cast(NUMBER)
        simple = {
            "&&": lambda: a[0] & a[1], "||": lambda: a[0] | a[1], "!": lambda: ~a[0],
            "+": lambda: number(0) + number(1), "-": lambda: number(0) - number(1), "*": lambda: number(0) * number(1), "/": lambda: F.try_divide(number(0), number(1)),
            "STR": text, "LCASE": lambda: F.lower(text()), "UCASE": lambda: F.upper(text()), "STRLEN": lambda: F.length(text()),
            "CONTAINS": lambda: F.contains(text(0), text(1)), "STRSTARTS": lambda: F.startswith(text(0), text(1)), "STRENDS": lambda: F.endswith(text(0), text(1)),
            "CONCAT": lambda: F.concat(*(x.cast("string") for x in a)), "BOUND": lambda: a[0].isNotNull(), "ABS": lambda: F.abs(number(0)),
            "IF": lambda: F.when(a[0], a[1]).when(~a[0], a[2]), "REGEX": lambda: F.regexp(text(0), F.concat(F.lit("(?i)"), text(1)) if len(a) > 2 else text(1)),
            "COALESCE": lambda: F.coalesce(*(x.cast("string") for x in a)) if len({str(df.select(x).schema[0].dataType) for x in a}) > 1 else F.coalesce(*a),
        }
        if name not in simple:
            raise ValueError(f"unknown function {name}")
        return simple[name]()

    def compare(self, op: str, left: Any, right: Any, df: DataFrame) -> Column:
        a, b = self.expression(left, df), self.expression(right, df)
        numeric = [isinstance(x, Literal) and isinstance(x.value, (int, float)) and not isinstance(x.value, bool) for x in (left, right)]
        types = [df.select(x).schema[0].dataType for x in (a, b)]
        if any(numeric):  # what is no number compares as null and drops out
            a, b = (x.cast("string").try_cast(NUMBER) for x in (a, b))
        elif types[0] != types[1] and not all(isinstance(t, T.NumericType) for t in types):
            a, b = a.cast("string"), b.cast("string")
        return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]

    # solution modifiers
    def aggregate(self, e: Call, df: DataFrame) -> Column:
        x = None if e.args == ["*"] else self.expression(e.args[0], df)
        if e.name == "COUNT":
            return F.count(F.lit(1)) if x is None else F.count_distinct(x) if e.distinct else F.count(x)
        if e.name == "GROUP_CONCAT":
            found = F.collect_set(x.cast("string")) if e.distinct else F.collect_list(x.cast("string"))
            return F.array_join(F.array_sort(found), e.separator)
        number = x.cast("string").try_cast(NUMBER)
        return {"SUM": F.sum(number), "AVG": F.avg(number), "MIN": F.min(x), "MAX": F.max(x), "SAMPLE": F.min(x)}[e.name]

    def select(self, q: Query) -> DataFrame:
        df = self.group(q.where)
        columns = q.columns or [(Var(c), c) for c in df.columns if not c.startswith("__")]
        found: dict[str, Call] = {}

        def split(e: Any) -> Any:
            """The expression with each aggregate replaced by a variable."""
            if isinstance(e, Call) and e.name in AGGREGATES:
                name = self.name("agg")
                found[name] = e
                return Var(name)
            return Call(e.name, [split(a) for a in e.args]) if isinstance(e, Call) else e

        columns = [(split(e), name) for e, name in columns]
        having = [split(e) for e in q.having]
        if found or q.group:
            df = df.groupBy(*[v.name for v in q.group]).agg(*[self.aggregate(e, df).alias(n) for n, e in found.items()])
        for e in having:
            df = df.where(self.expression(e, df))
        extra = {name: self.expression(e, df) for e, name in columns if not (isinstance(e, Var) and e.name == name)}
        df = df.withColumns(extra) if extra else df
        names = [name for _, name in columns]
        for n in names:  # a variable no pattern binds
            if n not in df.columns:
                df = df.withColumn(n, F.lit(None).cast("string"))
        if q.distinct:
            df = df.select(*names).distinct()
        keys = [self.expression(e, df) for e, _ in q.order]
        if keys:
            df = df.orderBy(*[k.desc() if down else k.asc() for k, (_, down) in zip(keys, q.order, strict=True)])
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.select(*names)

    def run(self, q: Query) -> DataFrame:
        if q.form == "ASK":
            return self.group(q.where).limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
        return self.select(q)


def query(graph: EntityGraph | TripleGraph, text: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Runs a query text over a graph."""
    return Compiler(graph).run(parse(text, prefixes))
