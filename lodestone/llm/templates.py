"""Line deduplication by a log-template tree.

Lines are parsed by a tree of fixed depth: first by their number of tokens, then by their
leading tokens, where a token with a digit counts as a variable field. A leaf holds lines
that may come from one template. Within a leaf a word may be constant at a position where
it recurs in several documents; other positions are variable fields. A line's template is
the most frequent of its constant words, as few as a template needs, with their positions.
A template that several documents share is recurring: of all its lines, those of one
document stay (equal ones once), so that no content is lost, and every other goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch

#: Leading tokens that the tree branches on below the number of tokens.
DEPTH = 3
#: Documents (of different text) that a template needs. Short lines coincide by chance:
#: from LONG tokens on MIN_DOCS are enough, below SHORT_DOCS. PASSAGE tokens don't repeat
#: by chance: PASSAGE_DOCS are enough.
LONG, MIN_DOCS, SHORT_DOCS = 8, 3, 20
PASSAGE, PASSAGE_DOCS = 50, 2
#: Percent of a line's positions that must be constant words.
CONSTANT_PCT = 80
#: A leaf may hold a large part of all lines: it is dealt to so many tasks.
SALTS = 16

FIELD = "<*>"


def _key(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


def _masked(line: Column) -> Column:
    """The line's tokens joined by one space, those with a digit as FIELD.

    Most lines need neither step, so each is tested for what the step would change.
    """
    other = F.lit(False)
    for c in ("\t", "\x0b", "\f", "\r", "  "):
        other = other | F.contains(line, F.lit(c))
    spaced = F.trim(F.when(other, F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " ")).otherwise(line))
    return F.when(spaced.rlike("[0-9]"), F.regexp_replace(spaced, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(spaced)


def _needed(n: Column) -> Column:
    return F.when(n >= PASSAGE, F.lit(PASSAGE_DOCS)).when(n >= LONG, F.lit(MIN_DOCS)).otherwise(F.lit(SHORT_DOCS))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull()).select(_key(F.col("text")).alias("key"), "text")


def _lines(docs: DataFrame, text_col: str) -> DataFrame:
    """key, pos, n (tokens), leaf, body (hash of the masked line) of every line with a token."""
    rows = _texts(docs, text_col).select("key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # a filter by n would be pushed below the masking, and work that out once more for each mention
    rows = rows.where(F.col("line").rlike("[^\\x20\\x09-\\x0D]")).select("key", "pos", _masked(F.col("line")).alias("m"))
    rows = rows.withColumn("n", F.octet_length("m") - F.octet_length(F.replace("m", F.lit(" "), F.lit(""))) + 1)
    return rows.select("key", "pos", "n", F.xxhash64("n", F.substring_index("m", " ", DEPTH)).alias("leaf"), F.xxhash64("n", "m").alias("body"))


def recurring_lines(docs: DataFrame, scratch: Scratch, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(templates, places).

    templates: leaf, template (hash of the constant words and their positions), n_docs
    (documents of different text with a line of it), first (the least key of these) for
    every recurring template. places: key, pos, leaf, body, first of every line of one,
    repeated for copies of a text.
    """
    where = scratch.save(_lines(docs, text_col), "where")  # repeated for copies of a text
    # pairs (leaf, document), each once, so that the counts are counts of documents
    support = where.select("leaf", "n", "key").distinct().groupBy("leaf", "n").agg(F.count(F.lit(1)).alias("s")).where(F.col("s") >= _needed(F.col("n")))
    salts = F.explode(F.array(*(F.lit(i) for i in range(SALTS))))
    support = scratch.save(support.select("leaf", salts.alias("salt")), "support")
    salted = where.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    # here and below merged: the files' sizes, by which Spark would choose to broadcast, say
    # little of what the driver would hold (a leaf's rows compress to a byte each)
    once = salted.join(support.hint("merge"), ["leaf", "salt"], "left_semi").groupBy("leaf", "body", "key").agg(F.min("pos").alias("pos"), F.first("n").alias("n"))
    weight = once.groupBy("leaf", "body").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("key", "pos")).alias("at"), F.first("n").alias("n"))
    weight = scratch.save(weight, "weight")
    # the tokens of every distinct line of the leaves in question, from one text that has it
    wanted = weight.select("leaf", "body", "n", "n_docs", F.col("at.key").alias("key"), F.col("at.pos").alias("pos"))
    held = wanted.groupBy("key").agg(F.collect_list(F.struct("leaf", "body", "n", "n_docs", "pos")).alias("found"))  # at most a text's lines
    texts = _texts(docs, text_col).join(held.hint("merge"), "key").dropDuplicates(["key"]).withColumn("lines", F.split("text", "\n"))
    distinct = texts.select("lines", F.explode("found").alias("f")).select("f.leaf", "f.body", "f.n", "f.n_docs", F.split(_masked(F.get("lines", F.col("f.pos"))), " ").alias("tokens"))
    distinct = scratch.save(distinct, "distinct")
    each = distinct.select("leaf", "body", "n", "n_docs", F.posexplode("tokens").alias("p", "token"))
    each = each.where(F.col("token") != FIELD)
    constant = each.groupBy("leaf", "n", "p", "token").agg(F.sum("n_docs").alias("s")).where(F.col("s") >= _needed(F.col("n"))).select("leaf", "p", "token", "s")
    constant = scratch.save(constant, "constant")  # written, so that the join below can split a frequent word
    # a line's constant words, the most frequent first; of these, as few as a template needs
    least = F.ceil(F.col("n") * CONSTANT_PCT / 100).cast("int")
    marked = each.join(constant.hint("merge"), ["leaf", "p", "token"]).groupBy("leaf", "body", "n").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "p", "token"))).alias("words")).where(F.size("words") >= least)
    chosen = F.array_sort(F.transform(F.slice("words", F.lit(1), least), lambda x: F.struct(x["p"].alias("p"), x["token"].alias("token"))))
    of_line = scratch.save(marked.select("leaf", "body", F.xxhash64(chosen).alias("template")), "of_line")
    # rows of copies repeat here; made distinct only after the join, which can split a frequent line
    lines = scratch.save(where.join(of_line.hint("merge"), ["leaf", "body"]).select("key", "pos", "n", "leaf", "body", "template"), "lines")
    counted = lines.select("leaf", "template", "n", "key").distinct().groupBy("leaf", "template", "n").agg(F.count(F.lit(1)).alias("n_docs"), F.min("key").alias("first"))
    templates = scratch.save(counted.where(F.col("n_docs") >= _needed(F.col("n"))).drop("n"), "templates")
    return templates, lines.join(templates.drop("n_docs").hint("merge"), ["leaf", "template"]).select("key", "pos", "leaf", "body", "first")


def drop_recurring_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every input row and column, with the text cleared of recurring lines, and the new
    columns n_lines and n_dropped.

    The lines of a recurring template stay in the first text by its key (the md5 of the
    text), equal lines there once, and go from all others; so a text whose lines are all
    found elsewhere may end up empty. Null texts stay null with 0 lines, the empty text has
    one (empty) line. Copies of one text count as one document and are treated alike. Lines
    without a token, or without a token free of digits, never go. Empty tables give an empty
    result. Input columns named n_lines or n_dropped are replaced.
    """
    scratch = Scratch(docs.sparkSession, "templates")
    docs = docs.drop("n_lines", "n_dropped")
    _, places = recurring_lines(docs, scratch, text_col)
    places = scratch.save(places, "places")
    others = places.where(F.col("key") != F.col("first")).select("key", "pos")
    again = places.where(F.col("key") == F.col("first")).groupBy("key", "leaf", "body").agg(F.sort_array(F.collect_set("pos")).alias("all"))
    again = again.select("key", F.explode(F.slice("all", F.lit(2), F.size("all"))).alias("pos"))
    # one row a text with such lines: at most as many positions as it has lines
    found = scratch.save(others.unionByName(again).groupBy("key").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "found")
    key, gone = "__line_key", "__line_gone"
    text = F.col(text_col).cast("string")
    rows = docs.withColumn(key, _key(text))
    out = rows.join(found.select(F.col("key").alias(key), F.col("gone").alias(gone)).hint("merge"), key, "left")
    clear = F.col(gone).isNotNull()
    left = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(F.col(gone), i)), "\n")
    out = out.withColumns({
        "n_lines": F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long"),
        "n_dropped": F.when(clear, F.size(gone)).otherwise(0).cast("long"),
        text_col: F.when(clear, left).otherwise(text),
    })
    return out.drop(key, gone)
