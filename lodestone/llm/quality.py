"""Quality rules whose cutoffs follow the data: quantile sketches per language and source.

Counts are taken from whole texts. Each (language, source) group gets one mergeable KLL
sketch per measure; the sketches merge up to languages and to the corpus, towards which
the quantiles of small groups are drawn. A joined filter then compares every row with the
fence that its group's quantiles and its own length give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Accuracy parameter of the sketches (rank error under 0.7 % at 400).
SKETCH_K = 400
#: A group's quantiles count with its number of rows, its language's with so many more, and
#: a language's likewise against the corpus.
PRIOR_ROWS = 200
#: Width of the outer fence, in interquartile ranges plus the chance spread of one text.
FENCE = 3.0
#: For each measure the count it divides by, and the size of the smallest event: a short run of
#: symbols, one line, a line of ten words and its repeat. None: a mean, whose chance spread
#: follows from its level alone.
MEASURES = {"symbol_share": ("word_chars", 4), "dup_line_share": ("n_lines", 1), "repeat_share": ("n_words", 20), "chars_a_word": ("n_words", None)}


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Number of positions covered by 3-word windows found twice or more; `ids` numbers
    the words of one text from 0 to `distinct` - 1."""
    if len(ids) < 4:
        return 0
    ids = ids.astype(np.int64)
    pair = ids[:-1] * distinct + ids[1:]
    if distinct >= 1 << 20:  # keep the triple's number inside 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    triple = pair[:-1] * distinct + ids[2:]
    order = np.argsort(triple, kind="stable")
    same = triple[order[1:]] == triple[order[:-1]]
    found = np.zeros(len(triple), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(found)] |= found
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word).

    Words are runs without ASCII white space; null and empty texts count 0 throughout.
    """
    if not text:
        return 0, 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    return (len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(ids, len(seen)), len(lines))


def measured(docs: DataFrame, id_col: str, text_col: str, keys: list[str]) -> DataFrame:
    """id, keys and the counts of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([text_counts(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, 6)
            cols = [b.column(0), *(b.column(2 + i) for i in range(len(keys))), *(pa.array(found[:, i]) for i in range(6))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", *(f"key{i}" for i in range(len(keys))), *COUNTS, "n_lines"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(k).cast("string").alias(f"key{i}") for i, k in enumerate(keys)))
    return src.mapInArrow(run, ", ".join(["id long", *(f"key{i} string" for i in range(len(keys))), *(f"{c} long" for c in (*COUNTS, "n_lines"))]))


def _measures() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "chars_a_word": share("word_chars", "n_words")}


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """One row per input row: id, the five counts, base_failed, kept, each measure's limit.

    base_failed: fewer than `min_words` words, or more than `max_repeat_pct` percent of
    the words in repeated 3-word windows. The rows that pass are sketched; a row is kept
    if it passes and none of its measures lies beyond its fence: the group's third quartile
    plus FENCE times (the interquartile range + chance spread); characters a word also not
    below the first quartile by as much. The chance spread of a share r over n units with
    events of size u is sqrt((r + u / m) u / n), m the group's median of n, so that a single
    event in a typical text is no outlier where most texts have none.

    Null and empty texts have 0 counts and fail the base rule. Null languages and sources
    form groups of their own. Repeated rows count and are returned each. Empty tables
    give an empty result; where no row passes the base rule there are no limits (null).
    Equal values give quartiles without a range, and the chance spread decides. Columns
    other than the four named are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.save(measured(docs, id_col, text_col, [lang_col, source_col]), "counts")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumns(_measures())
    names = [*MEASURES, *dict.fromkeys(n for n, _ in MEASURES.values())]

    good = rows.where(~F.col("base_failed"))
    sketched = good.groupBy("key0", "key1").agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(F.col(m).cast("double"), F.lit(SKETCH_K)).alias(m) for m in names))
    groups = scratch.save(sketched.withColumn("all", F.lit(0)), "sketches")  # one row a (language, source): read three times

    def quantiles(by: str | None, tag: str) -> DataFrame:
        """n and [q1, median, q3] of every measure and count, by group."""
        df = groups if by is None else groups.groupBy(by).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in names))
        levels = [F.array(*(F.kll_sketch_get_quantile_double(F.col(m), F.lit(q)) for q in (0.25, 0.5, 0.75))).alias(f"{m}_{tag}") for m in names]
        return df.select(*(("key0", "key1", "all") if by is None else (F.col(by).alias(f"{by}_{tag}"),)), F.col("n").alias(f"n_{tag}"), *levels)

    def drawn(near: str, far: Column, n: str) -> Column:
        """Quantiles `near` of n rows, drawn towards `far`."""
        share = F.col(n) / (F.col(n) + PRIOR_ROWS)
        return F.zip_with(F.col(near), far, lambda x, y: share * x + (1 - share) * y)

    own, lang, whole = quantiles(None, "own"), quantiles("key0", "lang"), quantiles("all", "all")
    # one row a (language, source); the corpus is one row, joined by its only key
    table = own.join(lang, own["key0"].eqNullSafe(lang["key0_lang"])).join(whole, own["all"] == whole["all_all"])
    table = table.select(F.col("key0").alias("g0"), F.col("key1").alias("g1"), *(drawn(f"{m}_own", drawn(f"{m}_lang", F.col(f"{m}_all"), "n_lang"), "n_own").alias(f"{m}_q") for m in names))

    out = rows.join(table, rows["key0"].eqNullSafe(table["g0"]) & rows["key1"].eqNullSafe(table["g1"]), "left")
    over, limits = F.lit(False), []
    for m, (count, event) in MEASURES.items():
        q1, q3 = F.col(f"{m}_q")[0], F.col(f"{m}_q")[2]
        rate = q3 if event is None else q3 + event / F.greatest(F.col(f"{count}_q")[1], F.lit(1.0))
        width = FENCE * (q3 - q1 + F.sqrt(rate * (event or 1) / F.greatest(F.col(count), F.lit(1))))
        limits.append((q3 + width).alias(f"{m}_max"))
        over = over | F.coalesce(F.col(m) > q3 + width, F.lit(False))
        if event is None:
            over = over | F.coalesce(F.col(m) < q1 - width, F.lit(False))
    return out.select(F.col("id").alias(id_col), *COUNTS, "base_failed", (~F.col("base_failed") & ~over).alias("kept"), *limits)
