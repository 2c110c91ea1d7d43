"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is a fixed mask of token positions: the words under it are hashed, those between
are ignored. Seeds of all test items are joined with the seeds of every position of every
text; around each hit the two word sequences are laid over each other and compared, so
substituted words are tolerated. The masks are chosen so that NEED equal words within
WINDOW aligned ones always leave one seed whole: no such overlap is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch

#: An overlap counts if NEED of WINDOW consecutive aligned words are equal.
WINDOW, NEED = 12, 10
#: Whichever two of twelve positions differ, one of these fits between them somewhere.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 5, 6, 7), (0, 1, 2, 5, 8, 9))
#: Test sets of up to this many seed rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_SEEDS = 2_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words: runs without ASCII white space. Null: no words."""
    found = F.filter(F.split(F.translate(text, UPPER, LOWER), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def _seeds(hashes: str, n: Column, short: list[int]) -> Column:
    """(mask, pos, seed) of every position; whole short items have a mask of their length."""
    masks = [(i, m) for i, m in enumerate(MASKS)] + [(100 + k, tuple(range(k))) for k in short]

    def placed(i: int, mask: tuple[int, ...]) -> Column:
        at = F.when(n > mask[-1], F.sequence(F.lit(0), n - 1 - mask[-1])).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda p: F.struct(F.lit(i).alias("mask"), p.alias("pos"), F.xxhash64(F.lit(i), *(F.get(F.col(hashes), p + k) for k in mask)).alias("seed")))

    return F.concat(*(placed(i, m) for i, m in masks))


def find_overlaps(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(key, item_id, n_matched, first, last): each test item that overlaps a text.

    `key` is the md5 of the text, so copies are compared once. n_matched is the most equal
    words on one alignment that holds an overlap, first and last the word positions of the
    text between which they lie. Items of fewer than WINDOW words count if they occur
    whole and unchanged. Null or blank texts and items overlap nothing; a repeated item
    counts once for its id.
    """
    items = (
        bench.select(F.col(item_col).cast("long").alias("item_id"), words(F.col(item_text_col)).alias("iw"))
        .where(F.col("item_id").isNotNull() & (F.size("iw") > 0)).distinct()
        .select("item_id", "iw", F.transform("iw", lambda w: F.xxhash64(w)).alias("ih"), F.size("iw").alias("n"))
    )
    # at most WINDOW - 1 numbers
    short = sorted(r[0] for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())
    wanted = (F.col("s.mask") < 100) & (F.col("n") >= WINDOW) | (F.col("s.mask") == 100 + F.col("n"))
    seeds = items.select("item_id", "n", F.explode(_seeds("ih", F.col("n"), short)).alias("s")).where(wanted).select("item_id", F.col("s.seed").alias("seed"), F.col("s.pos").alias("item_pos"))
    if seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        seeds, items = F.broadcast(seeds), F.broadcast(items)

    texts = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull()).select(F.md5(F.col("text").cast("binary")).alias("key"), "text")
    hashed = texts.select("key", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    places = hashed.select("key", F.inline(_seeds("h", F.size("h"), short)))
    hits = places.join(seeds, "seed").select("key", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    hits = Scratch(docs.sparkSession, "decontam").save(hits, "hits")  # read twice below

    # a merge join at every size: the hits have no bound
    held = texts.join(hits.select("key").distinct().hint("merge"), "key", "left_semi").dropDuplicates(["key"]).select("key", words(F.col("text")).alias("w"))
    laid = hits.join(held, "key").join(items, "item_id")
    same = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda p: F.get("iw", p) == F.when(p + F.col("shift") >= 0, F.get("w", p + F.col("shift"))))
    laid = laid.select("key", "item_id", "shift", "n", same.alias("same"))
    steps = F.when(F.size("same") >= NEED, F.sequence(F.lit(0), F.size("same") - NEED)).otherwise(F.array().cast("array<int>"))
    close = F.exists(steps, lambda k: F.get("same", k + NEED - 1) - F.get("same", k) < WINDOW)
    laid = laid.where(F.when(F.col("n") < WINDOW, F.size("same") == F.col("n")).otherwise(close))
    best = F.max(F.struct(F.size("same").alias("m"), (F.get("same", F.lit(0)) + F.col("shift")).alias("a"), (F.element_at("same", -1) + F.col("shift")).alias("b")))
    return laid.groupBy("key", "item_id").agg(best.alias("x")).select("key", "item_id", F.col("x.m").cast("long").alias("n_matched"), F.col("x.a").cast("long").alias("first"), F.col("x.b").cast("long").alias("last"))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: id, contaminated, n_items, item_ids (ascending, comma-separated,
    empty if none), n_matched (most equal words with one item, 0 if none).

    Repeated rows are each returned; null texts are not contaminated; empty tables (of
    either kind) give an empty or an all-clean result; other columns are ignored.
    """
    found = find_overlaps(docs, bench, text_col, item_col, item_text_col)
    verdict = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda x: x.cast("string")), ",").alias("ids"), F.max("n_matched").alias("m"))
    src = docs.select(F.col(id_col).alias("id"), F.md5(F.col(text_col).cast("string").cast("binary")).alias("key"))
    out = src.join(verdict, "key", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("ids", F.lit("")).alias("item_ids"), F.coalesce("m", F.lit(0)).cast("long").alias("n_matched"),
    )
