"""Near-duplicate classes: MinHash, banding, signature check, exact check, components.

1. Each text becomes the set of its 5-word shingles (hashed to 64 bits), a signature of
   universal hash minima and one key a band. Texts of equal sets form a class at once.
2. Classes that share a band key meet at pivots: each bucket compares its members with
   one member, the one with most company over all its bands. That is one pair a member
   and bucket, however large the bucket.
3. Signatures drop clearly dissimilar pairs; the full shingle sets confirm the rest.
4. Links give components (large-star, small-star). A bucket whose members lie in one
   component is done. The members of the others meet again by their rarest shingles: of
   two similar sets, each sorted by the shingles' frequency, the beginnings share one, and
   what may follow it bounds their overlap exactly. Members of a large group whose changes
   are their own share no such beginning, so the group's pairs are not made. While buckets
   are very mixed, further pivots come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch
from lodestone.llm.components import connected_components

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A pair of similarity 0.75 shares no band with probability (1 - 0.75^5)^40 = 2e-5.
BANDS, ROWS = 40, 5
#: Signatures agreeing in fewer than this share are dropped: nearly five standard
#: deviations below 0.75 for BANDS * ROWS minima, which a link fails with less than 2e-6.
LEAST_AGREEMENT = 0.60
#: A further pivot is taken while the pairs left across components exceed this many a member.
PAIRS_A_MEMBER = 2000
MAX_PIVOTS = 8

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_MIX = _constants(SHINGLE, 11)
_A = _constants(BANDS * ROWS, 12)
_B = _constants(BANDS * ROWS, 13)
_BAND = _constants(ROWS, 14)


def _finish(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    Lower-cases A-Z; words are runs without ASCII white space. A text of fewer than
    SHINGLE words has one shingle, the whole sequence; without words it has none.
    """
    if not text:
        return np.zeros(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < SHINGLE:  # the length takes part, so a short text never equals a window
        return _finish((h * _MIX[: len(h)]).sum(dtype=np.uint64, keepdims=True) + _GOLD * np.array([len(h)], np.uint64))
    n = len(h) - SHINGLE + 1
    out = h[:n] * _MIX[0]
    for k in range(1, SHINGLE):
        out += h[k : k + n] * _MIX[k]
    return np.unique(_finish(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of (a x + b) mod 2^64, upper 32 bits, over the whole set."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):  # bounds memory; every shingle takes part
        part = np.multiply.outer(_A, shingles[i : i + 1024])
        part += _B[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    return _finish((rows * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, digest of the set, signature (16 bits a minimum), band keys."""
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def one(text: str | None) -> tuple:
        s = shingle_set(text)
        if not len(s):
            return 0, None, None, None
        sig = signature(s)
        return len(s), xxhash.xxh3_128_digest(s.tobytes()), sig.astype(np.uint16).tobytes(), band_keys(sig)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                n, digest, sig, bands = zip(*map(one, b.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, n_shingles long, digest binary, sig binary, bands array<bigint>")


def _agreeing(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures (sig_a, sig_b) agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sigs = [np.frombuffer(b"".join(x.column(i).to_pylist()), np.uint16).reshape(-1, BANDS * ROWS) for i in (2, 3)]
            keep = (sigs[0] == sigs[1]).mean(axis=1) >= LEAST_AGREEMENT
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full shingle sets (of text_a, text_b) are similar enough."""

    def alike(x: str, y: str, kept) -> bool:
        s, t = kept(x), kept(y)
        if not len(s) or not len(t):
            return False
        both = len(np.intersect1d(s, t, assume_unique=True))
        return 100 * both >= PERCENT * (len(s) + len(t) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = lru_cache(2000)(shingle_set)  # a pivot's or a group's texts come again and again
        for x in batches:
            keep = [alike(s, t, kept) for s, t in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidate pairs (a, b), a and b classes, that signatures and full sets confirm."""
    # merge joins throughout: none of these tables has a bound, and a hot pivot's rows can be split
    x = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")).hint("merge"), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")).hint("merge"), "b")
    near = _agreeing(x)
    y = near.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return _linked(y)


def _shingle_rows(texts: DataFrame) -> DataFrame:
    """(id, shingle) for every distinct shingle of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i, text in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                s = shingle_set(text)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i, np.int64)), pa.array(s.view(np.int64))], names=["id", "shingle"])

    return texts.select("id", "text").mapInArrow(run, "id long, shingle long")


def _across(members: DataFrame, texts: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """Pairs (a, b) of members (id, n_shingles, component) in different components whose
    similarity is not ruled out by their rarest shingles; no similar pair is missed.

    All sets are sorted alike, by the shingles' frequency among the members. Sets that
    overlap enough share a shingle in their beginnings, and from the first shared one on
    both are long enough to hold the whole overlap. At a shingle only members outside its
    most frequent component look for partners.
    """
    rows = scratch.save(_shingle_rows(texts.join(members.select("id").hint("merge"), "id", "left_semi")), f"shingles{tag}")
    # shingles of a single member can't be shared: they only count, as the first in order
    common = scratch.save(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), f"common{tag}")
    ranked = rows.join(common.hint("merge"), "shingle").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("s"))  # one text's shingles
    own = F.col("n_shingles") - F.size("s")
    begin = F.col("n_shingles") - F.floor((PERCENT * F.col("n_shingles") + 99) / 100) + 1
    head = F.slice("s", F.lit(1), F.greatest(begin - own, F.lit(0)).cast("int"))
    heads = ranked.join(members, "id").withColumn("own", own).select("id", "component", F.col("n_shingles").alias("n"), "own", F.posexplode(head).alias("at", "x"))
    heads = scratch.save(heads.select("id", "component", F.col("x.shingle").alias("shingle"), "n", (F.col("n") - F.col("own") - F.col("at")).alias("rest")), f"heads{tag}")
    parts = heads.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("shingle").agg(F.max_by("component", "c").alias("most"), F.count(F.lit(1)).alias("parts"))
    mixed = scratch.save(heads.join(parts.where(F.col("parts") > 1).select("shingle", "most"), "shingle"), f"mixed{tag}")
    one, two = (mixed.select(F.col("shingle").alias(f"s_{k}"), F.col("id").alias(k), F.col("component").alias(f"c_{k}"), F.col("n").alias(f"n_{k}"), F.col("rest").alias(f"rest_{k}"), F.col("most").alias(f"m_{k}")) for k in "ab")
    alike = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    enough = (100 + PERCENT) * F.least("rest_a", "rest_b") >= PERCENT * (F.col("n_a") + F.col("n_b"))
    pairs = one.where(F.col("c_a") != F.col("m_a")).join(two.hint("merge"), (F.col("s_a") == F.col("s_b")) & (F.col("c_a") != F.col("c_b")) & alike & enough)
    return pairs.select("a", "b")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id reachable over links,
    itself included), kept (id = component_id).

    Null, empty and blank texts have 0 shingles and no links. Rows with a null id are no
    nodes: they are returned with a null component and kept false. Ids are taken to be
    unique; the rows of an id that repeats share the least component of any of them. Empty
    tables give an empty result. Columns other than the two named are ignored.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    prints = scratch.save(fingerprints(docs, id_col, text_col), "prints")
    real = prints.where(F.col("digest").isNotNull() & F.col("id").isNotNull())

    # Classes of equal sets. The least id stands for a class; only classes of several rows are joined back.
    classes = real.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    classes = scratch.save(classes.select("digest", "rep"), "classes")  # written, so that the join below can split a large class
    copies = scratch.save(real.select("id", "digest").join(classes, "digest").select("id", "rep"), "copies")
    followers = copies.where(F.col("id") != F.col("rep")).select("id").distinct()
    reps = real.join(followers, "id", "left_anti")

    keys = reps.select("id", F.explode("bands").alias("bucket"))
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = scratch.save(keys.join(sizes, "bucket"), "members")
    company = scratch.save(members.groupBy("id").agg(F.sum("n").alias("company")), "company")
    light = real.select("id", "n_shingles").join(company, "id").dropDuplicates(["id"])
    # what is left to compare: members of each bucket with their company and component
    left = scratch.save(members.select("bucket", "id").join(light, "id").withColumn("component", F.col("id")), "left0")
    near = company.select("id")
    sigs = scratch.save(real.select("id", "sig").join(near, "id", "left_semi").dropDuplicates(["id"]), "sigs")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = scratch.save(texts.join(near.hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "texts")
    scratch.drop("members")

    component = real.select("id", F.col("id").alias("component")).where(F.lit(False))
    for turn in range(MAX_PIVOTS + 1):
        groups = left.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
        groups = groups.groupBy("bucket").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        rows, pairs_left = groups.agg(F.sum("s"), F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()
        if not pairs_left:
            break
        last = turn == MAX_PIVOTS or turn > 0 and pairs_left <= PAIRS_A_MEMBER * rows
        if last:
            pairs = _across(left.select("id", "n_shingles", "component").distinct(), texts, scratch, str(turn))
        else:
            pivot = left.groupBy("bucket").agg(F.max(F.struct("company", -F.col("id"), "component")).alias("p"))
            pivot = scratch.save(pivot.select("bucket", (-F.col("p.col2")).alias("b"), F.col("p.component").alias("other")), f"pivot{turn}")
            pairs = left.join(pivot, "bucket").where(F.col("component") != F.col("other")).select(F.col("id").alias("a"), "b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = scratch.save(_confirmed(pairs, sigs, texts), f"found{turn}")
        # the components so far stand for their links
        links = component.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
        component = connected_components(links, scratch, f"cc{turn}_")
        if last:
            break
        # pivots have met every other component of their bucket; buckets of one component are done
        now = left.drop("component").join(pivot.select("bucket", F.col("b").alias("done")), "bucket").where(F.col("id") != F.col("done")).drop("done")
        now = scratch.save(now.join(component, "id", "left").withColumn("component", F.coalesce("component", "id")), f"now{turn}")
        mixed = now.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where(F.col("lo") != F.col("hi")).select("bucket")
        left = scratch.save(now.join(mixed, "bucket", "left_semi"), f"left{turn + 1}")
        scratch.drop(f"now{turn}", f"left{turn}")
    scratch.drop("texts", "sigs")

    # id -> class -> component
    member = copies.join(component, copies.rep == component.id, "left").select(copies.id, F.coalesce("component", "rep").alias("component")).groupBy("id").agg(F.min("component").alias("component"))
    alone = component.join(member.select("id"), "id", "left_anti")
    final = member.unionByName(alone).select(F.col("id").alias("node"), "component")
    out = prints.select("id", "n_shingles").join(final, F.col("id") == F.col("node"), "left")
    least = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", least.alias("component_id"), F.coalesce(F.col("id") == least, F.lit(False)).alias("kept"))
