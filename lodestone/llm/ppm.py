"""Language identification by partial matching: byte context trees with escapes.

Each language has the counts of a variable-order byte context tree (orders 0 to ORDER).
With the statistics frozen, the code length of a byte in a context is exact: a byte seen
in the context costs -log2(c / (n + d)), else the escape -log2(d / (n + d)) is paid and
the next shorter context decides, down to a uniform byte. The language whose tree codes
a text in the fewest bits is predicted.

The trees of all languages share one table a context length, keyed by the packed bytes,
so one look-up gives the code lengths for every language at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import sampled_rows

#: Longest context in bytes (a context and its byte are packed into 64 bits: 7 at most).
ORDER = 4
#: Labelled rows a language that the trees are fitted on (the expected size of a sample).
ROWS_A_LABEL = 700
LETTER = re.compile(r"[^\W\d_]")
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class KeyTable:
    """Open-addressed table from 64-bit keys to their row numbers, filled once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        size = 1 << self.bits
        self.keys, self.rows = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            slots, first = np.unique(at[left], return_index=True)
            free = self.rows[slots] < 0
            won = left[first[free]]
            self.rows[at[won]], self.keys[at[won]] = won, keys[won]
            left = left[np.isin(left, won, assume_unique=True, invert=True)]
            at[left] = (at[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 where there is none."""
        at = self._slot(keys)
        got = self.rows[at]
        wrong = np.flatnonzero((got >= 0) & (self.keys[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.rows) - 1)
            now = self.rows[at[wrong]]
            got[wrong] = now
            wrong = wrong[(now >= 0) & (self.keys[at[wrong]] != keys[wrong])]
        return got


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n-byte strings that end at positions n-1, n, ... of `data`, packed."""
    out = np.zeros(max(0, len(data) - n + 1), np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | data[k : len(data) - n + 1 + k].astype(np.uint64)
    return out


def _bytes(text: str) -> bytes:
    """What the trees read of a text: ORDER line ends, then its lower-cased UTF-8."""
    return b"\n" * ORDER + text.lower().encode("utf-8", "surrogatepass")


class ContextTrees:
    """Frozen code lengths of every language. fit() builds them, bits() applies them."""

    def __init__(self, langs: list[str], costs: list[np.ndarray], keys: list[np.ndarray], escapes: list[np.ndarray], contexts: list[np.ndarray]):
        self.langs, self.costs, self.escapes = langs, costs, escapes
        self.keys, self.contexts = keys, contexts
        self._tables: list | None = None

    @classmethod
    def fit(cls, samples: dict[str, list[str]]) -> ContextTrees:
        langs = sorted(samples)
        starts = {}
        for lang in langs:
            texts = [np.frombuffer(_bytes(t), np.uint8) for t in samples[lang]]
            starts[lang] = texts
        costs, keys, escapes, contexts = [], [], [], []
        lower = np.full((256, len(langs)), 8.0)  # order -1: a uniform byte
        lower_keys = np.arange(256, dtype=np.uint64)
        for order in range(ORDER + 1):
            seen = []
            for lang in langs:
                # every byte of the text proper, whatever the order: the line ends give the first ones a context
                each = [_grams(t[ORDER - order :], order + 1) for t in starts[lang]]
                seen.append(np.unique(np.concatenate(each) if each else np.zeros(0, np.uint64), return_counts=True))
            gram = np.unique(np.concatenate([s[0] for s in seen])) if seen else np.zeros(0, np.uint64)
            ctx_of = gram >> np.uint64(8)
            ctx, where = np.unique(ctx_of, return_inverse=True)
            cost, esc = np.zeros((len(gram), len(langs))), np.zeros((len(ctx), len(langs)))
            suffix = gram & np.uint64((1 << (8 * max(order, 1))) - 1)
            back = lower[np.searchsorted(lower_keys, suffix)]
            for i, (own, count) in enumerate(seen):
                c = np.zeros(len(gram))
                c[np.searchsorted(gram, own)] = count
                n = np.bincount(where, c, len(ctx))
                d = np.bincount(where, c > 0, len(ctx))
                with np.errstate(divide="ignore", invalid="ignore"):
                    esc[:, i] = np.where(n > 0, -np.log2(d / (n + d)), 0.0)
                    own_bits = -np.log2(c / (n + d)[where])
                cost[:, i] = np.where(c > 0, own_bits, esc[where, i] + back[:, i])
            lower, lower_keys = cost, gram
            costs.append(cost.astype(np.float32))
            keys.append(gram)
            escapes.append(esc.astype(np.float32))
            contexts.append(ctx)
        return cls(langs, costs, keys, escapes, contexts)

    def _find(self, order: int, grams: np.ndarray) -> np.ndarray:
        if self._tables is None:
            self._tables = [(KeyTable(k), KeyTable(c)) for k, c in zip(self.keys, self.contexts, strict=True)]
        return self._tables[order][0].find(grams)

    def _byte_bits(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte after the first ORDER of `data`, by language."""
        full = _grams(data, ORDER + 1)
        out = np.zeros((len(full), len(self.langs)), np.float32)
        left = None  # all
        for order in range(ORDER, -1, -1):
            mine = full if left is None else full[left]
            if order < ORDER:
                mine = mine & np.uint64((1 << (8 * (order + 1))) - 1)
            row = self._find(order, mine)
            hit = row >= 0
            if left is None:
                out[:] = self.costs[order][np.where(hit, row, 0)]
                out[~hit] = 0
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] += self.costs[order][row[hit]]
                left = left[~hit]
            if not len(left):
                return out
            # no language has the byte here: each that knows the context pays its escape
            held = self._tables[order][1].find((full[left] & np.uint64((1 << (8 * (order + 1))) - 1)) >> np.uint64(8))
            known = held >= 0
            out[left[known]] += self.escapes[order][held[known]]
        out[left] += 8.0
        return out

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code length of each whole text under each language: (texts, languages)."""
        out = np.zeros((len(texts), len(self.langs)))
        if not texts or not self.langs:
            return out
        parts = [_bytes(t) for t in texts]
        data = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(p) for p in parts])
        start = np.cumsum(size) - size
        step = max(1 << 14, (1 << 20) // len(self.langs))  # bounds the memory of one pass, not what is read
        for a in range(0, len(data) - ORDER, step):
            bits = self._byte_bits(data[a : a + step + ORDER])  # of the bytes at a + ORDER, ...
            at = np.arange(a + ORDER, a + ORDER + len(bits))
            first, last = np.searchsorted(start, at[0], "right") - 1, np.searchsorted(start, at[-1], "right") - 1
            docs = np.arange(first, last + 1)
            # the line ends before each text are context only
            heads = (start[docs, None] + np.arange(ORDER)).ravel() - at[0]
            bits[heads[(heads >= 0) & (heads < len(bits))]] = 0
            out[docs] += np.add.reduceat(bits, np.maximum(start[docs] - at[0], 0), axis=0, dtype=np.float64)
        return out


def fit_trees(docs: DataFrame, train: F.Column, id_col: str, text_col: str, lang_col: str, per_label: int = ROWS_A_LABEL) -> ContextTrees:
    """Trees from about `per_label` rows of each language among those where `train` holds."""
    src = docs.where(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    samples: dict[str, list[str]] = {}
    for r in sorted(sampled_rows(src, "id", "lang", per_label).collect(), key=lambda r: (r["lang"], r["id"] is None, r["id"], r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return ContextTrees.fit(samples)


def identify(trees: ContextTrees, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, bits a byte) of each text; `und`, 0 and 0 without a letter or a tree."""
    ok = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if trees.langs else []
    lang, score, rate = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    if ok:
        bits = trees.bits([texts[i] for i in ok])
        best = bits.argmin(axis=1)
        least = bits.min(axis=1)
        score[ok] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
        rate[ok] = least / [max(1, len(texts[i].lower().encode("utf-8", "surrogatepass"))) for i in ok]
        for i, k in zip(ok, best, strict=True):
            lang[i] = trees.langs[k]
    return lang, score, rate


def predict_language(docs: DataFrame, trees: ContextTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score (posterior of the predicted language under
    equal priors, 0 to 1), bits_a_byte of the best tree.

    Texts that are null or have no letter get `und` and score 0; with no labelled row to
    learn from every text does. Ties go to the language first in order. Whole texts are
    read, repeated rows are each returned, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample's bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                lang, score, rate = identify(shared.value, b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], names=["id", "lang_pred", "score", "bits_a_byte"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, lang_pred string, score double, bits_a_byte double").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, trees: ContextTrees, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The input rows, all columns unchanged, whose text has a predicted language of a
    posterior of `least` or more. Rows of null or letterless texts go."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                lang, score, _ = identify(shared.value, b.column(at).to_pylist())
                yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
