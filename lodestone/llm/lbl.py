"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation.

The vocabulary is open, so a token's probability has two factors: that of its class given
the two classes before, by the neural model, and that of the token within its class, by
counts. The most frequent words and the end of text are classes of their own; other words
are classed by their last bytes. Counts and class sequences come from the whole training
corpus. The number of classes grows with the training tokens, and the model learns from every
training token: workers run through their own tokens and their models are averaged. There are
few enough contexts that one batched matrix product normalises every one of them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch

#: Classes: words of their own, the end of text, SUFFIX classes of other words; CLASSES is
#: the least number. With the cube root of the tokens beyond BASE_TOKENS the words grow.
SUFFIX, CLASSES, BASE_TOKENS = 32, 128, 1 << 20
#: Words whose counts every worker holds: at most this many, the most frequent.
HEAD = 1 << 18
DIM, NOISE, BATCH, RATE = 32, 64, 1024, 0.02
#: Rounds of training, after each of which the workers' models are averaged. A round reads
#: its own share of the training rows, in a small corpus again until LEAST_DRAWS are reached,
#: or TASK_DRAWS in a task with few.
ROUNDS, LEAST_DRAWS, TASK_DRAWS = 4, 1500 * BATCH, 128 * BATCH

#: Stands for the end of text among the words' hashes.
END = np.uint64(0x9AE16A3B2F90404F)


def _suffix(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SUFFIX


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: distinct hashes (the end last), their suffix classes, the place of every token
    among them, the first token of every text and its number of tokens (ends included).

    Words are lower-cased (A-Z) runs without ASCII white space; each distinct one is hashed once.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, text = split.flatten(), pc.list_parent_indices(split)
    real = pc.greater(pc.binary_length(flat), 0)  # white space at either end leaves an empty word
    coded, text = flat.filter(real).dictionary_encode(), text.filter(real).to_numpy()
    size = np.bincount(text, minlength=len(texts)) + 1
    start = np.cumsum(size) - size
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    distinct = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    cls = np.fromiter(map(_suffix, words), np.int16, len(words))
    place = np.full(int(size.sum()), len(words), np.int64)
    body = np.ones(len(place), bool)
    body[start + size - 1] = False
    place[body] = coded.indices.to_numpy()
    return np.append(distinct, END), np.append(cls, np.int16(-1)), place, start, size


def token_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """h, cls, c: hash, suffix class (-1: the end) and count of every token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 2500) for i in range(0, whole.num_rows, 2500)):
                h, cls, place, _, _ = _hashed(b.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(cls), pa.array(np.bincount(place, minlength=len(h)).astype(np.int64))], names=["h", "cls", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "h long, cls short, n long")
    return rows.groupBy("h").agg(F.max("cls").alias("cls"), F.sum("n").alias("c"))


@dataclass
class Head:
    """The most frequent words: hashes in order, counts, classes; and the corpus totals."""

    h: np.ndarray
    count: np.ndarray
    cls: np.ndarray
    n: int
    v: int
    #: log10 of the denominator of each class: its tokens plus half of its words and one unseen
    denominator: np.ndarray
    #: Number of words that are classes of their own; the class of the end follows them.
    own: int

    @property
    def classes(self) -> int:
        return self.own + 1 + SUFFIX


def own_words(tokens: int) -> int:
    """Words that are classes of their own in a corpus of so many tokens."""
    return int(CLASSES * max(1.0, tokens / BASE_TOKENS) ** (1 / 3)) - 1 - SUFFIX


def head_of(counts: DataFrame) -> Head:
    n, v = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n, v = int(n or 0), int(v)
    # the least power of two that at most HEAD words reach
    sizes = {int(r[0]): int(r[1]) for r in counts.groupBy(F.floor(F.log2("c")).alias("k")).count().collect()}
    cut, total = 64, 0
    while cut > 0 and total + sizes.get(cut - 1, 0) <= HEAD:
        cut -= 1
        total += sizes.get(cut, 0)
    # at most HEAD rows
    rows = counts.where(F.col("c") >= (1 << cut)).toPandas() if cut < 63 else counts.limit(0).toPandas()
    h, c = rows["h"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64)
    suffix = rows["cls"].to_numpy(np.int64)
    end = own_words(n)
    cls = np.where(suffix < 0, end, end + 1 + np.maximum(suffix, 0))
    order = np.lexsort((h, -c))
    own = order[suffix[order] >= 0][:end]
    cls[own] = np.arange(len(own))
    # tokens and words of the suffix classes, without the words that are classes of their own
    tokens, kinds = np.zeros(SUFFIX), np.zeros(SUFFIX)
    for r in counts.where(F.col("cls") >= 0).groupBy("cls").agg(F.sum("c"), F.count(F.lit(1))).collect():
        tokens[r[0]], kinds[r[0]] = r[1], r[2]
    np.subtract.at(tokens, suffix[own], c[own])
    np.subtract.at(kinds, suffix[own], 1)
    by_hash = np.argsort(h)
    denominator = np.zeros(end + 1 + SUFFIX)
    denominator[end + 1 :] = np.log10(tokens + 0.5 * (kinds + 1))
    return Head(h[by_hash], c[by_hash], cls[by_hash], n, v, denominator, end)


def encoded(docs: DataFrame, head: Head, train: Column, id_col: str, text_col: str) -> DataFrame:
    """Each text as classes, with what its frequent words contribute and its rare words.

    row (unique), id, train, n_tokens, classes (two bytes a token), head_log (sum of
    log10(c + 0.5) over frequent tokens), head_known, rest_log (the same without words that
    are classes of their own), class_log (sum of the classes' denominators), rare_h, rare_n.
    """
    shared = docs.sparkSession.sparkContext.broadcast(head)  # at most HEAD rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, at = shared.value, 0
        part = TaskContext.get().partitionId() << 40
        logs = np.log10(top.count + 0.5)
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                h, suffix, place, start, size = _hashed(b.column(2))
                k = np.minimum(np.searchsorted(top.h, h), max(0, len(top.h) - 1))
                known = top.h[k] == h if len(top.h) else np.zeros(len(h), bool)
                cls = np.where(suffix < 0, top.own, top.own + 1 + suffix)
                log = np.zeros(len(h))
                if len(top.h):
                    cls = np.where(known, top.cls[k], cls)
                    log = np.where(known, logs[k], 0.0)
                token_cls = cls[place].astype(np.uint16)
                token_log, token_known = log[place], known[place]
                sums = lambda x, start=start: np.add.reduceat(x, start)
                rare = np.flatnonzero(~token_known)
                doc = np.repeat(np.arange(len(size)), size)[rare]
                pairs, n = np.unique(np.stack([doc, place[rare]]), axis=1, return_counts=True) if len(rare) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                offsets = pa.array(np.searchsorted(pairs[0], np.arange(len(size) + 1)).astype(np.int32))
                raw = token_cls.tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array(part + at + np.arange(len(size))), b.column(0), b.column(1), pa.array(size),
                    pa.array([raw[2 * a : 2 * (a + m)] for a, m in zip(start.tolist(), size.tolist(), strict=True)], pa.binary()),
                    pa.array(sums(token_log)), pa.array(sums(token_known.astype(np.int64))), pa.array(sums(np.where(token_cls > top.own, token_log, 0.0))),
                    pa.array(sums(top.denominator[token_cls])),
                    pa.ListArray.from_arrays(offsets, pa.array(h[pairs[1]].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int64))),
                ], names=["row", "id", "train", "n_tokens", "classes", "head_log", "head_known", "rest_log", "class_log", "rare_h", "rare_n"])
                at += len(size)

    src = docs.select(F.col(id_col).cast("long").alias("id"), train.alias("train"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "row long, id long, train boolean, n_tokens long, classes binary, head_log double, head_known long, rest_log double, class_log double, rare_h array<bigint>, rare_n array<bigint>")


def sequences(parts: list[bytes], classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class before last, last class and class of every token of the texts, in order."""
    lead = np.array([classes, classes], np.uint16).tobytes()  # the context before a text
    flat = np.frombuffer(b"".join(lead + p for p in parts), np.uint16).astype(np.int64)
    real = flat[2:] < classes
    return flat[:-2][real], flat[1:-1][real], flat[2:][real]


def unigrams(head: Head) -> np.ndarray:
    """Tokens of every class."""
    out = np.zeros(head.classes)
    np.add.at(out, head.cls[head.cls <= head.own], head.count[head.cls <= head.own])
    out[head.own + 1 :] = 10.0 ** head.denominator[head.own + 1 :]
    return out


class Adam:
    """Steps of a model's parameters by running means of gradients and their squares.

    Parameters and gradients are one vector each, of which the model's arrays (float32 from
    here on) and `gradients` are views: a step is a few passes over a vector.
    """

    def __init__(self, model: LogBilinear):
        self.x = np.concatenate([p.ravel() for p in model.params()]).astype(np.float32)
        self.mean, self.square, self.g, self.work = (np.zeros_like(self.x) for _ in range(4))
        self.t, shapes = 0, [p.shape for p in model.params()]
        ends = np.cumsum([math.prod(s) for s in shapes])[:-1]
        model.r, first, second, model.q, model.b = (p.reshape(s) for p, s in zip(np.split(self.x, ends), shapes, strict=True))
        model.mix = [first, second]
        self.gradients = [p.reshape(s) for p, s in zip(np.split(self.g, ends), shapes, strict=True)]

    def step(self, rate: float) -> None:
        """By what `gradients` hold, which is lost."""
        # the means lack their factors 0.1 and 0.001, which are taken into the rate
        self.t += 1
        g, a, v, work = self.g, self.mean, self.square, self.work
        a *= 0.9
        a += g
        g *= g
        v *= 0.999
        v += g
        scale = (0.001 / (1 - 0.999**self.t)) ** 0.5
        np.sqrt(v, out=work)
        work += 1e-9 / scale
        np.divide(a, work, out=work)
        work *= rate * 0.1 / (1 - 0.9**self.t) / scale
        self.x -= work


def _add(out: np.ndarray, places: np.ndarray, rows: np.ndarray) -> None:
    """Adds the rows to `out` at their places. Both count pairs of numbers, and a complex number
    is added as its two parts are: that halves the places."""
    np.add.at(out.reshape(-1).view(np.complex64), places.reshape(-1), rows.reshape(-1).view(np.complex64))


@dataclass
class LogBilinear:
    """Context vectors r, a mixing matrix a position, target vectors q and biases b."""

    r: np.ndarray
    mix: list[np.ndarray]
    q: np.ndarray
    b: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray, seed: int = 3) -> LogBilinear:
        rng = np.random.default_rng(seed)
        classes, share = len(unigram), (unigram + 0.5) / (unigram + 0.5).sum()
        return cls(rng.normal(0, 0.1, (classes + 1, DIM)), [np.eye(DIM) * 0.5, np.eye(DIM) * 0.7], rng.normal(0, 0.1, (classes, DIM)), np.log(share))

    @classmethod
    def fit(cls, cells: np.ndarray, counts: np.ndarray, seed: int = 3, steps: int = 1500, classes: int = CLASSES) -> LogBilinear:
        """A model of class sequences (numbered as cells of a cube) drawn by their counts."""
        unigram = np.bincount(cells % classes, counts, classes)
        m = cls.start(unigram, seed)
        if len(cells):
            rng = np.random.default_rng(seed)
            pick = np.searchsorted(np.cumsum(counts), rng.integers(0, counts.sum(), steps * BATCH), "right")
            ctx = cells[pick] // classes
            m.learn(Adam(m), ctx // (classes + 1), ctx % (classes + 1), cells[pick] % classes, unigram, rng, 0.0, 1.0)
        return m

    def params(self) -> list[np.ndarray]:
        return [self.r, self.mix[0], self.mix[1], self.q, self.b]

    def learn(self, adam: Adam, first: np.ndarray, second: np.ndarray, target: np.ndarray, unigram: np.ndarray, rng: np.random.Generator, begin: float, end: float) -> None:
        """Noise-contrastive estimation, one pass over the class sequences given in batches of
        BATCH; noise comes from the classes' frequencies. `begin` and `end` place the pass in
        the whole training, on which the rate depends."""
        share = (unigram + 0.5) / (unigram + 0.5).sum()
        noise_cum, against = np.cumsum(share), (np.log(share) + np.log(NOISE)).astype(np.float32)
        g_r, g_first, g_second, g_q, g_b = adam.gradients
        places = np.arange(self.r.size // 2).reshape(len(self.r), -1)
        h_i, h_j = np.empty_like(g_r), np.empty_like(g_r)
        order = rng.permutation(len(target))
        first, second, target = first[order], second[order], target[order]
        for k in range(0, len(order), BATCH):
            i, j, w = first[k : k + BATCH], second[k : k + BATCH], target[k : k + BATCH]
            noise = np.minimum(np.searchsorted(noise_cum, rng.random(NOISE)), len(share) - 1)
            # every class is multiplied once, not every token
            hidden = (self.r @ self.mix[0]).take(i, axis=0)
            hidden += (self.r @ self.mix[1]).take(j, axis=0)
            q_w, q_n, bias = self.q.take(w, axis=0), self.q[noise], against - self.b
            # minus the log-odds of data against NOISE draws of noise, scores taken as normalised
            s_w = bias[w] - np.einsum("ij,ij->i", hidden, q_w)
            s_n = hidden @ -q_n.T
            s_n += bias[noise]
            g_w = (1 / (1 + np.exp(np.clip(s_w, -30, 30))) - 1) / np.float32(len(w))
            # 1 / (1 + exp) in place; exp of less than -30 adds nothing to 1
            np.minimum(s_n, 30, out=s_n)
            np.exp(s_n, out=s_n)
            s_n += 1
            g_n = np.divide(np.float32(1 / len(w)), s_n, out=s_n)
            g_q[:] = h_i[:] = h_j[:] = 0
            _add(g_q, places.take(noise, axis=0), g_n.T @ hidden)
            hidden *= g_w[:, None]
            _add(g_q, places.take(w, axis=0), hidden)
            g_b[:] = np.bincount(w, g_w, len(g_b)) + np.bincount(noise, g_n.sum(axis=0), len(g_b))
            g_h = g_n @ q_n
            g_h += g_w[:, None] * q_w
            # of each class as the first and as the second of the context
            _add(h_i, places.take(i, axis=0), g_h)
            _add(h_j, places.take(j, axis=0), g_h)
            np.matmul(h_i, self.mix[0].T, out=g_r)
            g_r += h_j @ self.mix[1].T
            np.matmul(self.r.T, h_i, out=g_first)
            np.matmul(self.r.T, h_j, out=g_second)
            done = begin + (end - begin) * k / len(order)
            adam.step(RATE * min(1.0, 2 * (1 - done) + 1e-3))

    def log_normalisers(self) -> np.ndarray:
        """Of every context, what its scores exceed log probabilities by, (side, side)."""
        a, b = (self.r @ self.mix[0]).astype(np.float32), (self.r @ self.mix[1]).astype(np.float32)
        out = np.empty((len(a), len(b)), np.float32)
        for k, x in enumerate(a):
            s = (x + b) @ self.q.T.astype(np.float32) + self.b.astype(np.float32)
            top = s.max(axis=1)
            out[k] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        return out

    def log10_probabilities(self) -> np.ndarray:
        """log10 P(class | two classes before), (side, side, classes): exactly normalised."""
        a, b = self.r @ self.mix[0], self.r @ self.mix[1]
        out = np.empty((len(a), len(b), len(self.q)), np.float32)
        for k, x in enumerate(a):
            s = (x + b) @ self.q.T + self.b
            s -= s.max(axis=1, keepdims=True)
            s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
            out[k] = s / np.log(10)
        return out


def trained(rows: DataFrame, head: Head) -> tuple[LogBilinear, int]:
    """The model after ROUNDS rounds over `rows`, and the training tokens it learned from.

    In a round every task starts from the same model, runs over its share of rows and
    returns its parameters; their mean by tokens is the next round's model. Together the
    rounds draw every token once, or a multiple where a corpus or a task has few.
    """
    unigram = unigrams(head)
    model, drawn = LogBilinear.start(unigram), 0
    passes = max(1, -(-LEAST_DRAWS // max(1, head.n)))
    for k in range(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast((model, unigram))

        def run(batches: Iterator[pa.RecordBatch], k: int = k, shared=shared) -> Iterator[pa.RecordBatch]:
            m, unigram = shared.value
            m = LogBilinear(m.r.copy(), [x.copy() for x in m.mix], m.q.copy(), m.b.copy())
            adam, n, rng = Adam(m), 0, np.random.default_rng((k, TaskContext.get().partitionId()))
            for b in (whole.slice(i, 2500) for whole in batches for i in range(0, whole.num_rows, 2500)):
                parts = b.column(0).to_pylist()
                if parts:
                    found = sequences(parts, len(unigram))
                    again = passes if n else max(passes, -(-TASK_DRAWS // len(found[2])))
                    for x in range(again):
                        m.learn(adam, *found, unigram, rng, (k + x / again) / ROUNDS, (k + (x + 1) / again) / ROUNDS)
                    n += len(found[2])
            if n:
                flat = adam.x.astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat * n), pa.array(np.full(len(flat), n))], names=["i", "x", "n"])

        part = rows.where(F.pmod(F.xxhash64("row"), F.lit(ROUNDS)) == k).select("classes")
        # a model's parameters, added up over tasks: rows by number of parameters, not by text
        mean = part.mapInArrow(run, "i long, x double, n long").groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas().sort_values("i")
        if len(mean):
            flat, at, out = (mean["x"] / mean["n"]).to_numpy(), 0, []
            for p in model.params():
                out.append(flat[at : at + p.size].reshape(p.shape))
                at += p.size
            model, drawn = LogBilinear(out[0], out[1:3], out[3], out[4]), drawn + int(mean["n"].iloc[0])
        shared.unpersist()
    return model, drawn


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, train, n_tokens, n_known, train_tokens, base_score (smoothed
    unigram), score (the model's log10 probability of the whole text).

    Learns from the rows where `train` holds (null: it doesn't). Null and empty texts are one
    end of text. Repeated rows are each learned from and returned. An empty table gives an
    empty result; without training tokens both scores are 0 a token. Columns other than
    those named are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lbl")
    train = F.coalesce(train, F.lit(False))
    counts = scratch.save(token_counts(docs.where(train), text_col), "counts")
    head = head_of(counts)
    rows = scratch.save(encoded(docs, head, train, id_col, text_col), "rows")
    model, _ = trained(rows.where("train"), head)
    # as many numbers as there are contexts and parameters
    shared = spark.sparkContext.broadcast((model, model.log_normalisers()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, log_z = shared.value
        left, right = (m.r @ m.mix[0]).astype(np.float32), (m.r @ m.mix[1]).astype(np.float32)
        q, bias = m.q.astype(np.float32), m.b.astype(np.float32)
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                parts = b.column(1).to_pylist()
                i, j, w = sequences(parts, len(q))
                p = np.empty(len(w), np.float32)
                for a in range(0, len(w), 1 << 16):
                    x, y, z = i[a : a + (1 << 16)], j[a : a + (1 << 16)], w[a : a + (1 << 16)]
                    p[a : a + (1 << 16)] = np.einsum("ij,ij->i", left[x] + right[y], q[z]) + bias[z] - log_z[x, y]
                size = np.array([len(x) // 2 for x in parts])
                total = np.add.reduceat(p, np.cumsum(size) - size, dtype=np.float64) / np.log(10)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total)], names=["row", "class_score"])

    # rare words: their counts are joined, one row a text and word
    rare = rows.where(F.size("rare_h") > 0).select("row", F.inline(F.arrays_zip("rare_h", "rare_n"))).select("row", F.col("rare_h").alias("h"), F.col("rare_n").alias("k"))
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(counts.select("h", "c"), "h", "left").groupBy("row").agg(F.sum(F.col("k") * F.log10(c + 0.5)).alias("rare_log"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("rare_known"))
    scored = rows.select("row", "classes").mapInArrow(run, "row long, class_score double")
    light = rows.drop("classes", "rare_h", "rare_n")
    out = light.join(scored, "row").join(rare, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    base = F.col("head_log") + rare_log - F.col("n_tokens") * F.log10(F.lit(head.n + 0.5 * (head.v + 1)))
    score = F.col("class_score") + F.col("rest_log") + rare_log - F.col("class_log")
    if not head.n:
        base = score = F.lit(0.0)
    return out.select(
        F.col("id").alias(id_col), "train", "n_tokens", (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(head.n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
    )
