"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy.

Words are hashed to rows of an embedding table; filters of several widths slide over the
text, each keeps its largest response (max pooling), and a logistic layer weighs them.
Training uses a bounded sample of labelled rows. Each language gets a threshold of its
own; the score itself never sees the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import sampled_rows

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 16, (1, 2, 3)
#: Labelled rows a class that the classifier is fitted on (the expected size of a sample).
ROWS_A_CLASS = 4000
#: Share of the sample that calibrates thresholds and is not trained on.
CALIBRATE = 0.2
EPOCHS, BATCH, RATE = 6, 32, 0.01
PAD = max(WIDTHS) - 1

#: ASCII bytes other than letters and digits separate words.
_SPLIT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def word_ids(text: str | None) -> np.ndarray:
    """Embedding rows of a whole text's lower-cased words, then PAD times the empty row."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split()
    out = np.full(len(words) + PAD, BUCKETS, np.int64)
    if words:
        out[: len(words)] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) & np.uint64(BUCKETS - 1)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class TextCNN:
    """emb (BUCKETS + 1, DIM), the last row zero; filt[w] (w, DIM, FILTERS); bias[w]; out, out_bias."""

    emb: np.ndarray
    filt: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    shift: float = 0.0  # added to the logit so that 0.5 is the best threshold over all languages

    def _pooled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.emb[ids]
        best, at = [], []
        for w, filt, bias in zip(WIDTHS, self.filt, self.bias, strict=True):
            n = len(ids) - PAD
            n = max(n, 1)
            conv = sum(x[j : j + n] @ filt[j] for j in range(w)) + bias
            k = conv.argmax(axis=0)
            at.append(k)
            best.append(conv[k, np.arange(FILTERS)])
        return np.concatenate(best), np.concatenate(at)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        """Logit of each text of word rows, by table look-ups and running maxima."""
        if not texts:
            return np.zeros(0)
        if not hasattr(self, "_rows"):
            self._rows = [[(self.emb @ f[j]).astype(np.float32) for j in range(w)] for w, f in zip(WIDTHS, self.filt, strict=True)]
        flat = np.concatenate(texts)
        size = np.array([len(t) for t in texts])
        start = np.cumsum(size) - size
        pooled = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        step = 1 << 17  # bounds the memory of one pass, not what is read
        for a in range(0, len(flat), step):
            n = min(step, len(flat) - a)
            window = flat[a : a + n + PAD]
            window = np.concatenate([window, np.full(n + PAD - len(window), BUCKETS)])
            docs = np.arange(np.searchsorted(start, a, "right") - 1, np.searchsorted(start, a + n - 1, "right"))
            cut = np.maximum(start[docs] - a, 0)
            # windows that start in the padding after a text would read the next one: they take part in no maximum
            ends = (start + size)[docs, None] - 1 - np.arange(PAD) - a
            real = size[docs] > PAD
            bad = ends[real].ravel()
            for i, rows in enumerate(self._rows):
                conv = rows[0].take(window[:n], axis=0)
                for j in range(1, len(rows)):
                    conv += rows[j].take(window[j : j + n], axis=0)
                conv[bad[(bad >= 0) & (bad < n)]] = -np.inf
                top = np.maximum.reduceat(conv, cut, axis=0)
                s = slice(i * FILTERS, (i + 1) * FILTERS)
                pooled[docs, s] = np.maximum(pooled[docs, s], top)
        for i in range(len(WIDTHS)):  # a text without words has only the empty row
            pooled[size <= PAD, i * FILTERS : (i + 1) * FILTERS] = 0
        pooled += np.concatenate(self.bias).astype(np.float32)
        return np.maximum(pooled, 0) @ self.out + self.out_bias + self.shift

    @classmethod
    def fit(cls, texts: list[np.ndarray], labels: np.ndarray, prior: float, seed: int = 5) -> TextCNN:
        """Trains on the given rows; `prior` is the log-odds of label 1 in the whole table."""
        rng = np.random.default_rng(seed)
        texts = [t if len(t) > PAD else np.full(PAD + 1, BUCKETS) for t in texts]  # no word: only the empty row
        # the first coordinate starts as the smoothed log-odds that a bucket occurs in a text of label 1
        seen = np.zeros((2, BUCKETS + 1))
        for ids, y in zip(texts, labels, strict=True):
            seen[int(y), np.unique(ids)] += 1
        n = np.bincount(labels.astype(int), minlength=2).astype(float)
        odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        odds *= seen.sum(axis=0) / (seen.sum(axis=0) + 8.0)
        emb = rng.normal(0, 0.02, (BUCKETS + 1, DIM))
        emb[:, 0] = np.clip(odds, -3, 3)
        emb[BUCKETS] = 0
        filt = [rng.normal(0, 0.1, (w, DIM, FILTERS)) for w in WIDTHS]
        for f in filt:
            f[0, 0, : FILTERS // 2] += 0.5
        m = cls(emb, filt, [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, 0.1, FILTERS * len(WIDTHS)), 0.0)
        state: dict[str, list[np.ndarray]] = {}
        dense = {f"f{i}": f for i, f in enumerate(m.filt)} | {f"b{i}": b for i, b in enumerate(m.bias)} | {"out": m.out}
        t = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                grads = {k: np.zeros_like(v) for k, v in dense.items()}
                g_bias, rows, g_rows = 0.0, [], []
                part = order[lo : lo + BATCH]
                for d in part:
                    ids = texts[d]
                    best, at = m._pooled(ids)
                    act = np.maximum(best, 0)
                    err = float(_sigmoid(act @ m.out + m.out_bias) - labels[d]) / len(part)
                    grads["out"] += err * act
                    g_bias += err
                    back = err * m.out * (best > 0)
                    for i, w in enumerate(WIDTHS):
                        s = slice(i * FILTERS, (i + 1) * FILTERS)
                        g, k = back[s], at[s]
                        grads[f"b{i}"] += g
                        for j in range(w):
                            row = ids[k + j]
                            grads[f"f{i}"][j] += (m.emb[row] * g[:, None]).T
                            rows.append(row)
                            g_rows.append(g[:, None] * m.filt[i][j].T)
                t += 1
                for k, v in dense.items():
                    a = state.setdefault(k, [np.zeros_like(v), np.zeros_like(v)])
                    a[0] = 0.9 * a[0] + 0.1 * grads[k]
                    a[1] = 0.999 * a[1] + 0.001 * grads[k] ** 2
                    v -= rate * (a[0] / (1 - 0.9**t)) / (np.sqrt(a[1] / (1 - 0.999**t)) + 1e-8)
                m.out_bias -= rate * g_bias * 10
                np.add.at(m.emb, np.concatenate(rows), -2.0 * rate * np.concatenate(g_rows))
                m.emb[BUCKETS] = 0
        # the sample holds both labels alike; the table does not
        m.out_bias += prior - np.log(max(n[1], 1) / max(n[0], 1))
        return m


def best_threshold(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """Logit with the highest weighted F1 (middle of the gap above the best cut)."""
    if not len(logit) or label.min() == label.max():
        return 0.0
    order = np.argsort(-logit, kind="stable")
    z, y, w = logit[order], label[order], weight[order]
    tp, fp = np.cumsum(w * y), np.cumsum(w * (1 - y))
    f1 = 2 * tp / (tp + fp + (w * y).sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(f1.argmax())
    return float((z[k] + (z[k + 1] if k + 1 < len(z) else z[k] - 1)) / 2)


@dataclass
class Toxicity:
    model: TextCNN
    thresholds: dict[str | None, float]  # by language, on the score; None: any other


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", rows: int = ROWS_A_CLASS) -> Toxicity:
    """Fits on about `rows` labelled rows of each class among the ids where `train` holds,
    and calibrates a threshold a language (and one for all) on a part it doesn't train on.

    Labels other than 0 and 1 and null ids or labels are no labelled rows. With rows of one
    label only, or none, the score is that label's share. Labelled texts that are null, empty
    or without a word are trained on as the empty text. An id that repeats on either side
    counts once for each pair of its rows. Executors hash the words, so that only word
    numbers of the sample come to the driver."""
    marked = labels.where(train & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    totals = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    sample = F.broadcast(sampled_rows(marked, "id", "label", rows))  # bounded by the parameter
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [word_ids(t).astype(np.int32).tobytes() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(words, pa.binary())], names=["id", "label", "lang", "words"])

    rows_of = src.join(sample, "id").select(F.col("id").cast("string").alias("id"), "label", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    got = sorted(rows_of.mapInArrow(hashed, "id string, label int, lang string, words binary").collect(), key=lambda r: (r["id"], r["label"], bytes(r["words"])))
    ids, y = [np.frombuffer(r["words"], np.int32).astype(np.int64) for r in got], np.array([r["label"] for r in got], float)
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1 or not len(y) or y.min() == y.max():
        zero = TextCNN(np.zeros((BUCKETS + 1, DIM)), [np.zeros((w, DIM, FILTERS)) for w in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS)), float(np.log((n1 + 0.5) / (n0 + 0.5))))
        return Toxicity(zero, {None: 0.5})
    cal = np.array([xxhash.xxh3_64_intdigest(r["id"]) % 1000 < 1000 * CALIBRATE for r in got])
    if len(set(y[~cal])) < 2 or len(set(y[cal])) < 2:
        cal[:] = False
    prior = float(np.log(n1 / n0))
    model = TextCNN.fit([i for i, c in zip(ids, cal, strict=True) if not c], y[~cal], prior)
    pick = cal if cal.any() else ~cal
    z = model.logits([i for i, c in zip(ids, pick, strict=True) if c])
    label = y[pick]
    weight = np.where(label == 1, n1 / max(1, label.sum()), n0 / max(1, (1 - label).sum()))
    model.shift = -best_threshold(z, label, weight)
    lang = np.array([r["lang"] or "" for r in got])[pick]
    z = z + model.shift
    cuts: dict[str | None, float] = {None: 0.5}
    for name in sorted(set(lang)):
        mine = lang == name
        if label[mine].sum() >= 20:
            cuts[name or None] = float(_sigmoid(best_threshold(z[mine], label[mine], weight[mine])))
    return Toxicity(model, cuts)


def score_toxicity(docs: DataFrame, fitted: Toxicity, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, score (0 to 1), threshold of the row's language, flagged.

    The score follows from the whole text alone. Null and empty texts get the score of a
    text without words; languages without a threshold of their own take the common one.
    Repeated rows are each returned; an empty table gives an empty result; other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted.model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                z = shared.value.logits([word_ids(t) for t in b.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_sigmoid(z.astype(np.float64)))], names=["id", "lang", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    cut = F.lit(fitted.thresholds[None])
    for name, at in fitted.thresholds.items():
        if name is not None:
            cut = F.when(F.col("lang") == name, F.lit(at)).otherwise(cut)
    out = src.mapInArrow(run, "id long, lang string, score double").withColumn("threshold", cut)
    return out.select(F.col("id").alias(id_col), "score", "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))
